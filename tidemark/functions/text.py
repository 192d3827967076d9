"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(x: Column) -> Column:
    """White space off both ends, as Unicode has it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_chars(x: Column, chars: str) -> Column:
    """``chars`` off both ends."""
    return F.btrim(x, F.lit(chars))


def parse_day(x: Column) -> Column:
    """A date of day, month and four-digit year between slashes or dots; else null."""
    s = strip(x)
    slash = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
    dots = F.when(s.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(s, "d.M.yyyy"))
    return F.coalesce(slash, dots)


def day_number(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def dated(label: str, date: Column, text: Column) -> Column:
    return F.concat(F.lit(f"[{label} "), F.date_format(date, "yyyy-MM-dd"), F.lit("]\n"), text)


def has_text(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def ordered_concat(x: Column, order: list, sep: str) -> Column:
    """Aggregate: strings joined in order; nulls are left out."""
    parts = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*order, x.alias("_x")))))
    return F.array_join(F.transform(parts, lambda p: p["_x"]), sep)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def relative_to(path: Column, roots: list[str]) -> Column:
    """The path below the first root that holds it, or as it is."""
    out = path
    for root in reversed(roots):
        base = root.rstrip("/") + "/"
        out = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(out)
    return out
