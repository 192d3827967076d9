"""Lines of semi-structured documents into typed rows, by carrying values forward in windows.

Defined results: a null or empty line is no line; a document without lines gives no rows; rows with equal doc_id are
one document, lines of one ``ord`` in any order; lines of any length are read whole; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import has_text, ordered_concat, parse_day, strip
from tidemark.functions.vocab import DOMAINS, FINDINGS, PARENTS, SECTIONS, SIGNATURE_MARK, SIGNATURE_START

BLOCKED = "#blocked"


def _first(cases: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(c, v) for c, v in cases])


def labelled(line: Column, labels: list[str], colon: bool = True) -> Column:
    """What follows a label in a stripped line: the line is cut at its first colon and what stands before it compared with
    ``labels``, in any case; without ``colon`` a label may also be the line's first words. Else null."""
    known = [x.lower() for x in labels]
    head = F.lower(strip(F.substring_index(line, ":", 1)))
    out = F.when(line.contains(":") & head.isin(known), F.substring(line, F.locate(":", line) + 1, F.length(line)))
    if not colon:
        for label in known:
            after = F.substring(line, F.lit(len(label) + 1), F.length(line))
            out = F.coalesce(out, F.when(F.lower(line).startswith(label) & after.rlike(r"(?U)^\s"), after))
    return strip(out)


def header_fields(lines: DataFrame, fields: list[tuple], first: int) -> DataFrame:
    """The first non-empty value of each field among the first ``first`` lines of each document.

    ``fields``: name, labels and whether a colon must follow; or name and an expression of which group 1 is the value.
    """
    rows = lines.filter(F.col("ord") < first)
    hits = []
    for name, how, *colon in fields:
        line = strip(F.col("line"))
        value = strip(F.regexp_extract(line, how, 1)) if isinstance(how, str) else labelled(line, how, *colon)
        hits.append(F.min_by(F.when(value != "", value), F.when(value != "", F.col("ord"))).alias(name))
    return rows.groupBy("doc_id").agg(*hits)


def header_b(lines: DataFrame, fields: list[tuple], first: int = 15) -> DataFrame:
    """``header_fields`` with ``start_date`` in ISO form where it is a date, as it is written where not."""
    rows = header_fields(lines, fields, first)
    return rows.withColumn("start_date", F.coalesce(F.date_format(parse_day(F.col("start_date")), "yyyy-MM-dd"), "start_date"))


def classify(lines: DataFrame, sections=SECTIONS, domains=DOMAINS, findings: str = FINDINGS, mark: str = SIGNATURE_MARK, start: str = SIGNATURE_START) -> DataFrame:
    """Each non-blank line with its section, run of lines, domain and kind.

    A signature blocks lines until the next heading; a heading is a prefix; a domain heading counts
    within findings alone and may carry text after a colon or dash.
    """
    x = strip(F.col("line"))
    rows = lines.withColumn("line", x).filter(x != "")
    line = F.col("line")
    signed = line.contains(mark) | line.startswith(start)
    bare = F.regexp_replace(line, ":+$", "")
    heading = _first([(bare.startswith(h.rstrip(":")), F.lit(k)) for h, k in sections])
    rows = rows.withColumn("opens", F.when(signed, BLOCKED).otherwise(heading))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last("opens", ignorenulls=True).over(w)).withColumn("run", F.count("opens").over(w))
    named = _first([(line.startswith(d), F.lit(d)) for d in domains])
    opens_domain = F.when((F.col("section") == findings) & F.col("opens").isNull(), named)
    rows = rows.withColumn("opens_domain", opens_domain)
    v = Window.partitionBy("doc_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("domain", F.last("opens_domain", ignorenulls=True).over(v))
    inline = F.expr("substring(line, length(opens_domain) + 1)")
    inline = strip(F.regexp_replace(inline, r"(?U)^\s*[:\-–]?\s*", ""))
    kind = F.when(F.col("opens") == BLOCKED, "signature").when(F.col("opens").isNotNull(), "heading").when(F.col("opens_domain").isNotNull(), "domain")
    kind = kind.when(F.col("section").isNull(), "preamble").when(F.col("section") == BLOCKED, "blocked").otherwise("content")
    return rows.withColumn("kind", kind).withColumn("content", F.when(F.col("kind") == "content", line).when(F.col("kind") == "domain", F.when(inline != "", inline)))


def section_texts(classified: DataFrame) -> DataFrame:
    """Lines of each document's sections outside of domains, joined in order."""
    rows = classified.filter("kind = 'content' and domain is null")
    return rows.groupBy("doc_id", "section").agg(ordered_concat(F.col("content"), ["ord"], "\n").alias("text"))


def domain_texts(classified: DataFrame, parents: dict[str, str] = PARENTS) -> DataFrame:
    """Lines of each document's domains, joined in order, with the parent; pure parents are left out."""
    rows = classified.filter(F.col("domain").isNotNull() & F.col("kind").isin("content", "domain"))
    rows = rows.groupBy("doc_id", "domain").agg(ordered_concat(F.col("content"), ["ord"], "\n").alias("text"))
    parent = _first([(F.col("domain") == c, F.lit(p)) for c, p in parents.items()]) if parents else F.lit(None).cast("string")
    return rows.filter(~F.col("domain").isin(*set(parents.values())) if parents else F.lit(True)).withColumn("parent_domain", parent)


def section_grid(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document with a column a section, empty where it has none, and how many it has."""
    grid = texts.groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col("section") == k, F.col("text"))), F.lit("")).alias(k) for k in keys])
    return grid.withColumn("n_filled", reduce(lambda a, b: a + b, [F.when(F.col(k) != "", 1).otherwise(0) for k in keys]).cast("long"))


def missing_sections(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The sections that each document lacks."""
    have = texts.groupBy("doc_id").agg(F.collect_set("section").alias("have"))
    return have.select("doc_id", F.explode(F.array_except(F.array(*[F.lit(k) for k in keys]), "have")).alias("section"))


def section_spans(classified: DataFrame) -> DataFrame:
    """From the first heading of each section to the next heading or signature of the document."""
    opens = classified.filter("opens is not null")
    w = Window.partitionBy("doc_id").orderBy("ord")
    spans = opens.withColumn("stop", F.lead("ord").over(w)).filter(F.col("kind") == "heading")
    first = F.min_by(F.struct("ord", "stop"), "ord")
    return spans.groupBy("doc_id", "section").agg(first.alias("s")).select("doc_id", "section", F.col("s.ord").alias("start"), F.col("s.stop").alias("stop"))


def blocks(lines: DataFrame, marker: Column, date: Column) -> DataFrame:
    """Dated blocks: a marker line opens one, lines before the first are left out, empty ones give none."""
    x = strip(F.col("line"))
    rows = lines.withColumn("line", x).withColumn("_m", marker & (x != "")).withColumn("_d", date).filter(x != "")
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.count_if(F.col("_m")).over(w)).withColumn("session_date", F.last(F.when(F.col("_m"), F.col("_d")), ignorenulls=True).over(w))
    rows = rows.filter(~F.col("_m") & (F.col("block") > 0))
    return rows.groupBy("doc_id", "block", "session_date").agg(ordered_concat(F.col("line"), ["ord"], "\n").alias("text"))


def dated_blocks(lines: DataFrame, fallback: Column) -> DataFrame:
    """``blocks`` by lines that are dates; a document without any is one block of ``fallback``'s date."""
    found = blocks(lines, parse_day(F.col("line")).isNotNull(), parse_day(F.col("line")))
    x = strip(F.col("line"))
    bare = lines.withColumn("line", x).filter(x != "").groupBy("doc_id").agg(F.max(parse_day(F.col("line"))).alias("_d"), ordered_concat(F.col("line"), ["ord"], "\n").alias("text"))
    whole = bare.filter("_d is null").select("doc_id", F.lit(0).cast("long").alias("block"), fallback.alias("session_date"), "text")
    return found.unionByName(whole)


def goal_rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a goals table with a date and a text, and the rejects with a reason; blank rows go."""
    day, text = strip(F.col("cell0")), strip(F.col("cell1"))
    rows = cells.withColumn("raw_date", day).withColumn("text", text).withColumn("session_date", parse_day(day)).filter((F.col("raw_date") != "") | (F.col("text") != ""))
    good = F.col("session_date").isNotNull() & has_text(F.col("text"))
    reason = F.when(F.col("session_date").isNull(), "date").otherwise("text")
    return rows.filter(good).drop("cell0", "cell1", "raw_date"), rows.filter(~good).withColumn("reason", reason).drop("cell0", "cell1", "session_date")
