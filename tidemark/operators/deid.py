"""De-identification: detect, mint once, replace, sweep, check, reverse.

All files are detected first, keys are minted once for distinct values, and only then texts are
replaced, so the result does not depend on the order of files. Keys are random and are written
before use, as a recomputed key would be another one. A text is rebuilt in one pass over the spans
of its own values, the longest first where several begin at one place; tokens are never looked into.

Defined results: a null text stays null, holds nothing and passes the gate; an empty one likewise;
rows with equal doc_id are alike in what is looked for, each text is rebuilt by itself; extra
columns, whatever their names, come through unchanged; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import free_names
from tidemark.functions.text import basename, strip
from tidemark.functions.vocab import ATTACHED, ENTITY_TYPES, PII, TOKEN
from tidemark.operators import known as known_values

#: Before a whole word, which one attached letter may precede.
ALONE = rf"(?:(?<!\w)|(?<=(?<!\w)[{''.join(ATTACHED)}]))"
ANY_TOKEN = TOKEN.replace("(", "(?:")


def random_key(_: Column) -> Column:
    """64 hex digits that nothing can be derived from."""
    return F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit(""))


def alternation(patterns=PII) -> str:
    """One expression of all patterns: the leftmost match counts, and at one place the first pattern."""
    return "|".join(f"(?:{p})" for _, p in patterns)


def type_of(value: Column, patterns=PII) -> Column:
    """The first type whose pattern is the whole value."""
    out = F.lit(patterns[-1][0])
    for kind, pattern in reversed(patterns[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def counts(text: Column, patterns=PII) -> list[Column]:
    """How often each type occurs, one pass for all."""
    found = F.transform(F.regexp_extract_all(text, F.lit(alternation(patterns)), 0), lambda v: type_of(v, patterns))
    return [F.size(F.filter(found, _is(kind))).cast("long").alias(f"n_{kind.lower()}") for kind, _ in patterns]


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def quoted(value: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


FOUND = "type string, value string, surface string, bounded boolean"


def detect(docs: DataFrame, patterns=PII, names: DataFrame | None = None) -> DataFrame:
    """``(doc_id, type, value)``, distinct: what the patterns find in each text, leftmost first.

    With ``names`` (doc_id, name: how a document's subject may be called, the canonical name first
    by column ``place``, if there is one) also those: full names of two words or more anywhere, in
    any case, for which the canonical name is the value; and each of their words as a whole word, in
    any case, as a value of its own. Then ``surface`` tells how the text has it, and ``bounded``
    whether it counts as a whole word alone.
    """
    hits = F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", ANY_TOKEN, " "), F.lit(alternation(patterns)), 0))
    rows = docs.select("doc_id", F.explode(hits).alias("value")).select("doc_id", type_of(F.col("value"), patterns).alias("type"), "value")
    if names is None:
        return rows
    rows = rows.select("doc_id", "type", "value", F.col("value").alias("surface"), F.lit(False).alias("bounded"))
    return rows.unionByName(named(docs, names)).distinct()


def named(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The spans of each document's own names, as ``detect`` describes them."""
    place = F.col("place") if "place" in names.columns else F.lit(0)
    names = names.filter(F.col("name").isNotNull() & (strip(F.col("name")) != ""))
    own = names.groupBy("doc_id").agg(F.min_by(strip(F.col("name")), F.struct(place, "name")).alias("main"), F.collect_set(strip(F.col("name"))).alias("all"))
    words = F.filter(F.array_distinct(F.split("main", r"\s+")), lambda w: F.length(w) >= 2)
    full = F.filter("all", lambda n: n.rlike(r"\S\s+\S"))
    held = docs.select("doc_id", F.regexp_replace("text", ANY_TOKEN, " ").alias("text")).join(own, "doc_id")
    pattern = lambda parts, form: F.concat(F.lit("(?iuU)"), F.array_join(F.transform(parts, form), "|"))
    anywhere = F.when(F.size(full) > 0, F.regexp_extract_all("text", pattern(full, quoted), F.lit(0)))
    alone = F.when(F.size(words) > 0, F.regexp_extract_all("text", pattern(words, lambda w: F.concat(F.lit(r"(?<!\w)"), quoted(w), F.lit(r"(?!\w)"))), F.lit(0)))
    spans = lambda hits, value, bounded: F.transform(F.coalesce(F.array_distinct(hits), F.array().cast("array<string>")), lambda x: F.struct(value(x).alias("value"), x.alias("surface"), F.lit(bounded).alias("bounded")))
    found = held.select("doc_id", F.explode(F.concat(spans(anywhere, lambda _: F.col("main"), False), spans(alone, lambda x: x, True))).alias("v"))
    return found.select("doc_id", F.lit("PERSON").alias("type"), "v.value", "v.surface", "v.bounded").distinct()


def of_entities(entities: DataFrame) -> DataFrame:
    """Spans of a model's entities, as ``detect`` gives them; labels without a type are left out."""
    kind = F.coalesce(*[F.when(F.col("label") == label, kind) for label, kind in ENTITY_TYPES])
    rows = entities.select("doc_id", kind.alias("type"), F.col("text").alias("value")).filter("type is not null")
    return rows.select("doc_id", "type", "value", F.col("value").alias("surface"), F.lit(True).alias("bounded")).distinct()


def mint(found: DataFrame, known: DataFrame | None = None, key: Callable[[Column], Column] = random_key) -> DataFrame:
    """``(value, type, key)`` of values that ``known`` lacks; the first type of a value stays. Write it before use."""
    values = found.groupBy("value").agg(F.min("type").alias("type"))
    if known is not None:
        values = values.join(known.select("value"), "value", "left_anti")
    return values.withColumn("key", key(F.col("value")))


def subject_ids(folders: DataFrame, reid: DataFrame) -> DataFrame:
    """``folders`` (folder) with ``patient_id``: the key of the folder's name; null before it is minted."""
    return folders.join(reid.select(F.col("value").alias("folder"), F.col("key").alias("patient_id")), "folder", "left")


def replace(docs: DataFrame, found: DataFrame, reid: DataFrame) -> DataFrame:
    """Texts with tokens for spans, and ``n_values``, the number of a document's distinct values.

    ``found``: doc_id, value, and surface and bounded where a value is written in other ways. The
    spans of a document form one expression, the longest first, so each text is read once.
    """
    if "surface" not in found.columns:
        found = found.select("doc_id", "value", F.col("value").alias("surface"), F.lit(False).alias("bounded"))
    token = F.concat_ws("_", "as", "key")
    pairs = found.join(reid.select("value", F.col("type").alias("as"), "key"), "value")
    # a surface of several values of one document stands for the first
    pairs = pairs.groupBy("doc_id", "surface").agg(F.min(F.struct("value", token.alias("token"))).alias("v"), F.min("bounded").alias("bounded"))
    spans, count, parts, gaps = free_names(docs, "spans", "n", "parts", "gaps")
    entry = F.struct((-F.length("surface")).alias("n"), "surface", F.col("v.token").alias("token"), "bounded")
    pairs = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias(spans), F.count_distinct("v.value").alias(count))
    rows = docs.join(pairs, "doc_id", "left")
    form = lambda s: F.when(s["bounded"], F.concat(F.lit(ALONE), quoted(s["surface"]), F.lit(r"(?!\w)"))).otherwise(quoted(s["surface"]))
    pattern = F.concat(F.lit(f"(?uU)(?:{ANY_TOKEN})|"), F.array_join(F.transform(spans, form), "|"))
    table = F.map_from_arrays(F.col(f"{spans}.surface"), F.col(f"{spans}.token"))
    rows = rows.withColumn(parts, F.when(F.col(spans).isNotNull(), F.regexp_extract_all("text", pattern, F.lit(0))))
    rows = rows.withColumn(gaps, F.when(F.size(parts) > 0, F.split("text", pattern, -1)))
    shown = F.zip_with(gaps, F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    rows = rows.withColumn("text", F.when(F.size(parts) > 0, F.array_join(shown, "")).otherwise(F.col("text")))
    return rows.withColumn("n_values", F.coalesce(count, F.lit(0))).drop(*({spans, count, parts, gaps} - {"n_values"})).select(*[c for c in docs.columns if c != "n_values"], "n_values")


def tokens(text: Column) -> Column:
    """All tokens of a text as (prefix, key)."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.struct(F.regexp_extract(t, TOKEN, 1).alias("prefix"), F.regexp_extract(t, TOKEN, 2).alias("key")))


def reidentify(docs: DataFrame, reid: DataFrame) -> DataFrame:
    """Texts with the values of known tokens, in one pass; unknown tokens stay."""
    used = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), 0))).alias("token"))
    used = used.withColumn("key", F.regexp_extract("token", TOKEN, 2)).join(reid.select("key", "value"), "key")
    table, = free_names(docs, "known")
    maps = used.groupBy("doc_id", "token").agg(F.min("value").alias("value")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias(table))
    parts = F.regexp_extract_all("text", F.lit(TOKEN), 0)
    shown = F.zip_with(F.split("text", ANY_TOKEN, -1), F.transform(parts, lambda p: F.coalesce(F.try_element_at(F.col(table), p), p)), lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    return docs.join(maps, "doc_id", "left").withColumn("text", F.when(F.col(table).isNotNull(), F.array_join(shown, "")).otherwise(F.col("text"))).select(*docs.columns)


def scrubbed(text: Column) -> Column:
    return F.regexp_replace(text, ANY_TOKEN, " ")


def eligible(value: Column) -> Column:
    """Values that the sweep and the gate look for: two characters at least, one of them of a word.

    Plain Latin words and digits count, too, as whole words (``plain``): no text is ever searched inside its tokens.
    """
    return (F.length(value) >= 2) & value.rlike(r"(?U)\w")


def plain(value: Column) -> Column:
    """Values of Latin letters and digits alone count as whole words; all others count anywhere in a text, inside words, too."""
    return value.rlike(r"^[A-Za-z0-9_]+$")


def held(docs: DataFrame, values: DataFrame, alone: Column | None = None) -> DataFrame:
    """``(doc_id, value)``, distinct: the values that the scrubbed texts hold; those with ``alone`` (default: ``plain``) as whole words."""
    return known_values.held(docs, values, scrubbed(F.col("text")), plain(F.col("value")) if alone is None else alone)


def sweep(docs: DataFrame, reid: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Texts with tokens for all eligible values that any document made known, beside the spans of ``found``.

    What one document's detection missed but another's caught goes here.
    """
    values = held(docs, reid.filter(eligible(F.col("value"))))
    values = values.select("doc_id", "value", F.col("value").alias("surface"), plain(F.col("value")).alias("bounded"))
    if found is not None:
        if "surface" not in found.columns:
            found = found.select("doc_id", "value", F.col("value").alias("surface"), F.lit(False).alias("bounded"))
        values = values.unionByName(found.select("doc_id", "value", "surface", "bounded"))
    return replace(docs, values.distinct(), reid)


def leaks(docs: DataFrame, reid: DataFrame) -> DataFrame:
    """Documents that still hold known values, with how many; the sweep's values."""
    return held(docs, reid.filter(eligible(F.col("value")))).groupBy("doc_id").agg(F.count("*").alias("n_leaks"))


def gate(docs: DataFrame, reid: DataFrame, entities: DataFrame | None = None, patterns=PII, production: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Whether each document passes, and the first check that fails: regex, reid_map, ner_rescan.

    ``entities``: what a model still finds in the texts with tokens scrubbed, None without a model;
    in production every document then fails the last check. ``found`` may give ``leaks`` where the
    caller has them.
    """
    found = leaks(docs, reid) if found is None else found
    rows = docs.select("doc_id", F.coalesce(scrubbed(F.col("text")).rlike(alternation(patterns)), F.lit(False)).alias("by_regex"))
    rows = rows.groupBy("doc_id").agg(F.max("by_regex").alias("by_regex")).join(found.select("doc_id", F.lit(True).alias("by_map")), "doc_id", "left")
    failure = F.when(F.col("by_regex"), "regex").when(F.coalesce("by_map", F.lit(False)), "reid_map")
    if entities is not None:
        rows = rows.join(of_entities(entities).select("doc_id").distinct().withColumn("by_model", F.lit(True)), "doc_id", "left")
        failure = failure.when(F.coalesce("by_model", F.lit(False)), "ner_rescan")
    elif production:
        failure = failure.otherwise("ner_rescan")
    return rows.select("doc_id", failure.alias("failure_type")).withColumn("passed", F.col("failure_type").isNull())


def text_windows(docs: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """Overlapping windows of characters that cover each text; the last one reaches its end."""
    step = size - overlap
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    rows = docs.filter(n > 0).select("doc_id", "text", F.explode(starts).alias("start"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.substring("text", F.col("start") + 1, F.lit(size)).alias("window"))


def name_in_file(path: Column) -> Column:
    """The words of a file's name after its last word of digits alone, without the extension; null if none are left."""
    words = F.filter(F.split(strip(F.regexp_replace(strip(basename(path)), r"(?i)\.docx$", "")), r"\s+"), lambda w: w != "")
    number = F.array_max(F.filter(F.transform(words, lambda w, i: F.when(w.rlike(r"^\d+$"), i + 1)), lambda i: i.isNotNull()))
    name = F.array_join(F.slice(words, F.coalesce(number, F.lit(0)) + 1, F.greatest(F.size(words), F.lit(1))), " ")
    return F.when(name != "", name)


def name_variants(rows: DataFrame) -> DataFrame:
    """``rows`` (folder, path, header_name) with ``variants`` and ``conflict``.

    A name in the file's name or header must end with the folder name's last word, in any case, or
    the row is in conflict and has no variants. Of names that agree, those of two words or more
    follow the folder's, each once, in any case.
    """
    folder = strip(F.coalesce("folder", F.lit("")))
    words = lambda x: F.filter(F.split(strip(x), r"\s+"), lambda w: w != "")
    told = F.filter(F.array(name_in_file(F.col("path")), strip(F.col("header_name"))), lambda x: F.coalesce(x != "", F.lit(False)))
    last = lambda x: F.lower(F.try_element_at(words(x), F.lit(-1)))
    conflict = (folder != "") & F.exists(told, lambda x: last(x) != last(folder))
    names = F.concat(F.array(folder), F.filter(told, lambda x: F.size(words(x)) >= 2))
    lowered = F.transform(names, lambda x: F.lower(x))
    first = F.transform(F.filter(F.transform(names, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(lowered, F.lower(s["x"])) == s["i"] + 1), lambda s: s["x"])
    none = F.array().cast("array<string>")
    return rows.withColumn("variants", F.when(conflict | (folder == ""), none).otherwise(first)).withColumn("conflict", conflict)


def forbidden_values(names: DataFrame, digits: DataFrame, plain: DataFrame) -> DataFrame:
    """``(kind, value)`` that no payload may hold: names and their words, digits without separators, plain strings; each from ``value``."""
    value = F.col("value")
    parts = names.select(F.explode(F.concat(F.array(value), F.split(value, r"\s+"))).alias("value")).filter(F.length("value") >= 2)
    bare = digits.select(F.regexp_replace(value, r"[\s\-./]", "").alias("value")).filter(value != "")
    rows = parts.select(F.lit("name").alias("kind"), "value").unionByName(bare.select(F.lit("digits").alias("kind"), "value"))
    return rows.unionByName(plain.filter(F.length("value") >= 4).select(F.lit("plain").alias("kind"), "value")).distinct()


def strings_of(payload: Column, kind: T.DataType) -> Column:
    """All strings of a payload of type ``kind``, however nested, as an array: keys of maps and names of fields among them, numbers not."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        out = F.array(payload)
    elif isinstance(kind, T.StructType):
        out = F.concat(F.array(*[F.lit(f.name) for f in kind]).cast("array<string>"), *[strings_of(payload[f.name], f.dataType) for f in kind])
    elif isinstance(kind, T.ArrayType):
        out = F.flatten(F.transform(payload, lambda x: strings_of(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        out = F.concat(strings_of(F.map_keys(payload), T.ArrayType(kind.keyType)), strings_of(F.map_values(payload), T.ArrayType(kind.valueType)))
    else:
        return none
    return F.filter(F.coalesce(out, none), lambda x: x.isNotNull())


def audit(payloads: DataFrame, forbidden: DataFrame, patterns=PII) -> DataFrame:
    """Per payload, which layers find something.

    derived_key: a 64-digit hex string that is the SHA-256 of a forbidden name. The other layers do
    not look into tokens. name: a forbidden name as whole words, one attached letter aside; digits:
    forbidden digits within a run of the payload's, separators aside; plain: a forbidden string
    anywhere; and pattern_*. ``forbidden``: kind (name, digits, plain), value. Names and strings are looked
    up by windows of bytes (``held``), digits by windows of as many digits as some value has, all equi-joins.
    """
    text = scrubbed(F.col("text"))
    of = lambda kind: forbidden.filter(F.col("kind") == kind).select("value").distinct()
    hashes = payloads.select("payload_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9a-f]{64}"), 0))).alias("value"))
    out = hashes.join(of("name").select(F.sha2("value", 256).alias("value")), "value").select("payload_id", F.lit("derived_key").alias("layer"))
    names = held(payloads.select(F.col("payload_id").alias("doc_id"), "text"), of("name"), F.lit(True))
    out = out.unionByName(names.select(F.col("doc_id").alias("payload_id"), F.lit("name").alias("layer")))
    strings = held(payloads.select(F.col("payload_id").alias("doc_id"), "text"), of("plain"), F.lit(False))
    out = out.unionByName(strings.select(F.col("doc_id").alias("payload_id"), F.lit("plain").alias("layer")))
    out = out.unionByName(_digit_windows(payloads, text, of("digits")).select("payload_id", F.lit("digits").alias("layer")))
    for kind, pattern in patterns:
        out = out.unionByName(payloads.filter(text.rlike(pattern)).select("payload_id", F.lit(f"pattern_{kind.lower()}").alias("layer")))
    found = out.groupBy("payload_id").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))
    return payloads.select("payload_id").join(found, "payload_id", "left").withColumn("clean", F.col("layers").isNull())


def _digit_windows(payloads: DataFrame, text: Column, values: DataFrame) -> DataFrame:
    """Payloads with a value within a run of their digits, separators aside."""
    sizes = sorted(r["n"] for r in values.groupBy(F.length("value").alias("n")).count().collect())  # a row a length
    if not sizes:
        return payloads.select("payload_id").limit(0)
    rows = payloads.select("payload_id", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"[\s\-./]", ""), F.lit(rf"\d{{{sizes[0]},}}"), 0))).alias("run"))
    windows = lambda n: F.transform(F.when(F.length("run") >= n, F.sequence(F.lit(1), F.length("run") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring("run", i, F.lit(n)))
    return rows.select("payload_id", F.explode(F.concat(*[windows(n) for n in sizes])).alias("value")).join(values, "value").select("payload_id").distinct()
