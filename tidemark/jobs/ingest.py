"""From files to tables in one job: skip, parse, detect, mint, mask, check whole files, store, log.

Every file ends with one status: ``skipped`` (path and hash are in the log), ``unknown_template``,
``error:<what>``, ``blocked:name_conflict``, ``blocked:<check>`` or ``ok``. Only rows of ``ok`` files
are stored and only those files are logged, so the others are tried again. Values are minted, and
published by themselves, before use; all other tables and the log become visible in one version of
the database. A file's rows and vectors replace what an earlier version of it left: stale vectors go
first, and if any step fails nothing has changed. Merges and deletes write the buckets they touch.

Defined results: a file without lines is ``ok`` and stores nothing; two files of one path are one,
the last by hash; files without a folder name have no patient and are ``blocked:name_conflict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.session import saved
from tidemark.functions.text import basename, day_number, has_text
from tidemark.functions.vocab import HEADER_A, HEADER_B, PII, TEMPLATES
from tidemark.operators import boundary, deid, parse, store

#: The tables of texts, with their keys; all have ``source_file`` and ``seq``, as ``vector`` has (key: ``id``).
TABLES = {"section": ["patient_id", "template", "session_date", "name"], "finding": ["patient_id", "template", "session_date", "name"], "session": ["patient_id", "session_date"], "goal": ["patient_id", "session_date"]}


def template_of(path: Column, templates=TEMPLATES) -> Column:
    return F.coalesce(*[F.when(basename(path).startswith(prefix), F.lit(kind)) for prefix, kind in templates])


def parsed(files: DataFrame, today: Column, classify=parse.classify, domains=parse.domain_texts) -> tuple[DataFrame, DataFrame]:
    """Texts ``(path, kind, name, session_date, raw_date, seq, text)`` of files with a template, and their headers (path, name, date)."""
    lines = files.select(F.col("path").alias("doc_id"), "template", F.posexplode("paragraphs").alias("ord", "line"))
    plans = lines.filter("template = 'treatment_plan'").drop("template")
    reports = lines.filter("template <> 'treatment_plan'").drop("template")
    header_a, header_b = parse.header_fields(reports, HEADER_A, 10), parse.header_b(plans, HEADER_B, 15)
    born = F.col("date_of_birth")
    header = header_a.select("doc_id", "name", born, F.col("date").alias("raw_date"), parse.parse_day(F.col("date")).alias("day")).unionByName(header_b.select("doc_id", "name", born, F.col("start_date").alias("raw_date"), F.to_date("start_date").alias("day")))
    rows = classify(reports)
    section = parse.section_texts(rows).select("doc_id", F.lit("section").alias("kind"), F.col("section").alias("name"), "text")
    finding = domains(rows).select("doc_id", F.lit("finding").alias("kind"), F.col("domain").alias("name"), "text")
    dated = section.unionByName(finding).join(header.select("doc_id", "day", "raw_date"), "doc_id", "left").withColumn("seq", F.lit(0).cast("long")).withColumn("day", F.coalesce("day", today))
    blocks = parse.dated_blocks(plans, today).select("doc_id", F.lit("session").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("session_date").alias("day"), F.col("block").alias("seq"), "text")
    cells = files.filter("template = 'treatment_plan'").select(F.col("path").alias("doc_id"), F.posexplode("cells").alias("ord", "row")).filter(F.size("row") >= 2)
    goals = parse.goal_rows(cells.select("doc_id", "ord", F.get("row", F.lit(0)).alias("cell0"), F.get("row", F.lit(1)).alias("cell1")))[0]
    goals = goals.select("doc_id", F.lit("goal").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("session_date").alias("day"), F.col("ord").cast("long").alias("seq"), "text")
    texts = dated.unionByName(blocks.withColumn("raw_date", F.lit(None).cast("string"))).unionByName(goals.withColumn("raw_date", F.lit(None).cast("string")))
    return texts.withColumnRenamed("day", "session_date"), header.select(F.col("doc_id").alias("path"), F.col("name").alias("header_name"), "date_of_birth")


def chunks(rows: DataFrame) -> DataFrame:
    """The texts to embed, one for each patient, kind and date, whose names are their ids: those of sessions and goals, the last of a day."""
    kind = F.when(F.col("kind") == "session", "session_summary").when(F.col("kind") == "goal", "goals_row")
    own = rows.withColumn("chunk_type", kind).filter(F.col("chunk_type").isNotNull() & has_text(F.col("text")))
    own = store.upsert(own.select("patient_id", "session_date", "chunk_type", "text", "source_file", "seq"), ["patient_id", "session_date", "chunk_type"], ["seq", "source_file"])
    short = F.when(F.col("chunk_type") == "goals_row", "goals").otherwise("session")
    return own.withColumn("id", F.concat_ws("_", "patient_id", short, F.date_format("session_date", "yyyy-MM-dd"))).withColumn("session_date_num", day_number(F.col("session_date")))


def run(spark: SparkSession, files: DataFrame, root: str, at: Column, model: boundary.Factory | None = None, production: bool = True, patterns=PII, templates=TEMPLATES, key=deid.random_key, embedder: boundary.Factory | None = None, letters: str | None = None, **how) -> DataFrame:
    """``(path, status)`` of ``files`` (path, folder, hash, paragraphs, cells, error); all tables are in the database at ``root``.

    ``at``: the time of the run. ``model`` finds entities, of which those count that have one of ``letters``
    (a pattern); without one a production run stores nothing. ``embedder`` makes vectors of sessions
    and goals; without one there are none.
    """
    db = store.Database(spark, root)
    last = F.max_by(F.struct(*[c for c in files.columns if c != "path"]), F.coalesce("hash", F.lit("")))
    files = saved(files.groupBy("path").agg(last.alias("f")).select("path", "f.*").withColumn("template", template_of(F.col("path"), templates)), "files")
    log = db.read("log")
    fresh = files if log is None else files.join(log.select("path", "hash"), ["path", "hash"], "left_anti")
    good = fresh.filter("error is null and template is not null")
    texts, headers = parsed(good, F.to_date(at), **how)
    names = saved(deid.name_variants(good.select("path", "folder").join(headers, "path", "left")), "names")
    clear = names.filter("not conflict and size(variants) > 0")
    docs = saved(texts.join(clear.select(F.col("path").alias("doc_id")), "doc_id", "left_semi"), "texts")

    own = clear.select(F.col("path").alias("doc_id"), F.posexplode("variants").alias("place", "name"))
    found = deid.detect(docs.select("doc_id", "text"), patterns, own)
    if model is not None:
        found = found.unionByName(deid.of_entities(boundary.entities(_whole(docs), model, letters=letters)))
    found = saved(found.distinct(), "found")
    subjects = clear.select(F.lit("PERSON").alias("type"), F.get("variants", F.lit(0)).alias("value"))
    minted = saved(deid.mint(found.select("type", "value").unionByName(subjects), db.read("reid"), key), "minted")
    keys = db.begin()
    keys.merge("reid", minted.withColumn("seq", F.lit(0)), ["value"], ["seq"])
    keys.commit()
    reid = db.read("reid")
    masked = saved(deid.sweep(docs, reid, found), "masked")
    whole = saved(_whole(masked), "whole")
    still = boundary.entities(whole.withColumn("text", deid.scrubbed(F.col("text"))), model, letters=letters) if model is not None else None
    checks = saved(deid.gate(whole, reid, still, patterns, production), "checks")

    status = files.select("path", "hash", "folder", "template", "error").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left")
    status = status.join(names.select("path", (F.col("conflict") | (F.size("variants") == 0)).alias("conflict")), "path", "left").join(checks.select(F.col("doc_id").alias("path"), "failure_type"), "path", "left")
    what = F.when(F.col("fresh").isNull(), "skipped").when(F.col("error").isNotNull(), F.concat(F.lit("error:"), "error")).when(F.col("template").isNull(), "unknown_template")
    what = what.when(F.col("conflict"), "blocked:name_conflict").when(F.col("failure_type").isNotNull(), F.concat(F.lit("blocked:"), "failure_type")).otherwise("ok")
    status = saved(status.withColumn("status", what), "status")

    done = status.filter("status = 'ok'").join(clear.select("path", "date_of_birth", F.get("variants", F.lit(0)).alias("value")), "path")
    done = saved(done.join(reid.select("value", F.col("key").alias("patient_id")), "value").select("path", "hash", "folder", "patient_id", "template", "date_of_birth"), "done")
    rows = masked.join(done.select(F.col("path").alias("doc_id"), "patient_id", "template"), "doc_id").withColumnRenamed("doc_id", "source_file")
    rows = saved(rows.select("source_file", "patient_id", "template", "session_date", "raw_date", "name", "seq", "text", "kind"), "rows")
    if not done.isEmpty():
        stored(db, rows, done, at, embedder).commit()
    return status.select("path", "status")


def stored(db: store.Database, rows: DataFrame, done: DataFrame, at: Column, embedder: boundary.Factory | None = None) -> store.Transaction:
    """The changes that a batch of checked files makes to all tables, yet to be committed."""
    change, gone = db.begin(), done.select(F.col("path").alias("source_file"))
    if embedder is not None:
        change.delete("vector", gone, ["source_file"])
        vectors = boundary.embed(chunks(rows), "text", embedder, "document").drop("text")
        change.merge("vector", vectors, ["id"], ["seq", "source_file"])
    for name, keys in TABLES.items():
        change.delete(name, gone, ["source_file"])
        change.merge(name, rows.filter(F.col("kind") == name).drop("kind"), keys, ["seq", "source_file"])
    plans = done.filter("template = 'treatment_plan'").withColumn("told", F.create_map(F.lit("display_name"), F.col("folder"), F.lit("date_of_birth"), F.col("date_of_birth")))
    told = plans.select("patient_id", F.explode("told").alias("field_name", "value"), F.lit(0).alias("seq"), F.col("path").alias("source_file")).filter(has_text(F.col("value")))
    change.merge("attribute", told, ["patient_id", "field_name"], ["seq", "source_file"])
    change.merge("log", done.select("path", "hash", at.alias("ingested_at")), ["path"], ["ingested_at"])
    return change


def synced(db: store.Database, folders: DataFrame, key=deid.random_key) -> int:
    """Folders (folder) become patients: keys for new names, and a display name for each; files need not be there yet."""
    names = folders.select(F.col("folder").alias("value")).filter(has_text(F.col("value"))).distinct()
    minted = saved(deid.mint(names.withColumn("type", F.lit("PERSON")), db.read("reid"), key), "minted")
    change = db.begin()
    change.merge("reid", minted.withColumn("seq", F.lit(0)), ["value"], ["seq"])
    told = names.join(change.read("reid").select("value", F.col("key").alias("patient_id")), "value")
    change.merge("attribute", told.select("patient_id", F.lit("display_name").alias("field_name"), "value", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("source_file")), ["patient_id", "field_name"], ["seq", "source_file"])
    return change.commit()


def _whole(texts: DataFrame) -> DataFrame:
    """One text for each file, as the checks see it."""
    return texts.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
