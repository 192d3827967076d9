"""Queries on databases: joint deletes, vectors of re-ingested files, crashed writes; and tags to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.session import saved, work_folder
from tidemark.jobs import views_sql as S
from tidemark.operators import boundary, store, tags
from tidemark.sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_FILE = lambda n: f"'file' || CAST({n} % 50 AS VARCHAR)"
_GONE = "('file7', 'file33', 'doc7', 'doc33', 'doc110')"
_LEFT = lambda name, view, source, more="true": f"SELECT '{name}' AS name, CAST(patient_id AS VARCHAR) AS patient_id, session_date, count(*) AS n FROM ({view}) x WHERE {source} NOT IN {_GONE} AND {more} GROUP BY ALL"
_PAIRS = f"(SELECT 1 FROM {S.PATIENT_SECTIONS} g WHERE g.source_file IN {_GONE} AND g.patient_id = x.patient_id AND g.session_date = x.session_date)"


@query("q_delete_sources", " UNION ALL ".join([
    _LEFT("section", f"SELECT * FROM {S.PATIENT_SECTIONS}", "source_file"), _LEFT("finding", S.FINDINGS, "source", f"NOT EXISTS {_PAIRS}"), _LEFT("session", f"SELECT * FROM {S.SESSIONS}", _FILE("seq")),
    _LEFT("goal", f"SELECT * FROM {S.GOALS}", _FILE("orderkey")), _LEFT("vector", S.VECTORS, _FILE("vec_id"))]))
def delete_sources(spark, d):
    """Five tables lose the rows of some source files, findings also those of the files' dates, in one version of a database."""
    file = lambda c: F.concat(F.lit("file"), (F.col(c) % 50).cast("string"))
    views = {
        "section": (V.patient_sections(spark, d), ["patient_id", "template", "session_date", "section"]), "finding": (V.findings(spark, d).withColumnRenamed("source", "source_file"), ["seq"]),
        "session": (V.sessions(spark, d).withColumn("source_file", file("seq")), ["patient_id", "session_date"]), "goal": (V.goals(spark, d).withColumn("source_file", file("orderkey")), ["patient_id", "session_date"]),
        "vector": (V.vectors(spark, d).withColumn("source_file", file("vec_id")), ["vec_id"]),
    }
    db = store.Database(spark, work_folder(spark, "database"))
    first = db.begin()
    for name, (rows, keys) in views.items():
        first.merge(name, rows, keys, [keys[-1]], least=4)
    first.commit()
    gone = spark.createDataFrame([(f,) for f in ("file7", "file33", "doc7", "doc33", "doc110")], "source_file string")
    change = db.begin()
    change.delete("finding", change.read("section").join(F.broadcast(gone), "source_file", "left_semi"), ["patient_id", "session_date"])
    for name in views:
        change.delete(name, gone, ["source_file"])
    change.commit()
    counts = [db.read(name).groupBy(F.lit(name).alias("name"), F.col("patient_id").cast("string").alias("patient_id"), "session_date").agg(F.count("*").alias("n")) for name in views]
    out = counts[0]
    for rows in counts[1:]:
        out = out.unionByName(rows)
    return out


@query("q_vacuum", "SELECT c_mktsegment AS name, CAST(2 AS BIGINT) AS n_unreferenced, CAST(0 AS BIGINT) AS n_after, count(*) AS n_rows FROM customer GROUP BY 1")
def vacuum(spark, d):
    """A table for each market segment, written twice, and a third time by a job that dies before its commit: two folders each that nothing names."""
    customers = V.table(spark, d, "customer")
    names = [r[0] for r in customers.select("c_mktsegment").distinct().collect()]  # five
    db = store.Database(spark, work_folder(spark, "vacuum"))
    for commits in (True, True, False):
        change = db.begin()
        for name in names:
            change.overwrite(name, customers.filter(F.col("c_mktsegment") == name))
        if commits:
            change.commit()
    of = lambda found: [n.removeprefix("data-").rsplit("-", 2)[0] for n, _ in found]
    before = of(db.unreferenced())
    db.vacuum(older_than_ms=0)
    after = of(db.unreferenced())
    told = spark.createDataFrame([(n, before.count(n), after.count(n)) for n in names], "name string, n_unreferenced long, n_after long")
    rows = db.read(names[0])
    for name in names[1:]:
        rows = rows.unionByName(db.read(name))
    return told.join(rows.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n_rows")), "name")


_DAY = lambda n: f"DATE '2024-01-01' + CAST(({n}) % 200 AS INTEGER)"
_PLANS = "(SELECT source, doc_id, doc_id % 3 = 0 AS changed FROM documents WHERE text <> '' AND doc_id IS NOT NULL)"


@query("q_ingest_vectors", f"""WITH p AS {_PLANS}, d1 AS (SELECT DISTINCT source, {_DAY('doc_id')} AS day FROM p), now AS (SELECT source, CASE WHEN changed THEN {_DAY('doc_id + 7')} ELSE {_DAY('doc_id')} END AS day, doc_id FROM p),
  d2 AS (SELECT DISTINCT source, day FROM now), kept AS (SELECT source, {_DAY('doc_id')} AS day, max(CAST(doc_id AS VARCHAR)) AS last FROM p GROUP BY ALL),
  alive AS (SELECT k.source, k.day FROM kept k JOIN p ON p.source = k.source AND CAST(p.doc_id AS VARCHAR) = k.last WHERE NOT changed UNION SELECT source, {_DAY('doc_id + 7')} FROM p WHERE changed),
  f AS (SELECT source AS folder, count(*) AS n_first FROM d1 GROUP BY source), s AS (SELECT source AS folder, count(*) AS n_second FROM alive GROUP BY source)
  SELECT folder, n_first, n_second, n_second AS n_sessions, CAST(0 AS BIGINT) AS n_orphans FROM f JOIN s USING (folder)""")
def ingest_vectors(spark, d):
    """Each document as a plan of one dated session; a third of the files then change their date: vectors of both runs, and those without a session."""
    from tidemark.jobs import ingest

    k = F.col("doc_id")
    docs = V.table(spark, d, "documents").filter("text <> '' and doc_id is not null")

    def files(shift, of):
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((k + shift) % 200).cast("int")), "d/M/yyyy")
        path = F.concat(F.lit("root/"), "source", F.lit("/תוכנית טיפול "), k.cast("string"), F.lit(" "), "source", F.lit(".docx"))
        lines = F.array(day, F.concat(F.lit("note "), F.sha2("text", 256)))
        return of.select(path.alias("path"), F.col("source").alias("folder"), F.sha2(F.concat(day, "text"), 256).alias("hash"), lines.alias("paragraphs"), F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(None).cast("string").alias("error"))

    root, at = work_folder(spark, "ingest"), F.lit("2025-01-01 12:00:00").cast("timestamp")
    db, out = store.Database(spark, root), []
    for batch in (files(0, docs), files(7, docs.filter("doc_id % 3 = 0"))):
        ingest.run(spark, batch, root, at, boundary.gazetteer(["zzz"]), patterns=[("X", "zzzz")], embedder=boundary.hashing_embedder(8))
        out.append(saved(db.read("vector").groupBy("patient_id").agg(F.count("*").alias("n")), "vectors"))
    sessions = db.read("session").select("patient_id", "session_date")
    orphans = db.read("vector").join(sessions, ["patient_id", "session_date"], "left_anti").groupBy("patient_id").agg(F.count("*").alias("n_orphans"))
    names = db.read("reid").select(F.col("value").alias("folder"), F.col("key").alias("patient_id"))
    rows = names.join(out[0].withColumnRenamed("n", "n_first"), "patient_id").join(out[1].withColumnRenamed("n", "n_second"), "patient_id")
    rows = rows.join(sessions.groupBy("patient_id").agg(F.count("*").alias("n_sessions")), "patient_id").join(orphans, "patient_id", "left")
    return rows.select("folder", "n_first", "n_second", "n_sessions", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


@query("q_sync_run", "SELECT source AS folder, sha256(source) AS patient_id, source AS display_name, CAST(1 AS BIGINT) AS n FROM documents WHERE source <> '' GROUP BY source")
def sync_run(spark, d):
    """Folders become patients with a key and a display name, in two overlapping batches; the second mints what is new alone."""
    from tidemark.jobs import ingest
    from tidemark.operators import deid

    docs = V.table(spark, d, "documents").select(F.col("source").alias("folder"), "doc_id")
    db = store.Database(spark, work_folder(spark, "subjects"))
    for batch in (docs.filter("doc_id % 2 = 0"), docs):
        ingest.synced(db, batch.select("folder"), key=lambda value: F.sha2(value, 256))
    ids = deid.subject_ids(docs.select("folder").filter("folder <> ''").distinct(), db.read("reid"))
    told = db.read("attribute").filter("field_name = 'display_name'").groupBy("patient_id").agg(F.max("value").alias("display_name"), F.count("*").alias("n"))
    return ids.join(told, "patient_id").select("folder", "patient_id", "display_name", "n")


#: Labels of a stand-in for a model: by a word's length.
LABELS = ["O", "B_PERS", "B_PERS", "I_PERS", "B_ORG", "I_ORG", "B_LOC"]


def word_tags():
    """Tokens between spaces, without the marks at their ends, labelled by their lengths; a special token at both ends."""

    def tag(texts):
        out = []
        for text in texts:
            at, found = 0, [(0, 0, "O")]
            for piece in text.split(" "):
                if bare := piece.rstrip(".,;:!?"):
                    found.append((at, at + len(bare), LABELS[len(bare) % 7]))
                at += len(piece) + 1
            out.append([*found, (0, 0, "B_PERS")])
        return out

    return tag


@query("q_bio_spans", """WITH w AS (SELECT doc_id, text, idx, piece, rtrim(piece, '.,;:!?') AS bare, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - length(piece) - 1 AS pos
    FROM (SELECT doc_id, text, unnest(string_split(text, ' ')) AS piece, generate_subscripts(string_split(text, ' '), 1) AS idx FROM documents)),
  t AS (SELECT *, (['', 'PER', 'PER', 'PER', 'ORG', 'ORG', 'LOC'])[CAST(length(bare) % 7 + 1 AS INTEGER)] AS type, length(bare) % 7 IN (3, 5) AS inside, pos + length(bare) AS stop FROM w WHERE bare <> ''),
  l AS (SELECT *, lag(type) OVER o AS before, lag(stop) OVER o AS ended FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
  g AS (SELECT *, CASE WHEN type = before AND (inside OR regexp_full_match(substr(text, CAST(ended AS BIGINT) + 1, CAST(pos - ended AS BIGINT)), '[\\s\\x0b]*')) THEN 0 ELSE 1 END AS opens FROM l),
  r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM g)
  SELECT doc_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, type AS label, sha256(substr(any_value(text), CAST(min(pos) AS BIGINT) + 1, CAST(max(stop) - min(pos) AS BIGINT))) AS digest FROM r WHERE type IN ('PER', 'ORG') GROUP BY doc_id, run, type""")
def bio_spans(spark, d) -> DataFrame:
    """Spans of whole documents from labels of their words; a text is one window, so that the words are those of the text."""
    docs = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = tags.tagged(docs, word_tags, size=1 << 30, overlap=0).withColumn("s", F.explode(tags.spans(F.col("window"), F.col("tokens"), ["PER", "ORG"])))
    at = lambda c: F.col(f"s.{c}").cast("long")
    return rows.select("doc_id", at("start").alias("start"), at("end").alias("stop"), F.col("s.label").alias("label"), F.sha2("s.text", 256).alias("digest"))
