"""Queries on the keyed temporal store: ranges, joins, aggregates, windows, sets and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.session import work_folder
from tidemark.functions.text import basename, dated, day_number, folder, has_text, ordered_concat, relative_to
from tidemark.jobs import views_sql as S
from tidemark.operators import retrieve as R, store
from tidemark.sources import views as V
from tidemark.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


REF = "1996-06-01"


def _ref():
    return F.lit(REF).cast("date")


@query("q_sessions_range", f"SELECT patient_id, session_date, text FROM {S.SESSIONS} WHERE session_date >= DATE '1995-03-01' AND session_date <= DATE '1996-09-30' ORDER BY session_date")
def sessions_range(spark, d):
    return V.sessions(spark, d).filter(R.in_range(F.col("session_date"), "1995-03-01", "1996-09-30")).select("patient_id", "session_date", "text").orderBy("session_date")


@query("q_sections_range", f"SELECT patient_id, session_date, section, text FROM {S.SECTIONS} WHERE template = 'diagnosis' AND session_date >= DATE '2024-03-01' ORDER BY session_date, section")
def sections_range(spark, d):
    return V.sections(spark, d).filter((F.col("template") == "diagnosis") & R.in_range(F.col("session_date"), "2024-03-01")).select("patient_id", "session_date", "section", "text").orderBy("session_date", "section")


@query("q_goals_between", f"SELECT patient_id, session_date, text FROM {S.GOALS} WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def goals_between(spark, d):
    return V.goals(spark, d).filter(F.col("session_date").between("1996-01-01", "1996-12-31")).select("patient_id", "session_date", "text")


@query("q_session_dates", f"SELECT DISTINCT patient_id, session_date FROM ({S.SESSIONS_RAW}) ORDER BY session_date DESC")
def session_dates(spark, d):
    return V.sessions_raw(spark, d).select("patient_id", "session_date").distinct().orderBy(F.desc("session_date"))


@query("q_max_date", f"SELECT patient_id, max(session_date) AS last_date FROM ({S.SESSIONS_RAW}) GROUP BY patient_id")
def max_date(spark, d):
    return V.sessions_raw(spark, d).groupBy("patient_id").agg(F.max("session_date").alias("last_date"))


_LATEST = f"SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY session_date DESC, seq DESC) AS rn FROM {S.SESSIONS}"


@query("q_latest_n", f"SELECT patient_id, session_date, text, row_number() OVER (PARTITION BY patient_id ORDER BY session_date, seq) AS place FROM ({_LATEST}) WHERE rn <= 3")
def latest_n(spark, d):
    return R.latest_n(V.sessions(spark, d), "patient_id", 3).select("patient_id", "session_date", "text", "place")


@query("q_recent_window", f"SELECT patient_id, min(session_date) AS date_from, max(session_date) AS date_to FROM ({_LATEST}) WHERE rn <= 4 GROUP BY patient_id")
def recent_window(spark, d):
    return R.recent_window(V.sessions(spark, d), "patient_id", 4)


_LAST_DOC = f"SELECT * FROM (SELECT *, max(session_date) OVER (PARTITION BY patient_id, template) AS last FROM {S.SECTIONS}) WHERE session_date = last"


@query("q_latest_document", f"SELECT patient_id, template, session_date, section, text FROM ({_LAST_DOC})")
def latest_document(spark, d):
    return R.latest_documents(V.sections(spark, d)).select("patient_id", "template", "session_date", "section", "text")


@query("q_base_document", f"""SELECT patient_id, template, session_date FROM (SELECT patient_id, template, session_date, row_number() OVER (PARTITION BY patient_id ORDER BY
  CASE template WHEN 'clinic_visit_summary' THEN 1 ELSE 2 END, session_date DESC) AS rn FROM {S.SECTIONS} WHERE template IN ('clinic_visit_summary', 'diagnosis')) WHERE rn = 1""")
def base_document(spark, d):
    return R.base_documents(V.sections(spark, d), ["clinic_visit_summary", "diagnosis"])


@query("q_compare_split", f"SELECT patient_id, session_date, text, CASE WHEN session_date < DATE '{REF}' THEN 'before' ELSE 'after' END AS side FROM {S.SESSIONS}")
def compare_split(spark, d):
    return R.compare_split(V.sessions(spark, d), _ref()).select("patient_id", "session_date", "text", "side")


@query("q_compare_counts", f"SELECT CASE WHEN session_date < DATE '{REF}' THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM {S.SESSIONS} GROUP BY 1")
def compare_counts(spark, d):
    return R.compare_split(V.sessions(spark, d), _ref()).groupBy("side").agg(F.count("*").alias("n"))


_STATUS = f"""SELECT patient_id, n_before, n_after, CASE WHEN n_before = 0 AND n_after = 0 THEN 'no_data' WHEN n_before = 0 THEN 'no_before' WHEN n_after = 0 THEN 'no_after' ELSE 'ok' END AS status
  FROM (SELECT patient_id, count(*) FILTER (session_date < DATE '{REF}') AS n_before, count(*) FILTER (session_date >= DATE '{REF}') AS n_after FROM {S.SESSIONS} GROUP BY patient_id)"""


@query("q_compare_status", _STATUS)
def compare_status(spark, d):
    return R.compare_status(V.sessions(spark, d), "patient_id", _ref())


_ASOF = f"SELECT s.patient_id, s.session_date, g.text AS goal FROM {S.SESSIONS} s ASOF LEFT JOIN {S.GOALS} g ON s.patient_id = g.patient_id AND s.session_date >= g.session_date"


@query("q_goals_asof", _ASOF)
def goals_asof(spark, d):
    goals = V.goals(spark, d).withColumnRenamed("text", "goal")
    return R.as_of(V.sessions(spark, d).select("patient_id", "session_date"), goals, "patient_id", "session_date", "goal", ["orderkey", "line"])


@query("q_subject_overview", f"""SELECT l.patient_id, l.session_date, l.text, l.place, st.status, a.goal FROM
  (SELECT patient_id, session_date, text, row_number() OVER (PARTITION BY patient_id ORDER BY session_date, seq) AS place FROM ({_LATEST}) WHERE rn <= 3) l
  JOIN ({_STATUS}) st USING (patient_id) JOIN ({_ASOF}) a USING (patient_id, session_date)""")
def subject_overview(spark, d):
    """The latest sessions of every patient with the goal in force and how a comparison would go."""
    sessions = V.sessions(spark, d)
    latest = R.latest_n(sessions, "patient_id", 3).select("patient_id", "session_date", "text", "place")
    goals = V.goals(spark, d).withColumnRenamed("text", "goal")
    with_goal = R.as_of(latest, goals, "patient_id", "session_date", "goal", ["orderkey", "line"])
    status = R.compare_status(sessions, "patient_id", _ref()).select("patient_id", "status")
    return with_goal.join(status, "patient_id").select("patient_id", "session_date", "text", "place", "status", "goal")


_HITS = f"SELECT vec_id, s.patient_id, s.session_date, chunk_type FROM (SELECT vec_id, chunk_type FROM ({S.VECTORS})) v JOIN (SELECT patient_id, session_date, seq FROM {S.SESSIONS}) s ON s.seq = v.vec_id * 3"


def _hits(spark, d):
    v = V.vectors(spark, d).select((F.col("vec_id") * 3).alias("seq"), "vec_id", "chunk_type")
    return v.join(V.sessions(spark, d).select("patient_id", "session_date", "seq"), "seq").select("vec_id", "patient_id", "session_date", "chunk_type")


@query("q_hydrate_sessions", f"SELECT h.vec_id, h.patient_id, h.session_date, s.text FROM ({_HITS}) h JOIN {S.SESSIONS} s USING (patient_id, session_date) WHERE h.chunk_type = 'session_summary'")
def hydrate_sessions(spark, d):
    return _hits(spark, d).filter("chunk_type = 'session_summary'").join(V.sessions(spark, d).select("patient_id", "session_date", "text"), ["patient_id", "session_date"]).select("vec_id", "patient_id", "session_date", "text")


@query("q_hydrate_mixed", f"""SELECT h.vec_id, h.patient_id, h.session_date, h.chunk_type, s.text FROM ({_HITS}) h JOIN {S.SESSIONS} s USING (patient_id, session_date) WHERE h.chunk_type = 'session_summary'
  UNION ALL SELECT h.vec_id, h.patient_id, h.session_date, h.chunk_type, g.text FROM ({_HITS}) h ASOF JOIN {S.GOALS} g ON h.patient_id = g.patient_id AND h.session_date >= g.session_date WHERE h.chunk_type = 'goals_row'""")
def hydrate_mixed(spark, d):
    return R.hydrate(_hits(spark, d), V.sessions(spark, d), V.goals(spark, d))


@query("q_domain_exact", f"SELECT patient_id, session_date, domain, text FROM ({S.FINDINGS}) WHERE domain = 'purchase' ORDER BY session_date")
def domain_exact(spark, d):
    return V.findings(spark, d).filter("domain = 'purchase'").select("patient_id", "session_date", "domain", "text").orderBy("session_date")


@query("q_domain_parent", f"SELECT patient_id, session_date, domain, text FROM ({S.FINDINGS}) WHERE parent_domain = 'engagement' ORDER BY session_date, domain")
def domain_parent(spark, d):
    return V.findings(spark, d).filter("parent_domain = 'engagement'").select("patient_id", "session_date", "domain", "text").orderBy("session_date", "domain")


_TOPIC = f"SELECT query_id, patient_id, trim(trim(topic), ' \",') AS topic FROM ({S.PARAMS}) WHERE topic IS NOT NULL"


@query("q_domain_fallback", f"""SELECT q.query_id, q.topic, count(f.text) AS n, CASE WHEN count(f.text) > 0 THEN 'domain' ELSE 'vector' END AS source FROM ({_TOPIC}) q
  LEFT JOIN ({S.FINDINGS}) f ON q.patient_id = f.patient_id AND (f.domain = q.topic OR f.parent_domain = q.topic) AND f.text <> '' GROUP BY q.query_id, q.topic""")
def domain_fallback(spark, d):
    q = V.params(spark, d).filter("topic is not null").select("query_id", "patient_id", F.btrim("topic", F.lit(' ",')).alias("topic"))
    return R.with_fallback(q, R.domain_lookup(V.findings(spark, d), q)).select("query_id", "topic", "n", "source")


@query("q_findings_on_date", f"SELECT patient_id, domain, text FROM ({S.FINDINGS}) WHERE session_date = (SELECT min(session_date) FROM ({S.FINDINGS}))")
def findings_on_date(spark, d):
    f = V.findings(spark, d)
    return f.join(f.agg(F.min("session_date").alias("session_date")), "session_date").select("patient_id", "domain", "text")


@query("q_document_with_findings", f"""SELECT f.patient_id, f.session_date, f.domain, f.text FROM ({S.FINDINGS}) f JOIN (SELECT DISTINCT CAST(doc_id % 150 AS BIGINT) AS patient_id, session_date FROM
  (SELECT doc_id, (SELECT min(session_date) FROM ({S.FINDINGS})) + CAST(doc_id % 30 AS INTEGER) AS session_date FROM documents)) USING (patient_id, session_date)""")
def document_with_findings(spark, d):
    f = V.findings(spark, d)
    docs = V.table(spark, d, "documents").select("doc_id").join(f.agg(F.min("session_date").alias("first")))
    docs = docs.select((F.col("doc_id") % 150).alias("patient_id"), F.date_add("first", (F.col("doc_id") % 30).cast("int")).alias("session_date"))
    return R.findings_of(docs, f).select("patient_id", "session_date", "domain", "text")


@query("q_subject_list", f"SELECT patient_id, value AS display_name FROM ({S.ATTRIBUTES}) WHERE field_name = 'display_name' ORDER BY value")
def subject_list(spark, d):
    return V.attributes(spark, d).filter("field_name = 'display_name'").select("patient_id", F.col("value").alias("display_name")).orderBy("value")


@query("q_subject_pivot", f"""SELECT patient_id, max(value) FILTER (field_name = 'display_name') AS display_name, max(value) FILTER (field_name = 'segment') AS segment, max(value) FILTER (field_name = 'nation') AS nation
  FROM ({S.ATTRIBUTES}) GROUP BY patient_id""")
def subject_pivot(spark, d):
    rows = store.upsert(V.attributes(spark, d), ["patient_id", "field_name"], ["value"])
    return rows.groupBy("patient_id").pivot("field_name", ["display_name", "segment", "nation"]).agg(F.first("value"))


@query("q_source_files", f"""SELECT source_file AS path FROM {S.SECTIONS} WHERE source_file IS NOT NULL UNION SELECT source FROM ({S.FINDINGS}) WHERE source IS NOT NULL
  UNION SELECT 'order' || CAST(seq % 100 AS VARCHAR) FROM {S.SESSIONS} ORDER BY path""")
def source_files(spark, d):
    a = V.sections(spark, d).filter("source_file is not null").select(F.col("source_file").alias("path"))
    b = V.findings(spark, d).filter("source is not null").select(F.col("source").alias("path"))
    c = V.sessions(spark, d).select(F.concat(F.lit("order"), (F.col("seq") % 100).cast("string")).alias("path"))
    return a.unionByName(b).unionByName(c).distinct().orderBy("path")


_IDS = "CAST(patient_id AS VARCHAR) || '_{}_' || strftime(session_date, '%Y-%m-%d')"


@query("q_vector_ids_by_file", f"""SELECT {_IDS.format('session')} AS id FROM {S.SESSIONS} WHERE seq % 100 = 7 UNION ALL SELECT {_IDS.format('goal')} FROM {S.GOALS} WHERE orderkey % 100 = 7""")
def vector_ids_by_file(spark, d):
    make = lambda rows, kind: rows.select(F.concat_ws("_", F.col("patient_id").cast("string"), F.lit(kind), F.date_format("session_date", "yyyy-MM-dd")).alias("id"))
    return make(V.sessions(spark, d).filter("seq % 100 = 7"), "session").unionByName(make(V.goals(spark, d).filter("orderkey % 100 = 7"), "goal"))


@query("q_missing_sections", f"""SELECT p.patient_id, p.session_date, s.section FROM (SELECT DISTINCT patient_id, session_date FROM {S.SECTIONS} WHERE template = 'diagnosis') p CROSS JOIN (SELECT 's' || CAST(unnest(range(0, 40, 4)) AS VARCHAR) AS section) s
  WHERE NOT EXISTS (SELECT 1 FROM {S.SECTIONS} x WHERE x.patient_id = p.patient_id AND x.session_date = p.session_date AND x.section = s.section AND x.template = 'diagnosis')""")
def missing_sections(spark, d):
    have = V.sections(spark, d).filter("template = 'diagnosis'").groupBy("patient_id", "session_date").agg(F.collect_set("section").alias("have"))
    return have.select("patient_id", "session_date", F.explode(F.array_except(F.array(*[F.lit(f"s{i}") for i in range(0, 40, 4)]), "have")).alias("section"))


@query("q_upsert_lww", f"SELECT patient_id, session_date, text, seq FROM {S.SESSIONS}")
def upsert_lww(spark, d):
    return V.sessions(spark, d)


@query("q_overwrites", f"SELECT patient_id, session_date, count(*) - 1 AS n_lost FROM ({S.SESSIONS_RAW}) GROUP BY 1, 2 HAVING count(*) > 1")
def overwrites(spark, d):
    return store.overwritten(V.sessions_raw(spark, d), ["patient_id", "session_date"])


@query("q_update_ids", f"SELECT patient_id, session_date, CASE WHEN seq % 3 = 0 THEN {_IDS.format('session')} ELSE 'old' END AS vector_id FROM {S.SESSIONS}")
def update_ids(spark, d):
    rows = V.sessions(spark, d)
    new = rows.filter("seq % 3 = 0").select("patient_id", "session_date", F.concat_ws("_", F.col("patient_id").cast("string"), F.lit("session"), F.date_format("session_date", "yyyy-MM-dd")).alias("vector_id"))
    return store.set_values(rows.select("patient_id", "session_date", F.lit("old").alias("vector_id")), new, ["patient_id", "session_date"], "vector_id")


_GONE = "source IN ('file3', 'file17', 'file31')"


@query("q_cascade_delete", f"SELECT patient_id, session_date, text FROM ({S.FINDINGS}) f WHERE NOT EXISTS (SELECT 1 FROM ({S.FINDINGS}) g WHERE g.{_GONE} AND g.patient_id = f.patient_id AND g.session_date = f.session_date)")
def cascade_delete(spark, d):
    f = V.findings(spark, d)
    return store.cascade(f, f.filter(_GONE), ["patient_id", "session_date"]).select("patient_id", "session_date", "text")


@query("q_reingest_replace", f"""SELECT patient_id, session_date, domain, text FROM {S.last_write(f"SELECT patient_id, session_date, domain, text, seq, 0 AS fresh FROM ({S.FINDINGS}) WHERE NOT ({_GONE}) UNION ALL SELECT patient_id, session_date, domain, 'new', seq, 1 FROM ({S.FINDINGS}) WHERE {_GONE}", "patient_id, session_date, domain", "seq DESC, fresh DESC")}""")
def reingest_replace(spark, d):
    f = V.findings(spark, d)
    fresh = f.filter(_GONE).withColumn("text", F.lit("new"))
    return store.replace_sources(f, fresh, "source", ["patient_id", "session_date", "domain"], ["seq"]).select("patient_id", "session_date", "domain", "text")


_STATUS_OF = "CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'changed' ELSE 'unchanged' END"


def _log(spark, d):
    docs = V.table(spark, d, "documents").filter("doc_id % 10 <> 0")
    return docs.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 10 == 1, F.sha2(F.concat(F.col("text"), F.lit("?")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))


@query("q_changed_files", f"SELECT doc_id AS path, sha256(text) AS hash, {_STATUS_OF} AS status FROM documents WHERE doc_id % 10 < 2")
def changed_files(spark, d):
    files = V.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return store.changed(files, _log(spark, d))


@query("q_ingest_tally", f"SELECT {_STATUS_OF} AS status, count(*) AS n FROM documents GROUP BY 1")
def ingest_tally(spark, d):
    files = V.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    status = files.select("path").join(store.changed(files, _log(spark, d)).select("path", "status"), "path", "left")
    return status.groupBy(F.coalesce("status", F.lit("unchanged")).alias("status")).agg(F.count("*").alias("n"))


@query("q_nonempty_text", f"SELECT doc_id, ord, line FROM ({S.LINES}) WHERE line IS NOT NULL AND line <> ''")
def nonempty_text(spark, d):
    return V.lines(spark, d).filter(has_text(F.col("line")))


@query("q_dated_chunks", f"SELECT patient_id, '[session ' || strftime(session_date, '%Y-%m-%d') || ']' || chr(10) || text AS chunk FROM {S.SESSIONS}")
def dated_chunks(spark, d):
    return V.sessions(spark, d).select("patient_id", dated("session", F.col("session_date"), F.col("text")).alias("chunk"))


@query("q_date_num", f"SELECT patient_id, CAST(strftime(session_date, '%Y%m%d') AS INTEGER) AS date_num FROM {S.SESSIONS}")
def date_num(spark, d):
    return V.sessions(spark, d).select("patient_id", day_number(F.col("session_date")).alias("date_num"))


@query("q_vector_ids", f"SELECT {_IDS.format('session')} AS id, text FROM {S.SESSIONS}")
def vector_ids(spark, d):
    return V.sessions(spark, d).select(F.concat_ws("_", F.col("patient_id").cast("string"), F.lit("session"), F.date_format("session_date", "yyyy-MM-dd")).alias("id"), "text")


@query("q_path_parts", "SELECT page_id, string_split(url, '/')[-1] AS name, string_split(url, '/')[-2] AS folder FROM pages")
def path_parts(spark, d):
    return V.table(spark, d, "pages").select("page_id", basename(F.col("url")).alias("name"), folder(F.col("url")).alias("folder"))


@query("q_classify_prefix", "SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'mobile' WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%' THEN 'plain' END AS kind FROM pages")
def classify_prefix(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", F.when(u.startswith("https://m."), "mobile").when(u.startswith("https://"), "secure").when(u.startswith("http://"), "plain").alias("kind"))


@query("q_context_concat", f"SELECT patient_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY session_date, seq) AS context FROM {S.SESSIONS} GROUP BY patient_id")
def context_concat(spark, d):
    return V.sessions(spark, d).groupBy("patient_id").agg(ordered_concat(F.col("text"), ["session_date", "seq"], "\n---\n").alias("context"))


@query("q_next_number", "SELECT CAST(coalesce(max(CAST(nullif(regexp_extract(c_name, '^Customer#0*(\\d+)', 1), '') AS BIGINT)), 0) + 1 AS BIGINT) AS next FROM customer")
def next_number(spark, d):
    names = V.table(spark, d, "customer").select(F.regexp_replace("c_name", "#0*", "_").alias("name"))
    return store.numbered_names(names, "Customer")


@query("q_first_root", "SELECT string_split(url, '/')[-2] AS folder, min(url) FILTER (url LIKE 'https://%') AS secure, coalesce(min(url) FILTER (url LIKE 'https://%'), min(url) FILTER (url LIKE 'http://%')) AS path FROM pages GROUP BY 1")
def first_root(spark, d):
    files = V.table(spark, d, "pages").select(F.col("url").alias("path"), folder(F.col("url")).alias("folder"))
    secure = R.first_root(files, ["https://"]).withColumnRenamed("path", "secure")
    return R.first_root(files, ["https://", "http://"]).join(secure, "folder", "left")


@query("q_relative_path", "SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN substr(url, 11) WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS label FROM pages")
def relative_path(spark, d):
    url = F.regexp_replace("url", "^https://m\\.", "https://m/")
    label = relative_to(url, ["https://m/", "http:/"])
    return V.table(spark, d, "pages").select("page_id", F.regexp_replace(label, "^/", "").alias("label"))


@query("q_sync_subjects", "SELECT DISTINCT source AS folder FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def sync_subjects(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select(F.col("source").alias("folder")).distinct().join(docs.filter("doc_id % 97 = 0").select(F.col("source").alias("folder")).distinct(), "folder", "left_anti")


def _streamed(spark, d, name: str):
    schema = V.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(d)


@query("q_stream_upsert", f"SELECT patient_id, session_date, text, seq FROM {S.SESSIONS}")
def stream_upsert(spark, d):
    """The same upsert by micro-batches into a versioned table."""
    rows = _streamed(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("session_date"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("seq"))
    root = work_folder(spark, "stream")
    target = store.VersionedTable(spark, f"{root}/table")
    ingest.merge_stream(rows, target, ["patient_id", "session_date"], ["seq"], f"{root}/log").awaitTermination()
    return target.read()


@query("q_stream_counts", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    """Counts by day and type of an event stream, with a watermark."""
    rows = _streamed(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    root = work_folder(spark, "counts")
    target = store.VersionedTable(spark, f"{root}/table")
    ingest.merge_counts(rows, target, "ts", "event_type", f"{root}/log").awaitTermination()
    return target.read().select(F.col("start").cast("date").alias("day"), "event_type", "n")
