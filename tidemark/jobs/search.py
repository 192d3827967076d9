"""Queries on vectors, routing and batched retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.session import saved
from tidemark.functions.text import has_text
from tidemark.jobs import views_sql as S
from tidemark.operators import retrieve as R, route, vector
from tidemark.operators.cells import CellIndex
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


_SCORE = "round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.embedding, lambda x: x * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x * x)))), 6)"


def _first_vector(vectors):
    return list(vectors.orderBy("vec_id").first()["embedding"])


@query("q_vector_topk", f"SELECT v.vec_id, v.patient_id, v.session_date, v.chunk_type, {_SCORE} AS score FROM ({S.VECTORS}) v, (SELECT embedding FROM ({S.VECTORS}) ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, v.vec_id LIMIT 10")
def vector_topk(spark, d):
    v = V.vectors(spark, d)
    return vector.top_k(v, _first_vector(v))


@query("q_vector_topk_filtered", f"""SELECT v.vec_id, v.patient_id, v.session_date, v.chunk_type, {_SCORE} AS score FROM ({S.VECTORS}) v, (SELECT embedding FROM ({S.VECTORS}) ORDER BY vec_id LIMIT 1) q
  WHERE v.patient_id = 3 AND v.session_date >= DATE '2024-02-01' ORDER BY score DESC, v.vec_id LIMIT 10""")
def vector_topk_filtered(spark, d):
    v = V.vectors(spark, d)
    return vector.top_k(v, _first_vector(v), where=(F.col("patient_id") == 3) & R.in_range(F.col("session_date"), "2024-02-01"))


@query("q_vector_topk_batch", f"""SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_SCORE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE} DESC, v.vec_id) AS rank
  FROM ({S.VECTORS}) v JOIN ({S.VECTORS}) q ON v.patient_id = q.patient_id AND v.session_date >= q.session_date WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def vector_topk_batch(spark, d):
    v = V.vectors(spark, d)
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "patient_id", F.col("session_date").alias("date_from"), F.lit(None).cast("date").alias("date_to"), F.col("embedding").alias("query"))
    return vector.top_k_batch(v, queries)


@query("q_vector_topk_pruned", f"""SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_SCORE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE} DESC, v.vec_id) AS rank
  FROM ({S.VECTORS}) v JOIN ({S.VECTORS}) q ON v.chunk_type = q.chunk_type AND v.session_date BETWEEN q.session_date - 60 AND q.session_date + 60 WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def vector_topk_pruned(spark, d):
    v = V.vectors(spark, d)
    day = F.col("session_date")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "chunk_type", F.date_sub(day, 60).alias("date_from"), F.date_add(day, 60).alias("date_to"), F.col("embedding").alias("query"))
    return CellIndex.build(v, ["chunk_type"], k=16).top_k(queries).hits


TOPICS = ["click", "view", "engagement", "purchase", "signup", "search"]
_DOC = "coalesce(template IN ('diagnosis', 'clinic_visit_summary'), false)"
_PLAIN = "trim(trim(topic), ' \",.:;''')"
_IN = f"coalesce({_PLAIN} IN ({', '.join(repr(t) for t in TOPICS)}), false)"
_ROUTED = f"""SELECT *, CASE WHEN intent = 'check_domain' AND {_IN} THEN {_PLAIN} ELSE topic END AS used_topic, CASE
  WHEN intent = 'summarize' THEN CASE WHEN {_DOC} THEN 'documents' ELSE 'sessions' END
  WHEN intent = 'compare_progress' THEN CASE WHEN date_from IS NULL THEN 'sessions' ELSE 'compare' END
  WHEN intent = 'check_domain' THEN CASE WHEN {_IN} THEN 'domain' ELSE 'vectors' END
  WHEN intent = 'find_specific' THEN CASE WHEN {_DOC} THEN 'documents' WHEN topic IS NOT NULL AND topic <> '' THEN 'vectors' ELSE 'sessions' END
  ELSE 'vectors' END AS strategy FROM ({S.PARAMS})"""


def routed(spark, d):
    return route.route(V.params(spark, d), TOPICS)


@query("q_route", f"SELECT query_id, intent, strategy, used_topic FROM ({_ROUTED})")
def q_route(spark, d):
    return routed(spark, d).select("query_id", "intent", "strategy", "used_topic")


@query("q_prompt_kind", f"""SELECT query_id, CASE WHEN strategy = 'compare' THEN 'compare' WHEN intent = 'compare_progress' THEN 'trend' WHEN strategy = 'domain' THEN 'domain' WHEN strategy = 'documents' THEN 'document'
  WHEN intent = 'summarize' THEN 'summarize' ELSE 'specific' END AS prompt FROM ({_ROUTED})""")
def q_prompt_kind(spark, d):
    return route.prompt_kind(routed(spark, d)).select("query_id", "prompt")


_WITHIN = "(q.date_from IS NULL OR {0}.session_date >= q.date_from) AND (q.date_to IS NULL OR {0}.session_date <= q.date_to)"
#: A query's vector is that of the session its number picks.
_ASKED = f"(SELECT q.*, v.embedding AS query FROM (SELECT *, CAST(string_split(query_id, '_')[1] AS BIGINT) % 100 AS pick FROM ({_ROUTED})) q JOIN ({S.VECTORS}) v ON v.vec_id = q.pick)"
_SHORT = f"(SELECT q.query_id, s.session_date, s.text, row_number() OVER (PARTITION BY q.query_id ORDER BY s.session_date DESC, s.seq DESC) AS rn, q.session_limit, q.strategy FROM ({_ROUTED}) q JOIN {S.SESSIONS} s ON s.patient_id = q.patient_id WHERE q.session_limit IS NOT NULL)"
_RETRIEVED = f"""WITH q AS MATERIALIZED {_ASKED}, s AS MATERIALIZED {S.SESSIONS}, f AS MATERIALIZED ({S.FINDINGS}), x AS MATERIALIZED {S.PATIENT_SECTIONS}, v AS MATERIALIZED {S.SESSION_VECTORS}, short AS MATERIALIZED (SELECT * FROM {_SHORT} WHERE rn <= session_limit),
  own AS (SELECT q.query_id, q.patient_id, x.session_date, x.text, max(x.session_date) OVER (PARTITION BY q.query_id) AS last, q.session_limit IS NOT NULL OR q.date_from IS NULL AS newest, {_WITHIN.format('x')} AS inside FROM q JOIN x ON x.patient_id = q.patient_id AND x.template = q.template WHERE q.strategy = 'documents'),
  doc AS (SELECT * FROM own WHERE CASE WHEN newest THEN session_date = last ELSE inside END),
  dom AS (SELECT q.query_id, f.session_date, f.text FROM q JOIN f ON f.patient_id = q.patient_id AND (f.domain = q.used_topic OR f.parent_domain = q.used_topic) WHERE q.strategy = 'domain' AND f.text <> ''),
  semantic AS (SELECT q.query_id, q.patient_id, q.query, coalesce(r.low, q.date_from) AS date_from, coalesce(r.high, q.date_to) AS date_to FROM q LEFT JOIN (SELECT query_id, min(session_date) AS low, max(session_date) AS high FROM short GROUP BY query_id) r ON r.query_id = q.query_id
    WHERE q.strategy = 'vectors' OR (q.strategy = 'domain' AND q.query_id NOT IN (SELECT query_id FROM dom))),
  near AS (SELECT q.query_id, v.vec_id, v.patient_id, v.session_date, v.chunk_type, row_number() OVER (PARTITION BY q.query_id ORDER BY {_SCORE.replace('q.embedding', 'q.query')} DESC, v.vec_id) AS rank FROM semantic q JOIN v ON v.patient_id = q.patient_id AND {_WITHIN.format('v')}),
  hit AS (SELECT * FROM near WHERE rank <= 10)
  SELECT query_id, 'session' AS side, session_date, text FROM short WHERE strategy = 'sessions'
  UNION ALL SELECT q.query_id, 'session', s.session_date, s.text FROM q JOIN s ON s.patient_id = q.patient_id AND {_WITHIN.format('s')} WHERE q.strategy = 'sessions' AND q.session_limit IS NULL
  UNION ALL SELECT q.query_id, CASE WHEN s.session_date < q.date_from THEN 'before' ELSE 'after' END, s.session_date, s.text FROM q JOIN s ON s.patient_id = q.patient_id WHERE q.strategy = 'compare'
  UNION ALL SELECT query_id, 'document', session_date, text FROM doc WHERE text <> ''
  UNION ALL SELECT d.query_id, 'finding', f.session_date, f.text FROM (SELECT DISTINCT query_id, patient_id, session_date FROM doc) d JOIN f ON f.patient_id = d.patient_id AND f.session_date = d.session_date WHERE f.text <> ''
  UNION ALL SELECT query_id, 'domain', session_date, text FROM dom
  UNION ALL SELECT h.query_id, 'vector', h.session_date, s.text FROM hit h JOIN s ON s.patient_id = h.patient_id AND s.session_date = h.session_date WHERE h.chunk_type = 'session_summary'
  UNION ALL SELECT h.query_id, 'vector', h.session_date, g.text FROM hit h ASOF JOIN {S.GOALS} g ON h.patient_id = g.patient_id AND h.session_date >= g.session_date WHERE h.chunk_type = 'goals_row' AND g.text IS NOT NULL"""


def asked(spark, d):
    v = V.vectors(spark, d).select(F.col("vec_id").alias("_pick"), F.col("embedding").alias("query"))
    pick = F.get(F.split("query_id", "_"), F.lit(0)).cast("long") % 100
    return routed(spark, d).withColumn("_pick", pick).join(v, "_pick").drop("_pick")


def retrieved(spark, d, q):
    """All questions at once, one plan for each of the five strategies, whatever their number.

    Each view is written once, the rows of patients with a question alone.
    """
    q = saved(q, "asked")
    patients = saved(q.select("patient_id").distinct(), "patients")
    own = lambda view, name: saved(view.join(patients, "patient_id", "left_semi"), name)
    sessions, findings, goals = own(V.sessions(spark, d), "sessions"), own(V.findings(spark, d), "findings"), own(V.goals(spark, d), "goals")
    of = lambda name: q.filter(F.col("strategy") == name)
    one = R.sessions_for(of("sessions"), sessions).filter(has_text(F.col("text"))).select("query_id", F.lit("session").alias("side"), "session_date", "text")
    both = of("compare").select("query_id", "patient_id", "date_from").join(sessions, "patient_id")
    two = R.compare_split(both, F.col("date_from")).select("query_id", "side", "session_date", "text")
    three = R.documents_for(of("documents"), own(V.patient_sections(spark, d), "sections"), findings)
    four, rest = R.domains_for(of("domain"), findings)
    five = R.vectors_for(of("vectors").unionByName(rest.select(q.columns)), own(V.session_vectors(spark, d), "vectors"), sessions, goals)
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)


@query("q_retrieve_all", _RETRIEVED)
def q_retrieve_all(spark, d):
    return retrieved(spark, d, asked(spark, d))


@query("q_retrieve_status", f"""SELECT q.query_id, q.strategy, CASE WHEN count(r.side) = 0 THEN 'no_results' WHEN q.strategy = 'compare' AND count(*) FILTER (r.side = 'before') = 0 THEN 'no_before'
  WHEN q.strategy = 'compare' AND count(*) FILTER (r.side = 'after') = 0 THEN 'no_after' ELSE 'ok' END AS status FROM {_ASKED} q LEFT JOIN ({_RETRIEVED}) r ON r.query_id = q.query_id GROUP BY q.query_id, q.strategy""")
def q_retrieve_status(spark, d):
    q = asked(spark, d)
    return R.outcomes(q, retrieved(spark, d, q)).select("query_id", "strategy", "status")


@query("q_topic_vectors", f"""SELECT query_id, CASE WHEN trim(coalesce(used_topic, '')) = '' THEN 'empty_topic' ELSE 'ok' END AS status, CASE WHEN trim(coalesce(used_topic, '')) = '' THEN 0 ELSE 16 END AS size FROM ({_ROUTED}) WHERE strategy = 'vectors'""")
def q_topic_vectors(spark, d):
    """Questions that are searched for by their topic, and those without one."""
    from tidemark.operators import boundary

    rows = R.with_topic_vectors(routed(spark, d).filter("strategy = 'vectors'"), boundary.hashing_embedder(16))
    return rows.select("query_id", "status", F.coalesce(F.size("query"), F.lit(0)).alias("size"))


@query("q_fallback_sessions", f"SELECT q.query_id, 'session' AS side, s.session_date, s.text FROM ({_ROUTED}) q JOIN {S.SESSIONS} s ON s.patient_id = q.patient_id AND {_WITHIN.format('s')} WHERE q.strategy = 'vectors' AND s.text <> ''")
def q_fallback_sessions(spark, d):
    """Without an index, questions that vectors should answer get all sessions within their dates."""
    return R.vectors_for(routed(spark, d).filter("strategy = 'vectors'"), None, V.sessions(spark, d), V.goals(spark, d))


_BY = lambda cond: f"coalesce(string_agg(text, '{chr(10)}---{chr(10)}' ORDER BY session_date, side, text) FILTER ({cond}), '')"
_N = "(CAST(string_split(query_id, '_')[1] AS BIGINT) * 31 + CAST(string_split(query_id, '_')[2] AS BIGINT))"


@query("q_answers", f"""WITH asked AS (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS query_id, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
  state AS (SELECT a.query_id, a.query_id || '|' || a.text AS question, {_N} AS k FROM asked a),
  kind AS (SELECT query_id, strategy, CASE WHEN strategy = 'compare' THEN 'compare' WHEN intent = 'compare_progress' THEN 'trend' WHEN strategy = 'domain' THEN 'domain' WHEN strategy = 'documents' THEN 'document' WHEN intent = 'summarize' THEN 'summarize' ELSE 'specific' END AS prompt FROM ({_ROUTED})),
  ctx AS (SELECT query_id, {_BY('true')} AS context, {_BY("side = 'before'")} AS before, {_BY("side = 'after'")} AS after, count(*) FILTER (side = 'before') AS n_before, count(*) FILTER (side = 'after') AS n_after FROM ({_RETRIEVED}) GROUP BY query_id),
  done AS (SELECT s.query_id, s.k, CAST(CASE WHEN k % 3 = 0 OR k % 11 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN k % 11 <> 0 THEN strategy END AS strategy, CASE WHEN k % 11 = 0 THEN 'extraction_failed' WHEN c.query_id IS NULL THEN 'no_results'
    WHEN strategy = 'compare' AND n_before = 0 THEN 'no_before' WHEN strategy = 'compare' AND n_after = 0 THEN 'no_after' ELSE 'ok' END AS status,
    prompt || '|' || CAST(length(prompt || chr(10) || CASE WHEN prompt = 'compare' THEN before || chr(10) || '===' || chr(10) || after ELSE context END || chr(10) || question) AS VARCHAR) AS answer FROM state s LEFT JOIN kind USING (query_id) LEFT JOIN ctx c USING (query_id)),
  said AS (SELECT query_id, attempts, strategy, status, CASE WHEN status = 'ok' THEN answer END AS answer, length(CASE WHEN status = 'ok' THEN answer ELSE '[' || status || ']' END) AS n FROM done)
  SELECT query_id, attempts, strategy, status, answer, CAST(n % 5 + 1 AS INTEGER) AS relevance, CAST(CASE WHEN n % 7 BETWEEN 1 AND 5 THEN n % 7 ELSE 0 END AS INTEGER) AS faithfulness, 5 AS completeness, 1 AS fluency FROM said""")
def q_answers(spark, d):
    """Questions from JSON, their parameters, contexts, answers and scores with stand-ins for the models, written as JSON and read back."""
    from tidemark.jobs import answers

    turns = V.table(spark, d, "conversations").filter("role = 'user'").withColumn("query_id", F.concat_ws("_", "conv_id", "turn")).groupBy("query_id").agg(F.min("text").alias("text"))
    k = F.get(F.split("query_id", "_"), F.lit(0)).cast("long") * 31 + F.get(F.split("query_id", "_"), F.lit(1)).cast("long")
    questions = turns.select("query_id", F.concat_ws("|", "query_id", "text").alias("question"), (k % 150).cast("string").alias("patient_id"), F.lit("x").alias("expected_answer"))

    def find(routed):
        v = V.vectors(spark, d).select(F.col("vec_id").alias("_pick"), F.col("embedding").alias("query"))
        pick = F.get(F.split("query_id", "_"), F.lit(0)).cast("long") % 100
        return retrieved(spark, d, routed.withColumn("patient_id", F.col("patient_id").cast("long")).withColumn("_pick", pick).join(v, "_pick").drop("_pick"))

    return answers.report(spark, questions, find, TOPICS).select("query_id", "attempts", "strategy", "status", "answer", "scores.*")
