"""The engine's views in plain SQL, for the oracles."""

SESSIONS_RAW = "SELECT o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS session_date, o_orderpriority AS text, o_orderkey AS seq FROM orders"
GOALS_RAW = "SELECT o_custkey AS patient_id, CAST(l_shipdate AS DATE) AS session_date, l_returnflag AS text, l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
FINDINGS = """SELECT user_id AS patient_id, CAST(ts AS DATE) AS session_date, event_type AS domain, CASE WHEN event_type IN ('click', 'view') THEN 'engagement' END AS parent_domain,
  props AS text, event_id AS seq, 'file' || CAST(event_id % 50 AS VARCHAR) AS source FROM events"""
LINES = "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
TEMPLATE = "CASE lang WHEN 'en' THEN 'diagnosis' WHEN 'de' THEN 'clinic_visit_summary' ELSE 'treatment_plan' END"
SECTIONS_RAW = f"""SELECT source AS patient_id, {TEMPLATE} AS template, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS session_date, 's' || CAST(ord AS VARCHAR) AS section, line AS text,
  'doc' || CAST(doc_id AS VARCHAR) AS source_file, doc_id AS seq FROM (SELECT d.*, x.ord, x.line FROM documents d JOIN ({LINES}) x ON d.doc_id = x.doc_id)"""
ATTRIBUTES = """SELECT c_custkey AS patient_id, 'display_name' AS field_name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer"""
VECTORS = """SELECT vec_id, CAST(label AS BIGINT) AS patient_id, DATE '2024-01-01' + CAST(vec_id % 365 AS INTEGER) AS session_date,
  CASE WHEN vec_id % 2 = 0 THEN 'session_summary' ELSE 'goals_row' END AS chunk_type, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"""
_K = "(conv_id * 31 + turn)"
PARAMS = f"""SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS query_id, {_K} % 150 AS patient_id,
  (['summarize', 'find_specific', 'check_domain', 'compare_progress', 'other'])[CAST({_K} % 5 + 1 AS INTEGER)] AS intent,
  (['diagnosis', 'clinic_visit_summary', 'treatment_plan', NULL])[CAST({_K} % 4 + 1 AS INTEGER)] AS template,
  CASE WHEN {_K} % 3 = 0 THEN ' "' || (['click', 'view', 'engagement', 'purchase', 'signup', 'search', 'none'])[CAST({_K} % 7 + 1 AS INTEGER)] || '", '
       WHEN {_K} % 3 = 1 THEN string_split(text, ' ')[1] END AS topic,
  CASE WHEN {_K} % 2 = 0 THEN DATE '1995-01-01' + CAST({_K} % 1500 AS INTEGER) END AS date_from,
  CASE WHEN {_K} % 7 = 0 THEN CAST({_K} % 12 + 1 AS INTEGER) END AS session_limit, CASE WHEN {_K} % 4 = 0 THEN DATE '1995-01-01' + CAST({_K} % 1500 + 400 AS INTEGER) END AS date_to FROM conversations WHERE role = 'user'"""


def last_write(view: str, keys: str, order: str) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({view})) WHERE rn = 1)"


SESSIONS = last_write(SESSIONS_RAW, "patient_id, session_date", "seq DESC")
GOALS = last_write(GOALS_RAW, "patient_id, session_date", "orderkey DESC, line DESC, text DESC")
SECTIONS = last_write(SECTIONS_RAW, "patient_id, template, session_date, section", "seq DESC")
PATIENT_SECTIONS = f"(SELECT * REPLACE (CAST(regexp_extract(patient_id, '[0-9]+') AS BIGINT) AS patient_id) FROM {SECTIONS})"
SESSION_VECTORS = f"(SELECT v.vec_id, v.chunk_type, v.embedding, s.patient_id, s.session_date FROM ({VECTORS}) v JOIN {SESSIONS} s ON s.seq = v.vec_id * 3)"
