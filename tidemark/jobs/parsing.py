"""Queries on parsers: headers, sections, domains, blocks, goal rows, dates, names and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import parse_day
from tidemark.jobs import views_sql as S
from tidemark.functions.vocab import HEADER_B
from tidemark.operators import boundary, parse, route
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


#: The documents' own words stand for headings, domains and signatures here.
SECTIONS = [("The", "background"), ("In", "course"), ("Of", "findings"), ("De", "findings"), ("En", "summary")]
DOMAINS = ["Th", "An", "On", "Er", "Le", "La", "Die", "El"]
PARENTS = {"Th": "An", "On": "An"}
MARK, START = "icense", "Released"
KEYS = ["background", "course", "findings", "summary"]

_STRIP = r"regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')"
_OPENS = f"CASE WHEN contains(line, '{MARK}') OR starts_with(line, '{START}') THEN '#blocked' " + " ".join(f"WHEN starts_with(regexp_replace(line, ':+$', ''), '{h}') THEN '{k}'" for h, k in SECTIONS) + " END"
_NAMED = "CASE " + " ".join(f"WHEN starts_with(line, '{d}') THEN '{d}'" for d in DOMAINS) + " END"
CLASSIFIED = f"""(WITH a AS (SELECT doc_id, ord, {_STRIP} AS line FROM ({S.LINES})), b AS (SELECT *, {_OPENS} AS opens FROM a WHERE line <> ''),
  c AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
    count(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b),
  d AS (SELECT *, CASE WHEN section = 'findings' AND opens IS NULL THEN {_NAMED} END AS opens_domain FROM c),
  e AS (SELECT *, last_value(opens_domain IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS domain FROM d),
  f AS (SELECT *, CASE WHEN opens = '#blocked' THEN 'signature' WHEN opens IS NOT NULL THEN 'heading' WHEN opens_domain IS NOT NULL THEN 'domain' WHEN section IS NULL THEN 'preamble' WHEN section = '#blocked' THEN 'blocked' ELSE 'content' END AS kind,
    regexp_replace(regexp_replace(substr(line, length(opens_domain) + 1), '^\\s*[:\\-–]?\\s*', ''), '\\s+$', '') AS inline FROM e)
  SELECT *, CASE WHEN kind = 'content' THEN line WHEN kind = 'domain' AND inline <> '' THEN inline END AS content FROM f)"""


def classified(spark, d):
    return parse.classify(V.lines(spark, d), SECTIONS, DOMAINS, "findings", MARK, START)


_FIELDS = [("first_the", r"\b[Tt]he (\w+)"), ("mail", r"([a-z0-9.]+@[a-z0-9.]+)"), ("token", r"token = .([0-9a-f]+)")]


@query("q_header_first", "SELECT doc_id, " + ", ".join(f"arg_min(regexp_extract(line, '{p}', 1), ord) FILTER (regexp_extract(line, '{p}', 1) <> '') AS {n}" for n, p in _FIELDS) + f" FROM ({S.LINES}) WHERE ord < 10 GROUP BY doc_id")
def header_first(spark, d):
    return parse.header_fields(V.lines(spark, d), _FIELDS, 10)


@query("q_line_kinds", f"SELECT doc_id, kind, count(*) AS n FROM {CLASSIFIED} GROUP BY doc_id, kind")
def line_kinds(spark, d):
    return classified(spark, d).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_TEXTS = f"SELECT doc_id, section, string_agg(content, chr(10) ORDER BY ord) AS text FROM {CLASSIFIED} WHERE kind = 'content' AND domain IS NULL GROUP BY doc_id, section"


@query("q_sections_ffill", _TEXTS)
def sections_ffill(spark, d):
    return parse.section_texts(classified(spark, d))


@query("q_domains_ffill", f"""SELECT doc_id, domain, coalesce(string_agg(content, chr(10) ORDER BY ord), '') AS text, CASE WHEN domain IN ('Th', 'On') THEN 'An' END AS parent_domain FROM {CLASSIFIED}
  WHERE domain IS NOT NULL AND kind IN ('content', 'domain') AND domain <> 'An' GROUP BY doc_id, domain""")
def domains_ffill(spark, d):
    return parse.domain_texts(classified(spark, d), PARENTS)


@query("q_ordered_domains", f"""SELECT doc_id, string_agg(domain, ',' ORDER BY list_position({DOMAINS!r}, domain)) AS domains FROM (SELECT DISTINCT doc_id, domain FROM {CLASSIFIED} WHERE domain IS NOT NULL) GROUP BY doc_id""")
def ordered_domains(spark, d):
    place = F.array_position(F.array(*[F.lit(x) for x in DOMAINS]), F.col("domain"))
    rows = classified(spark, d).filter("domain is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(place.alias("p"), "domain"))).alias("x"))
    return rows.select("doc_id", F.array_join("x.domain", ",").alias("domains"))


@query("q_section_grid", "SELECT doc_id, " + ", ".join(f"coalesce(max(text) FILTER (section = '{k}'), '') AS {k}" for k in KEYS) + f", count(*) FILTER (text <> '') AS n_filled FROM ({_TEXTS}) GROUP BY doc_id")
def section_grid(spark, d):
    return parse.section_grid(parse.section_texts(classified(spark, d)), KEYS)


@query("q_section_spans", f"""SELECT doc_id, section, min(ord) AS start, arg_min(coalesce(stop, -1), ord) AS stop FROM (SELECT *, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS stop FROM {CLASSIFIED} WHERE opens IS NOT NULL)
  WHERE kind = 'heading' GROUP BY doc_id, section""")
def section_spans(spark, d):
    return parse.section_spans(classified(spark, d)).withColumn("stop", F.coalesce("stop", F.lit(-1).cast("long")))


_MARKED = f"SELECT doc_id, ord, line, starts_with(line, 'The') AS m FROM (SELECT doc_id, ord, {_STRIP} AS line FROM ({S.LINES})) WHERE line <> ''"


@query("q_blocks", f"""SELECT doc_id, block, DATE '2024-01-01' + CAST(block AS INTEGER) AS session_date, string_agg(line, chr(10) ORDER BY ord) AS text FROM
  (SELECT *, count(*) FILTER (m) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM ({_MARKED})) WHERE NOT m AND block > 0 GROUP BY doc_id, block""")
def blocks(spark, d):
    rows = parse.blocks(V.lines(spark, d), F.col("line").startswith("The"), F.lit("2024-01-01").cast("date"))
    return rows.withColumn("session_date", F.date_add("session_date", F.col("block").cast("int")))


@query("q_blocks_fallback", f"SELECT doc_id, CAST(0 AS BIGINT) AS block, DATE '2024-06-01' AS session_date, string_agg(line, chr(10) ORDER BY ord) AS text FROM ({_MARKED}) GROUP BY doc_id")
def blocks_fallback(spark, d):
    return parse.dated_blocks(V.lines(spark, d), F.lit("2024-06-01").cast("date"))


_CELLS = "CASE l_orderkey % 4 WHEN 0 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 1 THEN strftime(l_shipdate, '%d.%m.%Y') WHEN 2 THEN 'date' ELSE '' END"
_CELL1 = "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END"


def _cells(spark, d):
    k = F.col("l_orderkey") % 4
    cell0 = F.when(k == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).when(k == 1, F.date_format("l_shipdate", "dd.MM.yyyy")).when(k == 2, "date").otherwise("")
    return V.table(spark, d, "lineitem").select("l_orderkey", cell0.alias("cell0"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("cell1"))


@query("q_goal_rows", f"SELECT l_orderkey, {_CELL1} AS text, CAST(l_shipdate AS DATE) AS session_date FROM lineitem WHERE l_orderkey % 4 < 2 AND l_linenumber % 3 <> 0")
def goal_rows(spark, d):
    return parse.goal_rows(_cells(spark, d))[0]


@query("q_goal_rejects", f"SELECT l_orderkey, {_CELLS} AS raw_date, {_CELL1} AS text, CASE WHEN l_orderkey % 4 < 2 THEN 'text' ELSE 'date' END AS reason FROM lineitem WHERE NOT (l_orderkey % 4 < 2 AND l_linenumber % 3 <> 0) AND NOT (l_orderkey % 4 = 3 AND l_linenumber % 3 = 0)")
def goal_rejects(spark, d):
    return parse.goal_rows(_cells(spark, d))[1]


@query("q_parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parse_dates(spark, d):
    k, x = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(x, "dd/MM/yyyy")).when(k == 1, F.date_format(x, " d/M/yyyy ")).when(k == 2, F.date_format(x, "dd.MM.yyyy")).when(k == 3, F.date_format(x, "d.M.yyyy")).otherwise(F.date_format(x, "'31'/'02'/yyyy"))
    return V.table(spark, d, "orders").select("o_orderkey", parse_day(raw).alias("parsed"))


@query("q_normalize_topic", f"SELECT query_id, trim(trim(topic), ' \",.:;''') AS topic FROM ({S.PARAMS})")
def normalize_topic(spark, d):
    return V.params(spark, d).select("query_id", route.normalize_topic(F.col("topic")).alias("topic"))


@query("q_parse_params", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS intent, CASE WHEN event_id % 4 < 3 THEN CAST(user_id AS VARCHAR) END AS topic FROM events")
def parse_params(spark, d):
    k = F.col("event_id") % 4
    body = F.to_json(F.struct(F.col("event_type").alias("intent"), F.col("user_id").cast("string").alias("topic")))
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), body)).otherwise("none")
    p = route.parse_params(answer)
    return V.table(spark, d, "events").select("event_id", p["intent"].alias("intent"), p["topic"].alias("topic"))


@query("q_parse_generated", "SELECT event_id, trim(event_type) AS background, '' AS summary FROM events")
def parse_generated(spark, d):
    answer = F.concat(F.lit("Sure.\n"), F.to_json(F.struct(F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("background"), F.col("value").alias("other"))), F.lit("\nDone"))
    m = route.parse_generated(answer, ["background", "summary"])
    return V.table(spark, d, "events").select("event_id", m["background"].alias("background"), m["summary"].alias("summary"))


@query("q_header_iso", "SELECT o_orderkey AS doc_id, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_date FROM orders")
def header_iso(spark, d):
    """Headers of treatment plans made of orders: a name, and a start date in one of two forms or in words."""
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    told = F.when(k == 0, "soon").when(k == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "d.M.yyyy"))
    lines = F.array(F.concat(F.lit("שם: "), "o_orderpriority"), F.lit(""), F.concat(F.lit("תאריך התחלת הטיפול : "), told))
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(lines).alias("ord", "line"))
    return parse.header_b(rows, HEADER_B).select("doc_id", "name", "start_date")


@query("q_judge_averages", "SELECT event_type, " + ", ".join(f"round(avg(CASE WHEN event_id % {n} BETWEEN 1 AND 5 THEN event_id % {n} ELSE 0 END), 6) AS {name}" for name, n in (("relevance", 6), ("faithfulness", 7), ("completeness", 5), ("fluency", 4))) + ", count(*) FILTER (event_id % 6 BETWEEN 1 AND 5 OR event_id % 7 BETWEEN 1 AND 5 OR event_id % 5 > 0 OR event_id % 4 > 0) AS n_judged FROM events GROUP BY event_type")
def judge_averages(spark, d):
    """A judge's answers about events, with scores that are out of range now and then."""
    k = F.col("event_id")
    said = F.concat(F.lit("Scores: "), F.to_json(F.struct((k % 6).alias("relevance"), (k % 7).alias("faithfulness"), (k % 5).alias("completeness"), (k % 4).alias("fluency"))))
    return boundary.averages(V.table(spark, d, "events").select("event_type", boundary.scores(said).alias("scores")), "event_type")
