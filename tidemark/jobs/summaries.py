"""Summaries of patients by a model, written as Word files in the form of a skeleton, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.session import saved, work_folder
from tidemark.functions.text import ordered_concat
from tidemark.functions.vocab import FINDINGS, SECTIONS
from tidemark.jobs import views_sql as S
from tidemark.operators import boundary, parse, route
from tidemark.sources import skeleton, views as V

QUERIES: dict = {}
ORACLES: dict = {}
#: The prompt of a summary: {base}, {sessions} and {goals} are filled in.
PROMPT = "Rewrite the sections of this document as one JSON object, domains as a JSON object under the key domains.\n{base}\n---\n{sessions}\n---\n{goals}"
KEYS = list(dict.fromkeys(k for _, k in SECTIONS))


def generated(bases: DataFrame, sessions: DataFrame, goals: DataFrame, model: boundary.Factory, keys: list[str] = KEYS, prompt: str = PROMPT) -> DataFrame:
    """``(doc_id, sections, domains, status)`` for each of ``bases`` (doc_id, patient_id, base); status is ok, no_sessions, error or unparsed.

    ``base``: the document's sections as JSON. Sessions and goals (patient_id, session_date, text) are told in order of their dates.
    """
    told = lambda rows, name: rows.groupBy("patient_id").agg(ordered_concat(F.col("text"), ["session_date"], "\n").alias(name))
    rows = bases.join(told(sessions, "sessions"), "patient_id", "left").join(told(goals, "goals"), "patient_id", "left")
    text: Column = F.lit(prompt)
    for name in ("base", "sessions", "goals"):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(name, F.lit("")))
    asked = rows.filter("sessions <> ''").select("doc_id", text.alias("prompt"))
    got = saved(boundary.answers(asked, model), "generated")
    sections, domains = route.parse_generated(F.col("answer"), keys), F.from_json(F.get_json_object(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "$.domains"), "map<string,string>")
    got = got.select("doc_id", sections.alias("sections"), domains.alias("domains"), F.col("status").alias("said"))
    out = rows.select("doc_id").join(got, "doc_id", "left")
    status = F.when(F.col("said").isNull(), "no_sessions").when(F.col("said") == "error", "error").when(F.col("sections").isNull(), "unparsed").otherwise("ok")
    return out.select("doc_id", "sections", "domains", status.alias("status"))


def stand_in_summary():
    """Sections that follow from the prompt: its lines, and how long its parts are; no JSON for some."""
    import json

    def answer(prompts):
        out = []
        for prompt in prompts:
            base, sessions, goals = prompt.split("\n", 1)[1].split("\n---\n")
            told = {KEYS[0]: f"{base}\n\n of {len(sessions)} ", KEYS[3]: str(len(goals)), "domains": {"שטף": str(len(sessions)), "הבנת שפה": "a\nb"}}
            out.append("none" if base.endswith("7") else "Here:\n" + json.dumps(told, ensure_ascii=False))
        return out

    return answer


def _skeleton() -> bytes:
    """A small file with the headings of all sections, a body for some, and a signature."""
    import io

    from tidemark.sources import docx

    to = io.BytesIO()
    names = {k: h for h, k in reversed(SECTIONS)}
    lines = [("הנדון: x", False)]
    for key in KEYS:
        lines += [(f"{names[key]}:", True), ("old", False)]
    docx.write(to, [*lines, ("בברכה", False), ("end", False)])
    return to.getvalue()


_OF = lambda view: f"(SELECT patient_id, CAST(coalesce(string_agg(text, chr(10) ORDER BY session_date, text), '') AS VARCHAR) AS told FROM {view} GROUP BY patient_id)"
ORACLES["q_summaries"] = f"""WITH b AS (SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS base, length(s.told) AS n, length(coalesce(g.told, '')) AS m, s.told IS NOT NULL AND s.told <> '' AS has FROM customer LEFT JOIN {_OF(S.SESSIONS)} s ON s.patient_id = c_custkey LEFT JOIN {_OF(S.GOALS)} g ON g.patient_id = c_custkey),
  o AS (SELECT *, CASE WHEN NOT has THEN 'no_sessions' WHEN base LIKE '%7' THEN 'unparsed' ELSE 'ok' END AS status FROM b)
  SELECT doc_id, status, '{KEYS[0]}' AS section, base || chr(10) || 'of ' || n AS text FROM o WHERE status = 'ok' UNION ALL SELECT doc_id, status, '{KEYS[3]}', CAST(m AS VARCHAR) FROM o WHERE status = 'ok'
  UNION ALL SELECT doc_id, status, 'הבנת שפה', 'a' || chr(10) || 'b' FROM o WHERE status = 'ok' UNION ALL SELECT doc_id, status, 'שטף', CAST(n AS VARCHAR) FROM o WHERE status = 'ok' UNION ALL SELECT doc_id, status, NULL, NULL FROM o WHERE status <> 'ok'"""


def summaries(spark, d) -> DataFrame:
    """Every customer's summary from orders and goals, written as a Word file each, and the sections that the files hold."""
    bases = V.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("patient_id"), F.col("c_custkey").cast("string").alias("base"))
    told = saved(generated(bases, V.sessions(spark, d).select("patient_id", "session_date", "text"), V.goals(spark, d).select("patient_id", "session_date", "text"), stand_in_summary), "summaries")
    root = work_folder(spark, "files")
    rows = told.filter("status = 'ok'").select("doc_id", F.concat(F.lit("summary_"), "doc_id", F.lit(".docx")).alias("name"), F.lit(bytearray(_skeleton())).alias("skeleton"), F.map_filter("sections", lambda _, v: v != "").alias("sections"), "domains")
    manifest = skeleton.write(rows, root, drop=[KEYS[4]])
    back = skeleton.read(manifest, root).select("doc_id", F.posexplode("paragraphs").alias("ord", "line"))
    lines = parse.classify(back)
    found = parse.section_texts(lines).select("doc_id", "section", "text").unionByName(parse.domain_texts(lines).select("doc_id", F.col("domain").alias("section"), "text"))
    found = found.filter((F.col("text") != "old") & (F.col("section") != FINDINGS))
    return told.select("doc_id", "status").join(found, "doc_id", "left").select("doc_id", "status", "section", "text")


QUERIES["q_summaries"] = summaries
