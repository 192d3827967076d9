"""Rule-based routing of parameter rows to strategies, prompts and retrieval.

Defined results: a null intent goes to vectors, a null topic or template counts as none; equal rows are routed alike; extra
columns come through, whatever their names, but ``strategy``, ``used_topic`` and ``prompt``, which are set anew; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.text import has_text, strip, strip_chars
from tidemark.functions.vocab import DOMAINS, TOPIC_MARKS

DOCUMENTS = ("diagnosis", "clinic_visit_summary")


def normalize_topic(topic: Column) -> Column:
    return strip_chars(strip(topic), TOPIC_MARKS)


def route(params: DataFrame, domains: list[str] = DOMAINS) -> DataFrame:
    """Adds ``strategy`` and the topic that retrieval uses; the given topic stays as it is."""
    intent, template, topic = F.col("intent"), F.col("template"), F.col("topic")
    plain = normalize_topic(topic)
    document = F.coalesce(template.isin(*DOCUMENTS), F.lit(False))
    known = F.coalesce(plain.isin(*domains), F.lit(False))
    strategy = (
        F.when(intent == "summarize", F.when(document, "documents").otherwise("sessions"))
        .when(intent == "compare_progress", F.when(F.col("date_from").isNull(), "sessions").otherwise("compare"))
        .when(intent == "check_domain", F.when(known, "domain").otherwise("vectors"))
        .when(intent == "find_specific", F.when(document, "documents").when(has_text(topic), "vectors").otherwise("sessions"))
        .otherwise("vectors")
    )
    return params.withColumn("strategy", strategy).withColumn("used_topic", F.when((intent == "check_domain") & known, plain).otherwise(topic))


def prompt_kind(routed: DataFrame) -> DataFrame:
    """Which of six prompts a routed question gets, in fixed precedence."""
    s, intent = F.col("strategy"), F.col("intent")
    kind = F.when(s == "compare", "compare").when(intent == "compare_progress", "trend").when(s == "domain", "domain").when(s == "documents", "document")
    return routed.withColumn("prompt", kind.when(intent == "summarize", "summarize").otherwise("specific"))


PARAMS = T.StructType([T.StructField(n, T.StringType()) for n in ("intent", "date_from", "date_to", "template_type", "topic", "session_count")])


def parse_params(answer: Column) -> Column:
    """A model's JSON answer, fenced or not; what does not fit the schema is null."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(body != "", body), PARAMS)


def parse_generated(answer: Column, keys: list[str]) -> Column:
    """The outermost object of an answer as a map of trimmed strings, with '' for missing keys."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(body != "", body), T.MapType(T.StringType(), T.StringType()))
    return F.when(parsed.isNotNull(), F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.coalesce(strip(F.try_element_at(parsed, F.lit(k))), F.lit("")) for k in keys])))
