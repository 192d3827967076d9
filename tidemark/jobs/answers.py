"""From questions to judged answers in one job: extract, route, retrieve, prompt, answer, restore, judge.

Each row carries its own state: how often a model was asked for its parameters, and a status that tells
where it ended: ``extraction_failed``, ``no_results``, ``no_before``, ``no_after``, ``error`` or ``ok``. An
error of one row stops no other.

Defined results: a question that is null or empty is asked like any other; questions with equal
query_id are one, the first by text; a parameter that is missing or empty is null, a missing intent is
``find_specific``; an answer that is no JSON object, or whose session_count is no number, is asked for once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.session import saved, work_folder
from tidemark.functions.text import ordered_concat
from tidemark.operators import boundary, deid, retrieve as R, route

#: Prompts for parameters, first and second attempt; {today} and {question} are filled in.
EXTRACT = "Today is {today}. Give intent, date_from, date_to, template_type, topic and session_count of this question as one JSON object.\n{question}"
AGAIN = "Today is {today}. The last answer was not a JSON object. Give nothing but the object with intent, date_from, date_to, template_type, topic and session_count.\n{question}"
SEPARATOR = "\n---\n"


def ground_truth(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Questions with patient_id and expected_answer from JSON: a list in each file, or (not ``whole_files``) an object in each line."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("query_id", "question", "patient_id", "expected_answer")])
    return spark.read.schema(schema).option("multiLine", whole_files).json(path)


def params_of(answer: Column) -> Column:
    """The parameters that an answer holds, with defaults; null if it must be asked for again."""
    p = route.parse_params(answer)
    text = lambda name: F.when(p[name] != "", p[name])
    count, day = text("session_count"), lambda name: F.try_to_date(text(name), "yyyy-MM-dd")
    # 0 is no limit, as if none were given
    limit = F.when(count.rlike(r"^\s*\d{1,9}\s*$") & (F.trim(count).cast("int") > 0), F.trim(count).cast("int"))
    ok = p.isNotNull() & (count.isNull() | count.rlike(r"^\s*\d{1,9}\s*$"))
    fields = [F.coalesce(p["intent"], F.lit("find_specific")).alias("intent"), day("date_from").alias("date_from"), day("date_to").alias("date_to"), text("template_type").alias("template"), text("topic").alias("topic"), limit.alias("session_limit")]
    return F.when(ok, F.struct(*fields))


def _filled(template: str, question: Column, today: str) -> Column:
    return F.replace(F.lit(template.replace("{today}", today)), F.lit("{question}"), F.coalesce(question, F.lit("")))


def extracted(questions: DataFrame, factory: boundary.Factory, today: str, first: str = EXTRACT, again: str = AGAIN) -> DataFrame:
    """``questions`` (query_id, question, ...) with ``params`` (null: both attempts failed) and ``attempts``."""
    rows = questions.groupBy("query_id").agg(F.min(F.struct("question", *[c for c in questions.columns if c not in ("query_id", "question")])).alias("_q")).select("query_id", "_q.*")

    def ask(of: DataFrame, template: str, n: int) -> DataFrame:
        told = boundary.answers(of.withColumn("_prompt", _filled(template, F.col("question"), today)), factory, "_prompt")
        return saved(told.withColumn("params", params_of(F.col("answer"))).withColumn("attempts", F.lit(n)).drop("_prompt", "answer", "status"), "extracted")

    one = ask(rows, first, 1)
    two = ask(one.filter("params is null").drop("params", "attempts"), again, 2)
    return one.filter("params is not null").unionByName(two)


def answered(
    questions: DataFrame, extract: boundary.Factory, answer: boundary.Factory, judge: boundary.Factory, today: str, find: Callable[[DataFrame], DataFrame], domains: list[str], prompts: dict[str, str], reid: DataFrame | None = None
) -> DataFrame:
    """``query_id, attempts, strategy, status, answer, scores`` of ``questions`` (query_id, question, patient_id, expected_answer).

    ``find`` gives the context (query_id, side, session_date, text) of routed questions; ``prompts``: a template for each
    kind with {context}, {before}, {after} and {question}. Tokens in answers are replaced by the values in ``reid``.
    """
    asked = extracted(questions, extract, today)
    known = asked.filter("params is not null").select("query_id", "question", "patient_id", "attempts", "params.*")
    routed = saved(route.prompt_kind(route.route(known, domains)), "routed")
    rows = saved(find(routed), "context")
    state = R.outcomes(routed, rows)
    joined = rows.groupBy("query_id").agg(*[ordered_concat(F.when(cond, F.col("text")), ["session_date", "side"], SEPARATOR).alias(name) for name, cond in (("context", F.lit(True)), ("before", F.col("side") == "before"), ("after", F.col("side") == "after"))])
    text = F.coalesce(*[F.when(F.col("prompt") == kind, F.lit(t)) for kind, t in prompts.items()])
    for name in ("before", "after", "context", "question"):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(name, F.lit("")))
    ready = state.join(joined, "query_id", "left").withColumn("_text", text).select("query_id", "strategy", F.col("status").alias("found"), "_text")
    told = boundary.answers(ready.filter("found = 'ok'"), answer, "_text").select("query_id", "strategy", "answer", F.col("status").alias("status"))
    told = saved(told.unionByName(ready.filter("found <> 'ok'").select("query_id", "strategy", F.lit(None).cast("string").alias("answer"), F.col("found").alias("status"))), "answers")
    if reid is not None:
        shown = deid.reidentify(told.filter("answer is not null").select(F.col("query_id").alias("doc_id"), F.col("answer").alias("text")), reid)
        told = told.drop("answer").join(shown.select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer")), "query_id", "left")
    out = asked.select("query_id", "question", "expected_answer", "attempts").join(told, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("extraction_failed")))
    out = out.withColumn("_prompt", F.to_json(F.struct("question", F.coalesce("answer", F.concat(F.lit("["), F.col("status"), F.lit("]"))).alias("answer"), "expected_answer")))
    judged = boundary.answers(out.withColumnRenamed("answer", "_given").withColumnRenamed("status", "_status"), judge, "_prompt")
    return judged.select("query_id", "attempts", "strategy", F.col("_status").alias("status"), F.col("_given").alias("answer"), boundary.scores(F.col("answer")).alias("scores"))


def results(rows: DataFrame, path: str) -> DataFrame:
    """Judged answers written as JSON lines, and read back."""
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


# Stand-ins for models, which are remote


def stand_in_params():
    """Parameters that follow from a question's number, in a fence; some answers are no JSON at first, some never."""
    import datetime
    import json

    intents, templates = ["summarize", "find_specific", "check_domain", "compare_progress", "other"], ["diagnosis", "clinic_visit_summary", "treatment_plan", ""]
    topics = ["click", "view", "engagement", "purchase", "signup", "search", "none"]
    day = lambda n: str(datetime.date(1995, 1, 1) + datetime.timedelta(n))

    def answer(prompts):
        out = []
        for prompt in prompts:
            name, _, text = prompt.split("\n", 1)[1].partition("|")
            conv, turn = name.split("_")
            k = int(conv) * 31 + int(turn)
            told = {"intent": intents[k % 5], "template_type": templates[k % 4], "topic": f' "{topics[k % 7]}", ' if k % 3 == 0 else text.split(" ")[0] if k % 3 == 1 else None, "date_from": day(k % 1500) if k % 2 == 0 else "", "date_to": day(k % 1500 + 400) if k % 4 == 0 else None, "session_count": k % 12 + 1 if k % 7 == 0 else 0}
            if k % 5 == 1:
                del told["intent"]
            lost = k % 11 == 0 or (k % 3 == 0 and "not a JSON" not in prompt)
            out.append("no idea" if lost else f"```json\n{json.dumps(told)}\n```")
        return out

    return answer


def stand_in_answer():
    """The prompt's first line and its length."""
    return lambda prompts: [f"{p.split(chr(10), 1)[0]}|{len(p)}" for p in prompts]


def stand_in_judge():
    """Scores that follow from the answer's length; none that fit for some."""
    import json

    def judge(prompts):
        n = [len(json.loads(p)["answer"]) for p in prompts]
        return [json.dumps({"relevance": k % 5 + 1, "faithfulness": k % 7, "completeness": 5, "fluency": 1}) for k in n]

    return judge


#: What the prompts of the stand-ins hold.
PROMPTS = {"compare": "compare\n{before}\n===\n{after}\n{question}"} | {k: f"{k}\n{{context}}\n{{question}}" for k in ("trend", "domain", "document", "summarize", "specific")}


def report(spark: SparkSession, questions: DataFrame, find, domains) -> DataFrame:
    """All of it with stand-ins: questions as a file of JSON, results as another."""
    root = work_folder(spark, "answers")
    questions.write.json(f"{root}/questions")
    asked = ground_truth(spark, f"{root}/questions", whole_files=False)
    rows = answered(asked, stand_in_params, stand_in_answer, stand_in_judge, "2025-01-01", find, domains, PROMPTS)
    return results(rows, f"{root}/results")
