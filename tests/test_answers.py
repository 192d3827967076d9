"""Tags to spans and questions to answers, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from tidemark.jobs import answers
from tidemark.operators import boundary, tags


def brute_spans(text, tokens):
    out, now = [], None
    for start, end, label in tokens:
        kind = label.replace("_", "-")
        mark, name = (kind[0], kind[2:].replace("PERS", "PER")) if kind[:2] in ("B-", "I-") and kind[2:] else ("O", "")
        if (start, end) == (0, 0) or mark == "O":
            now = None
        elif now is not None and out[now][2] == name and (mark == "I" or not text[out[now][1] : start].strip()):
            out[now] = (out[now][0], end, name)
        else:
            now = len(out)
            out.append((start, end, name))
    return [(a, b, n, text[a:b]) for a, b, n in out]


def test_spans_equal_a_state_machine(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        text = "".join(rng.choice("ab \n.é😀") for _ in range(60))
        cuts = sorted(rng.sample(range(61), rng.choice([0, 2, 10, 20])))
        tokens = [(0, 0, "O"), *[(a, b, rng.choice(["O", "B_PERS", "I-PER", "B-ORG", "I_ORG", "X", "B_PER"])) for a, b in zip(cuts[::2], cuts[1::2])], (0, 0, rng.choice(["O", "B_PERS"]))]
        rows.append((i, text, tokens))

    def model():
        return lambda texts: [next(t for _, x, t in rows if x == text) for text in texts]

    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["label"], s["text"]) for s in r["s"]] for r in tags.tagged(docs, model).select("doc_id", tags.spans(F.col("window"), F.col("tokens")).alias("s")).collect()}
    assert got == {i: brute_spans(text, tokens) for i, text, tokens in rows}
    only = tags.tagged(docs, model).select(F.explode(tags.spans(F.col("window"), F.col("tokens"), ["ORG"])).alias("s")).select("s.label").distinct().collect()
    assert [r[0] for r in only] == ["ORG"]


def test_a_model_gets_bounded_portions_of_text(spark):
    texts = ["ab é" * (60_000 if i == 7 else 500) for i in range(600)]

    def model():
        return lambda some: [[(0, 2, f"B-{sum(len(t.encode()) for t in some)}-{len(some)}")] for _ in some]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = tags.tagged(docs, model).select("doc_id", F.col("tokens")[0]["label"].alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"), F.count("*").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: 1 if len(t) <= 800 else -(-(len(t) - 800) // 650) + 1 for i, t in enumerate(texts)}
    whole = tags.tagged(docs, model, size=1 << 20, overlap=0).select("doc_id", F.col("tokens")[0]["label"].alias("label")).collect()
    asked = {r["doc_id"]: [int(x) for x in r["label"].split("-")[1:]] for r in whole}
    assert len(asked) == 600 and all(size <= tags.PORTION or n == 1 for size, n in asked.values())
    assert all(int(r["label"].split("-")[1]) <= tags.PORTION for r in got)


def test_entities_of_windows_are_told_once(spark):
    text = " ".join(f"w{i}" for i in range(800)) + " Dana Levi " + "x " * 700 + "Dana"

    def model():
        def tag(texts):
            out = []
            for t in texts:
                at, found = 0, []
                for piece in t.split(" "):
                    found.append((at, at + len(piece), "B_PERS" if piece in ("Dana", "Levi") else "O"))
                    at += len(piece) + 1
                out.append(found)
            return out

        return tag

    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = sorted((r["start"], r["text"]) for r in tags.entities(docs, model).collect())
    assert got == [(text.index("Dana"), "Dana Levi"), (len(text) - 4, "Dana")]


def test_parameters_and_their_defaults(spark):
    said = ['{"intent": "summarize", "session_count": "3", "date_from": "2025-01-02", "topic": ""}', "{}", '```json\n{"session_count": 0, "template_type": "diagnosis"}\n```', "no", None, '{"session_count": "many"}', '{"date_from": "soon"}']
    got = [r[0] and r[0].asDict() for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").coalesce(1).orderBy("i").select(answers.params_of(F.col("x"))).collect()]
    none = {"intent": "find_specific", "date_from": None, "date_to": None, "template": None, "topic": None, "session_limit": None}
    assert [g and {**g, "date_from": g["date_from"] and str(g["date_from"])} for g in got] == [none | {"intent": "summarize", "session_limit": 3, "date_from": "2025-01-02"}, none, none | {"template": "diagnosis"}, None, None, None, none]


def test_each_question_ends_by_itself(spark, tmp_path):
    questions = [("a", "fine", "p", "x"), ("b", "second", "p", "x"), ("c", "never", "p", "x"), ("d", "nothing", "q", "x"), ("e", "breaks", "p", "x"), ("e", "zzz", "p", "x"), ("f", None, "p", "x")]
    (tmp_path / "truth.json").write_text(json.dumps([dict(zip(("query_id", "question", "patient_id", "expected_answer"), q)) for q in questions]))
    asked = answers.ground_truth(spark, f"file://{tmp_path}/truth.json")

    def extract():
        def model(prompts):
            if any("breaks" in p for p in prompts) and len(prompts) > 1:
                raise ValueError
            return ["?" if "never" in p or ("second" in p and "not a JSON" not in p) else '{"intent": "summarize"}' for p in prompts]

        return model

    def answer():
        def model(prompts):
            if any("breaks" in p for p in prompts):
                raise ValueError
            return [p.replace("ctx", "PERSON_" + "0" * 64) for p in prompts]

        return model

    def judge():
        return lambda prompts: [json.dumps({n: 5 for n in ("relevance", "faithfulness", "completeness", "fluency")}) if "[" not in json.loads(p)["answer"] else "none" for p in prompts]

    find = lambda routed: routed.filter("patient_id = 'p'").select("query_id", F.lit("session").alias("side"), F.lit("2025-01-01").cast("date").alias("session_date"), F.lit("ctx").alias("text"))
    reid = spark.createDataFrame([("Dana", "PERSON", "0" * 64)], "value string, type string, key string")
    prompts = {k: "{context}|{question}" for k in ("compare", "trend", "domain", "document", "summarize", "specific")}
    out = answers.results(answers.answered(asked, extract, answer, judge, "2025-01-01", find, [], prompts, reid), f"file://{tmp_path}/out")
    got = {r["query_id"]: (r["attempts"], r["status"], r["answer"], r["scores"]["fluency"]) for r in out.collect()}
    assert got == {"a": (1, "ok", "Dana|fine", 5), "b": (2, "ok", "Dana|second", 5), "c": (2, "extraction_failed", None, 0), "d": (1, "no_results", None, 0), "e": (1, "error", None, 0), "f": (1, "ok", "Dana|", 5)}
    assert boundary.averages(out).first()["n_judged"] == 3
