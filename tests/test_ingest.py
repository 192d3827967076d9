"""The ingest job on Word files, twice, then with a changed file."""

from pyspark.sql import functions as F

from tidemark.functions.vocab import DOMAINS, SECTIONS
from tidemark.jobs import ingest
from tidemark.operators import boundary, deid, store
from tidemark.sources import docx

AT = "2025-03-01 08:00:00"


def tables(spark, root):
    out = {}
    for name in [*ingest.TABLES, "vector", "attribute", "log"]:
        now = store.Database(spark, root).read(name)
        out[name] = [] if now is None else sorted(str(r) for r in now.collect())
    return out


def test_files_become_rows_once(spark, tmp_path):
    folder = tmp_path / "in" / "דנה לוי"
    folder.mkdir(parents=True)
    report = folder / "סיכום אבחון 1 דנה לוי.docx"
    head = [("שם: דנה לוי", False), ("תאריך: 01/02/2025", False)]
    docx.write(str(report), [*head, (SECTIONS[0][0], True), ("דנה באה עם דנה לוי ועם רות, 052-123-4567", False), (SECTIONS[2][0], True), (f"{DOMAINS[0]}: טוב, גם לדנה לוי", False)])
    docx.write(str(folder / "תוכנית טיפול דנה לוי.docx"), [("שם: דנה לוי", False), ("1/3/2025", False), ("מפגש עם רות", False)])
    docx.write(str(folder / "סיכום טיפול 2 רון כהן.docx"), [("x", False)])
    docx.write(str(folder / "other.docx"), [("x", False)])
    (folder / "סיכום אבחון 9 דנה לוי.docx").write_bytes(b"no zip")
    root, model = f"file://{tmp_path}/db", boundary.gazetteer(["רות"])
    go = lambda **how: {r["path"].rsplit("/", 1)[1]: r["status"] for r in ingest.run(spark, docx.documents(docx.files(spark, [str(tmp_path / "in")])), root, F.lit(AT).cast("timestamp"), **how).collect()}
    closed = go()
    assert {closed[report.name], closed["תוכנית טיפול דנה לוי.docx"]} == {"blocked:ner_rescan"} and tables(spark, root)["log"] == []
    first = go(model=model)
    assert first == {report.name: "ok", "תוכנית טיפול דנה לוי.docx": "ok", "סיכום טיפול 2 רון כהן.docx": "blocked:name_conflict", "other.docx": "unknown_template", "סיכום אבחון 9 דנה לוי.docx": "error:BadZipFile"}
    reid = store.Database(spark, root).read("reid")
    key = {r["value"]: f"{r['type']}_{r['key']}" for r in reid.collect()}
    section = store.Database(spark, root).read("section").collect()
    assert [(r["name"], r["text"], str(r["session_date"]), r["raw_date"], f"PERSON_{r['patient_id']}") for r in section] == [(SECTIONS[0][1], f"{key['דנה']} באה עם {key['דנה לוי']} ועם {key['רות']}, {key['052-123-4567']}", "2025-02-01", "01/02/2025", key["דנה לוי"])]
    finding = store.Database(spark, root).read("finding").first()
    assert finding["text"] == f"טוב, גם ל{key['דנה לוי']}" and finding["name"] == DOMAINS[0]
    session = store.Database(spark, root).read("session").first()
    assert session["text"] == f"מפגש עם {key['רות']}" and str(session["session_date"]) == "2025-03-01"
    assert {r["patient_id"] for r in deid.subject_ids(spark.createDataFrame([("דנה לוי",)], "folder string"), reid).collect()} == {finding["patient_id"]}
    before = tables(spark, root)
    again = go(model=model)
    assert {k: v for k, v in again.items() if v == "skipped"}.keys() == {k for k, v in first.items() if v == "ok"} and tables(spark, root) == before
    docx.write(str(report), [*head, (SECTIONS[3][0], True), ("new", False)])
    assert go(model=model)[report.name] == "ok"
    assert [(r["name"], r["text"]) for r in store.Database(spark, root).read("section").collect()] == [(SECTIONS[3][1], "new")]
    assert store.Database(spark, root).read("finding").count() == 0 and store.Database(spark, root).read("session").count() == 1


def test_evaluation_takes_errors(spark):
    import json

    rows = spark.createDataFrame([("a", "x"), ("bad", "y")], "question string, expected_answer string")

    def answering():
        def model(texts):
            if "bad" in texts:
                raise ValueError
            return [f"<{t}>" for t in texts]

        return model

    def judging():
        return lambda prompts: [json.dumps({n: 5 if json.loads(p)["answer"] == "<a>" else 9 for n in ("relevance", "faithfulness", "completeness", "fluency")}) for p in prompts]

    out = boundary.evaluated(rows, answering, judging)
    assert {r["question"]: (r["answer"], r["status"], r["scores"]["fluency"]) for r in out.collect()} == {"a": ("<a>", "ok", 5), "bad": (None, "error", 0)}
    mean = boundary.averages(out).first()
    assert (mean["relevance"], mean["n_judged"]) == (2.5, 1)


def test_an_entity_cut_by_a_window_is_told_once(spark):
    text = list("x " * 1500)
    for at in (645, 700, 720, 790, 1340, 2000):
        text[at - 1 : at + 12] = " Dana Cohen  "
    docs = spark.createDataFrame([(1, "".join(text))], "doc_id long, text string")

    def factory():
        import re

        return lambda parts: [[(m.start(), m.end(), "PER") for m in re.finditer(r"Dana Cohen|(?<=^)Cohen|Dana$|(?<=^)[a-z]*na Cohen", t)] for t in parts]

    got = sorted((r["start"], r["text"]) for r in boundary.entities(docs, factory).collect())
    assert got == [(at, "Dana Cohen") for at in (645, 700, 720, 790, 1340, 2000)]
