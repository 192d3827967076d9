"""Store, retrieval, privacy, routing, files and streams on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.vocab import DOMAINS, PII
from tidemark.operators import deid, retrieve, route, store
from tidemark.sources import docx
from tidemark.streaming import ingest

D = dt.date


def test_last_write_wins_and_is_idempotent(spark):
    rows = spark.createDataFrame([("p", D(2025, 1, 1), "a", 1), ("p", D(2025, 1, 1), None, 2), ("q", D(2025, 1, 1), "c", 1)], "k string, d date, t string, seq int")
    once = store.upsert(rows, ["k", "d"], ["seq"])
    assert sorted((r["k"], r["t"]) for r in once.collect()) == [("p", None), ("q", "c")]
    assert sorted(map(str, store.merge(once, once, ["k", "d"], ["seq"]).collect())) == sorted(map(str, once.collect()))


def test_working_columns_clash_with_none(spark):
    rows = spark.createDataFrame([("p", D(2025, 1, 1), "a", 1, 7, 8, 9), ("p", D(2025, 1, 2), "b", 2, 7, 8, 9)], "_last string, session_date date, _new string, seq int, _rank int, _side int, _value int")
    assert store.upsert(rows, ["_last"], ["seq"]).collect()[0]["_new"] == "b"
    assert store.merge(rows, rows, ["_last"], ["seq"]).columns == rows.columns
    assert [r["_rank"] for r in retrieve.latest_n(rows, "_last", 1).collect()] == [7]
    aims = spark.createDataFrame([("p", D(2025, 1, 1), "g", 1)], "_last string, session_date date, goal string, k int")
    got = retrieve.as_of(rows, aims, "_last", "session_date", "goal", ["k"])
    assert got.columns == [*rows.columns, "goal"] and [(r["_side"], r["_value"], r["goal"]) for r in got.collect()] == [(8, 9, "g")] * 2


def test_reingest_and_cascade(spark):
    old = spark.createDataFrame([("f1", "k1", "a", 1), ("f2", "k1", "b", 0), ("f2", "k2", "c", 2)], "src string, k string, t string, seq int")
    new = spark.createDataFrame([("f2", "k3", "n", 3)], old.schema)
    assert sorted((r["src"], r["k"]) for r in store.replace_sources(old, new, "src", ["k"], ["seq"]).collect()) == [("f1", "k1"), ("f2", "k3")]
    assert [r["k"] for r in store.cascade(old, new.withColumn("k", F.lit("k1")), ["k"]).collect()] == ["k2"]


def test_versions_switch_whole(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.write(spark.range(3))
    t.write(spark.range(5))
    assert t.read().count() == 5 and t.versions() == [1, 2]


def test_a_crash_between_any_steps_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(t, "_publish", lambda *_: 1 / 0)  # data is written, its name is not
        for step in (lambda: t.write(spark.range(9)), lambda: t.merge(spark.range(9), ["id"], ["id"])):
            try:
                step()
            except ZeroDivisionError:
                pass
    (tmp_path / "t" / "_draft-x").write_text("")  # the file is there, not its name
    assert t.read().count() == 3
    assert t.write(spark.range(4)) == 2 and t.read().count() == 4
    try:
        t._publish(2, {"whole": "x"})
        raise AssertionError
    except RuntimeError:
        assert t.read().count() == 4


def test_merging_rewrites_touched_buckets_alone(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    schema = "k int, v string, seq int"
    t.merge(spark.createDataFrame([(i, "a", 1) for i in range(200)], schema), ["k"], ["seq"], buckets=8)
    first = t._manifest()[1]["buckets"]
    t.merge(spark.createDataFrame([(3, "b", 2), (3, "old", 0), (500, "n", 1)], schema), ["k"], ["seq"])
    second = t._manifest()[1]["buckets"]
    assert len(first) == 8 and 1 <= sum(first[k] != second[k] for k in first) <= 2
    got = {r["k"]: r["v"] for r in t.read().collect()}
    assert got == {i: "a" for i in range(200)} | {3: "b", 500: "n"}
    t.merge(spark.createDataFrame([], schema), ["k"], ["seq"])
    assert t.read().count() == 201
    w = store.VersionedTable(spark, f"file://{tmp_path}/w")
    w.write(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], schema))
    w.merge(spark.createDataFrame([(2, "b", 2)], schema), ["k"], ["seq"])
    assert {r["k"]: r["v"] for r in w.read().collect()} == {1: "a", 2: "b"}


def test_deletes_by_source_reach_all_tables_and_the_log_keeps_times(spark):
    a = spark.createDataFrame([("f1", 1), ("f2", 2)], "source_file string, x int")
    b = spark.createDataFrame([("f2", "y"), (None, "z")], "source_file string, y string")
    left = store.delete_sources({"a": a, "b": b}, a.filter("x = 2"))
    assert [r["x"] for r in left["a"].collect()] == [1] and [r["y"] for r in left["b"].collect()] == ["z"]
    at = lambda d: F.lit(d).cast("timestamp")
    log = store.mark_ingested(None, spark.createDataFrame([("p", "h1"), ("q", "h2")], "path string, hash string"), at("2025-01-01"))
    log = store.mark_ingested(log, spark.createDataFrame([("p", "h3")], "path string, hash string"), at("2025-01-02"))
    assert {(r["path"], r["hash"], str(r["ingested_at"].date())) for r in log.collect()} == {("p", "h3", "2025-01-02"), ("q", "h2", "2025-01-01")}


def test_as_of_before_between_and_equal(spark):
    goals = spark.createDataFrame([("p", D(2025, 1, 10), "g1", 1), ("p", D(2025, 2, 10), "g2", 2), ("p", D(2025, 2, 10), None, 3)], "p string, d date, g string, seq int")
    asked = spark.createDataFrame([("p", D(2025, 1, 9)), ("p", D(2025, 1, 10)), ("p", D(2025, 2, 9)), ("p", D(2025, 3, 1)), ("q", D(2025, 3, 1))], "p string, d date")
    got = {(r["p"], str(r["d"])): r["g"] for r in retrieve.as_of(asked, goals, "p", "d", "g", ["seq"]).collect()}
    assert got == {("p", "2025-01-09"): None, ("p", "2025-01-10"): "g1", ("p", "2025-02-09"): "g1", ("p", "2025-03-01"): None, ("q", "2025-03-01"): None}


def test_latest_n_and_compare(spark):
    rows = spark.createDataFrame([("p", D(2025, 1, i), i) for i in range(1, 6)] + [("q", D(2025, 1, 9), 1)], "p string, session_date date, seq int")
    got = sorted((r["p"], r["seq"], r["place"]) for r in retrieve.latest_n(rows, "p", 2).collect())
    assert got == [("p", 4, 1), ("p", 5, 2), ("q", 1, 1)]
    status = {r["p"]: (r["n_before"], r["n_after"], r["status"]) for r in retrieve.compare_status(rows, "p", F.lit("2025-01-03").cast("date")).collect()}
    assert status == {"p": (2, 3, "ok"), "q": (0, 1, "no_before")}


def test_routing_table(spark):
    cases = [
        ("summarize", "treatment_plan", None, None, "sessions"), ("summarize", "diagnosis", None, None, "documents"), ("summarize", None, None, None, "sessions"),
        ("check_domain", None, f' "{DOMAINS[3]}". ', None, "domain"), ("check_domain", None, "x", None, "vectors"), ("check_domain", None, None, None, "vectors"),
        ("find_specific", None, None, None, "sessions"), ("find_specific", None, "", None, "sessions"), ("find_specific", None, "x", None, "vectors"),
        ("find_specific", "clinic_visit_summary", None, None, "documents"), ("compare_progress", None, None, D(2025, 1, 1), "compare"), ("compare_progress", None, None, None, "sessions"),
        ("other", None, None, None, "vectors"), (None, None, None, None, "vectors"),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "query_id int, intent string, template string, topic string, date_from date")
    got = [r["strategy"] for r in route.route(rows).orderBy("query_id").collect()]
    assert got == [c[4] for c in cases]


def reids(spark, rows):
    return spark.createDataFrame([(v, t, f"{i:064x}") for i, (v, t) in enumerate(rows)], "value string, type string, key string")


def test_deid_round_trip_and_gate(spark):
    texts = ["call 052-123-4567 or +972 3 123 4567, 031234567", "id 12345678-9, mail a.b@c.org, again a.b@c.org", "Dana met dana, Danax and Yosi Cohen; YOSI  COHEN", "nothing", "", None]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, m string, spans int")
    names = spark.createDataFrame([(2, "Dana", 1), (2, "Yosi Cohen", 0)], "doc_id int, name string, place int")
    found = deid.detect(docs, PII, names)
    reid = spark.createDataFrame(deid.mint(found).collect(), "value string, type string, key string")
    key = {r["value"]: f"{r['type']}_{r['key']}" for r in reid.collect()}
    masked = deid.replace(docs, found, reid)
    assert masked.columns == [*docs.columns, "n_values"]
    rows = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert rows[0] == f"call {key['052-123-4567']} or {key['+972 3 123 4567']}, {key['031234567']}" and rows[1].count("EMAIL_") == 2 and rows[5] is None
    # the full name in any case, each of its words alone in any case, none inside another word
    assert rows[2] == f"Dana met dana, Danax and {key['Yosi Cohen']}; {key['YOSI']}  {key['COHEN']}"
    back = {r["doc_id"]: r["text"] for r in deid.reidentify(masked.select("doc_id", "text", "m"), reid).collect()}
    assert back == dict(enumerate(texts))
    assert all(r["passed"] for r in deid.gate(masked.select("doc_id", "text"), reid).collect())
    assert {r["doc_id"]: r["failure_type"] for r in deid.gate(docs, reid).collect()} == {0: "regex", 1: "regex", 2: "reid_map", 3: None, 4: None, 5: None}
    assert {r["failure_type"] for r in deid.gate(masked, reid, production=True).collect()} == {"ner_rescan"}
    assert len({r["key"] for r in reid.collect()}) == reid.count() and all(len(r["key"]) == 64 for r in reid.collect())
    assert deid.replace(docs.limit(0), found, reid).count() == 0 and deid.replace(docs, found.limit(0), reid).filter("n_values = 0").count() == 6


def test_one_word_names_count_in_any_case(spark):
    docs = spark.createDataFrame([(1, "Dana met dana, Danax"), (2, "Dana")], "doc_id int, text string")
    found = deid.detect(docs, PII, spark.createDataFrame([(1, "Dana")], "doc_id int, name string"))
    got = {r["doc_id"]: r["text"] for r in deid.replace(docs, found, reids(spark, [("Dana", "PERSON"), ("dana", "PERSON")])).collect()}
    assert got == {1: f"PERSON_{0:064x} met PERSON_{1:064x}, Danax", 2: "Dana"}


def test_entities_have_types_and_labels_that_have_none_go(spark):
    rows = spark.createDataFrame([(1, "PER", "דנה לוי"), (1, "ORG", "מכון"), (1, "LOC", "חיפה")], "doc_id int, label string, text string")
    assert {(r["type"], r["value"]) for r in deid.of_entities(rows).collect()} == {("PERSON", "דנה לוי"), ("INST", "מכון")}


def test_known_values_are_swept_from_all_documents(spark):
    texts = ["met Dana Levi, then Dana Levi-Cohen.", "DANA none", "with (Dana Levi)", "case #12/b! and case 12/b", "Danalevi Dana  Levi", "לדנה לוי", "אדנה לוי"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    values = [("Dana Levi", "PERSON"), ("Dana Levi-Cohen", "PERSON"), ("#12/b!", "ID"), ("none", "PERSON"), ("דנה לוי", "PERSON"), ("x", "ID")]
    reid = reids(spark, values)
    assert {r["doc_id"]: r["n_leaks"] for r in deid.leaks(docs, reid).collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1}
    assert {r["doc_id"]: r["failure_type"] for r in deid.gate(docs, reid).collect()} == {0: "reid_map", 1: "reid_map", 2: "reid_map", 3: "reid_map", 4: None, 5: "reid_map", 6: "reid_map"}
    swept = deid.sweep(docs, reid)
    token = [f"{t}_{i:064x}" for i, (_, t) in enumerate(values)]
    got = {r["doc_id"]: r["text"] for r in swept.collect()}
    assert got == {0: f"met {token[0]}, then {token[1]}.", 1: f"DANA {token[3]}", 2: f"with ({token[0]})", 3: f"case {token[2]} and case 12/b", 4: texts[4], 5: f"ל{token[4]}", 6: f"א{token[4]}"}
    assert all(r["passed"] for r in deid.gate(swept.select("doc_id", "text"), reid).collect())
    assert deid.leaks(docs, reid.limit(0)).count() == 0 and deid.leaks(docs.limit(0), reid).count() == 0
    own = [("CASE", r"case \d+")]
    assert [r["failure_type"] for r in deid.gate(spark.createDataFrame([(1, "a case 7")], docs.schema), reids(spark, [("case 7", "CASE")]), patterns=own).collect()] == ["regex"]


def test_value_inside_a_token_survives(spark):
    docs = spark.createDataFrame([(1, "x 12345678 y")], "doc_id int, text string")
    key = "0521234567" + "a" * 46 + "12345678"
    reid = spark.createDataFrame([("12345678", "ID", key)], "value string, type string, key string")
    got = deid.replace(docs, deid.detect(docs), reid).first()["text"]
    assert got == f"x ID_{key} y"
    again = spark.createDataFrame([(1, got)], "doc_id int, text string")
    assert deid.sweep(again, reid).first()["text"] == got and deid.detect(again).count() == 0
    assert deid.reidentify(again, reid).first()["text"] == "x 12345678 y"


def test_names_of_files_and_their_conflicts(spark):
    rows = [
        ("יוסי כהן", "a/סיכום ביקור 3 יוסי כהן.docx", None, ["יוסי כהן"], False), ("יוסי כהן", "a/אבחון 1 ד\"ר יוסי כהן.DOCX", " יוסי א כהן ", ["יוסי כהן", 'ד"ר יוסי כהן', "יוסי א כהן"], False),
        ("יוסי כהן", "a/ביקור 3 דנה לוי.docx", None, [], True), ("Yosi Cohen", "a/3.docx", "yosi COHEN", ["Yosi Cohen"], False), ("Yosi Cohen", "a/x cohen.docx", "Dana Levi", [], True), ("", "a/x.docx", "y", [], False), ("Cohen", "a/cohen.docx", None, ["Cohen"], False),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "doc_id int, folder string, path string, header_name string")
    got = {r["doc_id"]: (r["variants"], r["conflict"]) for r in deid.name_variants(df).collect()}
    assert got == {i: (r[3], r[4]) for i, r in enumerate(rows)}
    files = spark.createDataFrame([("סיכום ביקור 3 יוסי כהן.docx",), ("12.docx",), (".docx",), (None,)], "p string")
    assert [r[0] for r in files.coalesce(1).select(deid.name_in_file(F.col("p"))).collect()] == ["יוסי כהן", None, None, None]


def test_audit_layers(spark):
    import hashlib

    names = spark.createDataFrame([("דנה לוי",)], "value string")
    digits = spark.createDataFrame([("12-34 5678",)], "value string")
    plain = spark.createDataFrame([("d.l@x.org",), ("abc",)], "value string")
    forbidden = deid.forbidden_values(names, digits, plain)
    assert {(r["kind"], r["value"]) for r in forbidden.collect()} == {("name", "דנה לוי"), ("name", "דנה"), ("name", "לוי"), ("digits", "12345678"), ("plain", "d.l@x.org")}
    texts = ["ודנה באה", "שדנהית", "no 991.2345 67899", hashlib.sha256("לוי".encode()).hexdigest(), "PERSON_" + "12345678" * 8, "to d.l@x.org", "abc", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "payload_id int, text string")
    got = {r["payload_id"]: r["layers"] for r in deid.audit(rows, forbidden).collect()}
    assert got == {0: "name", 1: None, 2: "digits", 3: "derived_key", 4: None, 5: "pattern_email,plain", 6: None, 7: None, 8: None}
    nested = spark.createDataFrame([({"k": [("a", 1), (None, 2)]}, "b")], "p map<string, array<struct<s:string,n:int>>>, q string")
    got = nested.select(deid.strings_of(F.struct("p", "q"), spark.createDataFrame([], nested.schema).select(F.struct("p", "q").alias("x")).schema["x"].dataType)).first()[0]
    assert [x for x in got if x not in ("p", "q", "s", "n")] == ["k", "a", "b"]


def test_windows_cover_the_text(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 1, 799, 800, 801, 1450, 1451, 5000])], "doc_id int, text string")
    rows = deid.text_windows(docs).collect()
    for i, n in enumerate([0, 1, 799, 800, 801, 1450, 1451, 5000]):
        mine = sorted((r["start"], len(r["window"])) for r in rows if r["doc_id"] == i)
        assert max([a + b for a, b in mine], default=0) == n and all(x[0] + 650 == y[0] for x, y in zip(mine, mine[1:]))


def test_docx_source(spark, tmp_path):
    (tmp_path / "dana").mkdir()
    docx.write(str(tmp_path / "dana" / "a.docx"), [("title", True), ("body & more", False)])
    (tmp_path / "dana" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "dana" / "~lock.docx").write_bytes(b"")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in docx.documents(docx.files(spark, [str(tmp_path)])).collect()}
    assert set(rows) == {"a.docx", "bad.docx"} and rows["a.docx"]["paragraphs"] == ["title", "body & more"] and rows["a.docx"]["folder"] == "dana" and rows["bad.docx"]["error"]


def test_stream_merges_last_writes(spark, tmp_path):
    schema = "k string, t string, seq int"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/x")
    target = store.VersionedTable(spark, f"file://{tmp_path}/t")
    for part in ("x", "y"):
        if part == "y":
            spark.createDataFrame([("a", "2", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/y")
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ingest.merge_stream(rows, target, ["k"], ["seq"], f"{tmp_path}/c").awaitTermination()
    assert sorted((r["k"], r["t"]) for r in target.read().collect()) == [("a", "2"), ("b", "1")]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
