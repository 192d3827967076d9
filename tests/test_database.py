"""Databases of several tables: joint commits, crashes, buckets by size, deletes, vacuum."""

import pytest

from tidemark.operators import store

SCHEMA = "k long, source string, v string"


def rows(spark, ks, v, source="f1"):
    return spark.createDataFrame([(k, source, v) for k in ks], SCHEMA)


def seen(db, *names):
    out = []
    for name in names:
        now = db.read(name)
        out.append(None if now is None else sorted((r["k"], r["v"]) for r in now.collect()))
    return out


def test_tables_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    db = store.Database(spark, f"file://{tmp_path}/db")
    t = db.begin()
    t.merge("a", rows(spark, [1, 2], "x"), ["k"], ["v"])
    assert seen(db, "a", "b") == [None, None] and sorted(r["k"] for r in t.read("a").collect()) == [1, 2]
    t.merge("b", rows(spark, [1], "x"), ["k"], ["v"])
    assert t.commit() == 1 and seen(db, "a", "b") == [[(1, "x"), (2, "x")], [(1, "x")]]
    before = seen(db, "a", "b")
    steps = [lambda t: t.delete("a", rows(spark, [1], "", "f1"), ["source"]), lambda t: t.merge("b", rows(spark, [5], "y"), ["k"], ["v"]), lambda t: t.overwrite("a", rows(spark, [9], "z")), lambda t: t.commit()]
    for crash in range(len(steps)):  # a job that dies before each step
        t = db.begin()
        for step in steps[:crash]:
            step(t)
        assert seen(store.Database(spark, db.path), "a", "b") == before
    with monkeypatch.context() as m:  # and one whose draft is written, not renamed
        m.setattr(db, "_publish", lambda *_: 1 / 0)
        t = db.begin()
        steps[1](t)
        with pytest.raises(ZeroDivisionError):
            t.commit()
    assert seen(db, "a", "b") == before and db.versions() == [1] and len(db.unreferenced()) >= 4
    one, two = db.begin(), db.begin()
    for t in (one, two):
        steps[1](t)
    one.commit()
    with pytest.raises(RuntimeError):  # two writers of one version
        two.commit()
    assert seen(db, "b") == [[(1, "x"), (5, "y")]] and db.read("b", 1).count() == 1
    db.vacuum(older_than_ms=0)
    assert db.unreferenced() == [] and db.versions() == [2] and seen(db, "a", "b") == [[(1, "x"), (2, "x")], [(1, "x"), (5, "y")]]


def test_deletes_touch_their_buckets_alone_and_nulls_stay(spark, tmp_path):
    db = store.Database(spark, f"file://{tmp_path}/db")
    t = db.begin()
    t.merge("a", rows(spark, range(100), "x").unionByName(rows(spark, [500], "y", "f2")).unionByName(rows(spark, [600], "n", None)), ["k"], ["v"], least=16)
    t.commit()
    t = db.begin()
    t.delete("a", rows(spark, [0], "", "f2").unionByName(rows(spark, [0], "", None)), ["source"])
    t.delete("none", rows(spark, [0], "", "f2"), ["source"])
    t.commit()
    folders = db.state()[1]["a"]["folders"]
    assert len(folders) == 2 and sorted(len(f["live"]) for f in folders.values())[0] == 1
    assert {k for k, _ in seen(db, "a")[0]} == {*range(100), 600}
    t = db.begin()
    t.delete("a", rows(spark, [0], "", "nowhere"), ["source"])
    assert t.commit() == 2  # nothing has changed
    t.delete("a", rows(spark, [0], "", "f1"), ["source"])
    t.merge("a", rows(spark, [], ""), ["k"], ["v"])
    t.commit()
    assert seen(db, "a") == [[(600, "n")]]


def test_tables_are_cut_anew_as_they_grow(spark, tmp_path):
    db = store.Database(spark, f"file://{tmp_path}/db", bucket=20_000, file=5_000)
    for step in range(4):
        t = db.begin()
        t.merge("a", spark.range(step * 20_000, (step + 1) * 20_000).selectExpr("id as k", "'f' as source", "uuid() as v"), ["k"], ["v"])
        t.commit()
    state = db.state()[1]["a"]
    assert state["n"] >= 64 and db.read("a").count() == 80_000 and db.read("a").select("k").distinct().count() == 80_000
    files = db.read("a").inputFiles()
    assert len(files) > state["n"]  # several tasks write a bucket
    t = db.begin()
    t.merge("a", rows(spark, [3], "new"), ["k"], ["source"])
    t.commit()
    assert db.read("a").filter("k = 3").first()["v"] == "new" and db.read("a").count() == 80_000


def test_a_callers_bucket_column_stays(spark, tmp_path):
    table = store.VersionedTable(spark, f"file://{tmp_path}/t")
    table.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, _bucket string"), ["k"], ["_bucket"])
    table.merge(spark.createDataFrame([(2, "c")], "k int, _bucket string"), ["k"], ["_bucket"])
    assert {(r["k"], r["_bucket"]) for r in table.read().collect()} == {(1, "a"), (2, "c")}
