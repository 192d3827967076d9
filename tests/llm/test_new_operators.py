"""Importance resampling, exact top k and fill-in-the-middle against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import regex
from fixtures import no_docs, odd_docs

from tidemark.llm import fill_in_middle, importance, score_index

# 11


def brute_features(text, low, high):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, n, buckets, least, percent):
    got = [(doc_id, *brute_features(text, *n)) for doc_id, text in rows]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, _, f in got:
        np.add.at(s, [x % buckets for x in f], 1)
    for text in target:
        np.add.at(t, [x % buckets for x in brute_features(text, *n)[1]], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, words, f in got:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in f)
        out.append([doc_id, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = i
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("n, buckets, least, percent", [((1, 1), 10_000, 20, 10), ((1, 3), 97, 2, 60), ((2, 2), 10_000, 0, 100)])
def test_resampling_equals_brute_force(spark, n, buckets, least, percent):
    docs = odd_docs(spark)
    target = spark.createDataFrame([("one Two, three",), (None,), ("",), (docs.first()["text"],)], "text string")
    got = importance.resample(docs, target, n, buckets, least_words=least, percent=percent)
    expected = brute_resample([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()], n, buckets, least, percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    assert {r["doc_id"] for r in importance.drawn(docs, got).select("doc_id").collect()} == {r[0] for r in expected if r[5] and r[0] is not None}


def test_resampling_of_nothing(spark):
    docs = odd_docs(spark)
    assert importance.resample(no_docs(spark), docs).count() == 0
    rows = importance.resample(docs.filter("doc_id = 1"), no_docs(spark)).collect()
    assert len(rows) == 1 and rows[0]["n_features"] == 120


def test_ties_and_repeats_take_ranks_in_order(spark):
    text = "same words here " * 10
    rows = [(5, text)] * 400 + [(i, text) for i in range(100)] + [(None, text)] * 100
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string"), percent=50).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 301))
    keys = sorted(((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == keys[:300]


def test_spans_overlap_and_stand_between_boundaries():
    plain = importance.collapsed("A-b  c,D\né9")
    assert plain == "a b c d é9".encode()
    assert [m.group().decode() for m in importance.spans(2).finditer(plain, overlapped=True)] == ["a b", "b c", "c d", "d é9"]
    assert [m.group().decode() for m in importance.spans(1).finditer(plain, overlapped=True)] == ["a", "b", "c", "d", "é9"]
    assert not list(importance.spans(3).finditer(b"a b", overlapped=True)) and importance.collapsed(" \x00!") == b""


# 12


def brute_top(rows, every, k, scale=1024):
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("dims, n, shard, block", [(16, 700, 100, 3), (64, 500, 2048, 1024), (3, 300, 50, 1000), (1, 200, 64, 2)])
def test_top_k_equals_brute_force(spark, dims, n, shard, block):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(n, dims)) + 2 * rng.integers(0, 2, (n, 1))
    v[n // 3 : 2 * n // 3] = v[0]  # a third are copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x) for i, x in enumerate(v.astype(np.float32).astype(float).tolist())]
    q = score_index.quantised(vectors(spark, rows))
    got = score_index.search(score_index.build(q, shard), q.filter("vec_id % 20 = 0").select("vec_id", "vector"), 10, block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20, 10)


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (100, None), (200, [1.0, None]), (300, [nan, 1.0]), (400, [1.0, inf]), (None, [5.0, 5.0]), (1, [3.0]), (2, []), (3, [0.5, 0.5, 9.0]), (3, [0.5, 0.5, 9.0]), (500, [-0.0001, 0.0]), (600, [30000.0, 7.0])]
    expected = brute_top(rows, 100, 10)
    got = sorted(map(tuple, score_index.top_k(vectors(spark, rows)).collect()))
    assert got == expected and len(expected) == 2 * 6 + 7 + 7
    assert score_index.top_k(vectors(spark, rows).limit(0)).count() == 0
    assert score_index.top_k(vectors(spark, rows[:1])).count() == 0


def test_large_scores_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x) for i, x in enumerate((rng.normal(size=(60, 4)) * 2e5).astype(np.float32).astype(float).tolist())]
    assert sorted(map(tuple, score_index.top_k(vectors(spark, rows), 10).collect())) == brute_top(rows, 10, 10)
    with pytest.raises(Exception, match="(?i)too large|overflow"):
        score_index.top_k(vectors(spark, [(0, [1e15, 1.0]), (1, [1e15, 1.0])])).collect()


def test_search_stops_on_proof_before_all_postings(spark):
    """Clusters apart: bounds after the first segments leave few possible members."""
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(40, 32)), 25, axis=0) + 0.05 * rng.normal(size=(1000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    q = score_index.quantised(vectors(spark, rows))
    shard = score_index.Shard(score_index.build(q, 5000).toArrow())
    asked = shard.v[0]
    alive = []
    count, np.bincount = np.bincount, lambda places, *a, f=np.bincount: alive.append(len(places)) or f(places, *a)
    try:
        ids, scores = shard.best(asked, 0, 10, None)
    finally:
        np.bincount = count
    assert sum(alive[::3]) < 0.7 * shard.v.size
    exact = shard.v @ asked
    exact[0] = -(1 << 60)
    assert sorted(scores.tolist()) == sorted(np.sort(exact)[-10:].tolist()) and set(ids.tolist()) <= set(range(25))


# 13


def brute_middle(doc_id, text, units):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text or ""
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [None, r"\w+"])
def test_middles_equal_brute_force(spark, unit):
    texts = ["", None, "a", "<P>", "x<S>y", "<<S", "P><M", "é", "😀" * 20, "日本 語é\n" * 9, "w\x00rd " * 300, "<" * 40, "S>" * 40] + [("ab é😀" * k)[:k] for k in range(1, 120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "é"), (7, "again")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n string, Output string")
    got = fill_in_middle.transform(df, unit=unit)
    assert got.columns == [*df.columns, "n_", "form", "prefix_chars", "middle_chars", "output_"]

    def units(t):
        if unit is None or not t:
            return list(t or "")
        at = [m.start() for m in regex.finditer(unit, t)] or [0]
        return [t[a:b] for a, b in zip([0, *at[1:]], [*at[1:], len(t)])]

    out = got.withColumn("back", fill_in_middle.restored(got["output_"], got["form"])).collect()
    expected = sorted(((i, t, *brute_middle(i, t, units(t))) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["n_"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_"]) for r in out), key=repr) == expected
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_middles_of_odd_tables(spark):
    rows = fill_in_middle.transform(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count() and fill_in_middle.transform(no_docs(spark)).count() == 0
    assert [r for r in rows if r["doc_id"] == 9][0]["n"] > 100_000


def test_sentinels_that_texts_complete_are_told_apart():
    """A text's end and a mark must not make another mark; such texts stay plain."""
    form = [fill_in_middle.moved(b"aba", (1, 2, 0, 50), None, (b"ab", b"ba", b"xx"), 100, 20)[1], fill_in_middle.moved(b"bbb", (1, 2, 0, 50), None, (b"aba", b"cab", b"xbx"), 100, 20)[1]]
    assert form == ["plain", "psm"]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 257, 5000])
def test_skip_list_reaches_every_rank(n):
    rng = np.random.default_rng(n)
    points = rng.integers(1, 400, n)
    sizes = points + rng.integers(0, 900, n)
    lanes = fill_in_middle.SkipList(points, sizes)
    p, s = np.concatenate([[0], np.cumsum(points)]), np.concatenate([[0], np.cumsum(sizes)])
    for rank in {0, n, *rng.integers(0, n + 1, 50).tolist()}:
        assert lanes.seek(rank) == (p[rank], s[rank])
