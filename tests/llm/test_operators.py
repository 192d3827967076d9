"""The training-data operators against brute force, round trips and SQL."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures import no_docs, odd_docs
from oracle import both

from tidemark.llm import decontaminate, license_digest, lsh_forest, packing, pieces, quality_rules, simple8b, suffix_dedup, toxicity, url_filter, warc_bundles, words
from tidemark.llm.pieces import Encoder, encoder
from tidemark.llm.queries import ORACLES, QUERIES, RULES, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name], SF)
    assert ours == theirs


def ids_of(text):
    return [*encoder(tokenizer()).library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1


def test_url_rules_aliases_and_odd_urls(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.com/en/x", ""), (2, "http://WWW.Example.com/en/x?y#z", ""), (3, "http://x.org/1", link.format("http://y.net/fr/p")), (4, "http://y.net/fr/p", ""),
        (5, "http://z.org/2", '<meta http-equiv="refresh" content="0; url=http://x.org/1">'), (6, "http://q.com/ok", link.format("http://y.net/fr/p")), (7, None, None), (8, "no scheme", link.format("http://y.net/fr/p")),
        (9, "http://notexample.com", ""), (10, "http://lone.org/", None), (11, "http://r.org/a", link.format("/b")), (12, "http://r.org/b", link.format("http://y.net/fr/p")), (10, "http://lone.org/", None), (None, "http://net/es/", ""),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, root string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, RULES).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[3][2:] == (None, "block") and got[4][3] == "block" and got[5][3] == "block" and got[6][2:] == ("com/", "allow")
    assert got[7] == ("", "", None, "allow") and got[8][:2] == ("", "") and got[9] == ("notexample.com", "", None, "allow") and got[10][3] == "allow" and got[11][3] == got[12][3] == "block" and got[None][2:] == ("net/es/", "block")
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    odd = [("/dir/a", "b"), ("/dir/c", "./x/../b"), ("/dir/sub/d", "../b#part"), ("/e?p=1", "?p=2"), ("/f", "HTTP://R.org/dir/b?x=1&amp;y=2"), ("/g", "//R.ORG/dir/b"), ("/h/", "../dir/b"), ("/i", "#top"), ("", "dir/b")]
    rows = [(i, f"http://r.org{at}", link.format(to), "x") for i, (at, to) in enumerate(odd)] + [(20, "http://r.org/dir/b", link.format("http://y.net/fr/p"), "x"), (21, "http://r.org/e?p=2", link.format("//y.net/fr/"), "x"), (22, "http://r.org/j", '<BASE href="/dir/">' + link.format("b"), "x"), (23, "http://r.org/dir/b?x=1&y=2", link.format("b"), "x"), (24, "http://r.org/dir/b#z", "", "x")]
    more = spark.createDataFrame(rows, df.schema)
    got_more = {r["page_id"]: r["verdict"] for r in url_filter.judge(more, RULES).collect()}
    assert got_more == {i: "allow" if i == 7 else "block" for i in [*range(9), *range(20, 25)]}
    con = duckdb.connect()
    con.register("pages", more.toPandas())
    assert dict(con.execute(f"SELECT page_id, verdict FROM ({ORACLES['op1_url_filter']})").fetchall()) == got_more
    many = RULES + [("block", f"host{i}.org", "/") for i in range(300)]
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(df, many).collect()} == {k: v[3] for k, v in got.items()}


# 2


@pytest.mark.parametrize("top", [1, 2, 50_257, 2**40, 2**60, 2**63 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        x = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        x[rng.random(n) < 0.5] //= np.uint64(1000)
        words, first = simple8b.encode_blocks(x)
        sizes = np.minimum(simple8b.BLOCK, n - np.arange(len(first) - 1) * simple8b.BLOCK)
        assert (simple8b.decode_blocks(words, first[:-1], sizes) == x).all()
        for b in range(len(sizes)):  # each block by itself
            own = simple8b.decode_blocks(words[first[b] : first[b + 1]], np.zeros(1, int), sizes[b : b + 1])
            assert (own == x[b * simple8b.BLOCK :][: sizes[b]]).all()


def alike(n=1024):
    """Two texts that every polynomial hash modulo 2**64 takes for equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_pieces_equal_the_library():
    rng = np.random.default_rng(2)
    own = encoder(tokenizer())
    for alphabet in (list("a's tre\nvm ld1.$ é\t'😀日 \u00a0\u3000\x85\x1c×«\u200b\rİ"), list("ab .,\n 'é×")):
        texts = ["", "it's 's ''s x'll 'LL a'", "a<|endoftext|>b", "͸x", " two  \n\n x\t\ty ", " ", "\n", "a ", "a\n", *alike(), *("".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000))]
        for part in ([], texts[:1], texts):
            ids, at = own.encode(part)
            for text, a, b in zip(part, at, at[1:]):
                assert ids[a:b].tolist() == own.library.encode(text, add_special_tokens=False).ids, text


def test_segments_of_letters_need_no_split_pattern(monkeypatch):
    own = Encoder(tokenizer())
    letters = [chr(c) for c in range(0xC0, 0x280) if c not in (0xD7, 0xF7)]
    texts = ["".join(letters), " ".join(letters), " ".join(f"a{c}s t{c}" for c in letters), "it is so"]
    expected = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    monkeypatch.setattr(own, "_library_ids", lambda x: asked.extend(x))
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expected and not asked


def test_a_full_memory_keeps_what_came_again(monkeypatch):
    own, kept = Encoder(tokenizer()), []
    plain = own.forget
    monkeypatch.setattr(pieces, "_KEPT", 150)
    monkeypatch.setattr(own, "forget", lambda: plain() or kept.append(" same" in own.known and [*own.known.values()] == [*range(len(own.known))]))
    rng = np.random.default_rng(5)
    for _ in range(40):
        texts = ["the same words 'again' 12"] + ["".join(rng.choice(list("abcde é1,"), 30)) for _ in range(6)]
        ids, at = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(kept) > 2 and all(kept)


def test_what_another_stage_kept_is_dropped(monkeypatch):
    dropped, stage = [], [1]
    monkeypatch.setattr(words, "_stage", lambda: stage[0])
    words.keep("x", lambda: dropped.append("x"))
    words.give_back()
    assert not dropped
    stage[0] = 2
    words.give_back()
    words.give_back()
    assert dropped == ["x"]


def test_other_tokenizers_go_to_the_library_whole():
    import public_tokenizers

    own = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not own.by_segments
    texts = ["Some  words, here", "", "It's"]
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_written_and_read(spark):
    docs = odd_docs(spark)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in simple8b.read_ids(simple8b.write_ids(docs, tokenizer())).collect()]
    start, expected = 0, []
    for doc_id, text in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = ids_of(text)
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == expected
    assert simple8b.read_ids(simple8b.write_ids(no_docs(spark), tokenizer())).count() == 0


# 3


def test_warc_round_trip_and_seeking(spark):
    big, odd = "y" * 2_000_000, "é\r\n\r\nWARC/1.1 " * 200
    pages = [(1, "http://a", big), (2, "http://b", "s"), (3, "http://c", big), (4, None, None), (5, "http://d\r\nX: 1", odd), (6, "", odd), (7, "http://e", "s"), (3, "http://c", big), (None, "http://n", "z" * 1500)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, last int")
    manifest = warc_bundles.write_archives(df)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_bundles.read_archives(manifest).collect()), key=str)
    expected = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        last = max((p for p, _, h in pages if p is not None and (h or "").encode() == payload), default=None)
        revisit = len(payload) >= 1000 and last is not None and page_id != last
        expected.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(expected, key=str)
    extra = [(-1, "http://m", "w" * 1200), (-2, "http://o", "w" * 1200), (None, "http://n", "w" * 1200), (None, None, "q" * 1200), (None, None, "q" * 1200)]
    both_ways = []
    for most in (10, 0):
        rows = warc_bundles.classify(spark.createDataFrame([(*p, 1) for p in pages + extra], df.schema), most=most)
        both_ways.append(sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in rows.collect()))
    assert both_ways[0] == both_ways[1]
    odd_ids = warc_bundles.read_archives(warc_bundles.write_archives(spark.createDataFrame([(*p, 1) for p in extra], df.schema))).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in odd_ids), key=str) == sorted([(-1, "response", None), (-2, "revisit", -1), (None, "revisit", -1), (None, "response", None), (None, "response", None)], key=str)
    row = manifest.filter("page_id = 2").first()
    data = dict(warc_bundles.read_frames(row["bundle"], [row["frame"]]))[row["frame"]]
    head, body, _ = warc_bundles.parse(data, row["offset"])
    assert head["WARC-Target-URI"] == "http://b" and body == b"s"
    assert warc_bundles.read_archives(warc_bundles.write_archives(df.limit(0))).count() == 0


# 4


def brute_suffix(rows):
    seen = {}
    key = lambda d: (d is None, d or 0)
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            seen[s] = min(seen.get(s, key(d)), key(d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < key(d):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [8, 1])  # 1: every sampled run of leading bytes counts as hot
def test_suffix_dedup_on_odd_rows(spark, monkeypatch, least):
    if least == 1:
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", -1)
        monkeypatch.setattr(suffix_dedup, "Counter", lambda grams: dict.fromkeys(grams, 10**9))
    docs = odd_docs(spark)
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=str)
    assert got == brute_suffix([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert suffix_dedup.digests(no_docs(spark)).count() == 0
    clean = suffix_dedup.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_multikey_order_sorts_bytes():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (500, 50), np.uint8)
    x[250:, :40] = x[:250, :40]
    order = suffix_dedup.multikey_order(x)
    assert [x[i].tobytes() for i in order] == sorted(r.tobytes() for r in x)


# 5


def brute_links(rows, width=5):
    split = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]
    sets = []
    for _, text in rows:
        w = split(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(rows)))
    links = collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, d if d is None else min(least[find(i)]), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_lsh_forest_on_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.join(docs).collect()), key=str)
    assert got == brute_links([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert lsh_forest.join(no_docs(spark)).count() == 0
    kept = sorted(str(r["doc_id"]) for r in lsh_forest.keep_one(docs).collect())
    assert kept == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 11, 13, 15, 16, 17, None, None, 18, 12]))


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(300, rng.integers(0, 9), replace=False):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lsh_forest.verify, "__defaults__", (5, 16))
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.join(df).collect()), key=str)
    assert got == brute_links(rows)


def test_levels_of_large_groups_find_each_pair_once(spark):
    """More than SMALL near copies, of which some pairs share only short prefixes."""
    rng = np.random.default_rng(6)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(150):
        w = list(base)
        for k in rng.choice(200, rng.integers(0, 5), replace=False):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_links(rows)


def test_tries_hold_every_shared_prefix(spark):
    rng = np.random.default_rng(14)
    label = lambda: rng.integers(0, 3, lsh_forest.DEEPEST * lsh_forest.MINIMUM_BYTES, np.uint8)
    rows = [(bytes([i // 256, i % 256]), [(label() // 2).tobytes() for _ in range(lsh_forest.TREES)]) for i in range(300)]
    df = spark.createDataFrame(rows, "node binary, labels array<binary>")
    edges = [(bytes(r["a"]), bytes(r["b"]), r["level"]) for r in lsh_forest.tries(df).collect()]
    for level in (lsh_forest.SHORTEST, 5, lsh_forest.DEEPEST):
        width, want = level * lsh_forest.MINIMUM_BYTES, []
        for tree in range(lsh_forest.TREES):
            groups = collections.defaultdict(list)
            for node, own in rows:
                groups[own[tree][:width]].append(node)
            want += [(g[0], x) for g in groups.values() for x in g[1:]]
        assert closed(want) == closed([(a, b) for a, b, k in edges if k >= level])


def closed(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_prefixes_shorten_until_the_recall(spark):
    rng = np.random.default_rng(15)
    rows = []
    for i in range(150):  # pairs close to the threshold
        w = [f"p{i}w{k}" for k in range(200)]
        rows.append((2 * i, " ".join(w)))
        for k in rng.choice(40, 4, replace=False):
            w[5 * k] = "x"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.join(df).collect()), key=str)
    assert got == brute_links(rows)
    assert lsh_forest.reached({20: 1000}, 8, 0.8) > lsh_forest.reached({0: 1000}, 8, 0.8)
    assert lsh_forest.reached({0: 1000}, 5, 0.8) > lsh_forest.RECALL > lsh_forest.reached({0: 1000}, 8, 0.8)
    assert lsh_forest.reached({}, lsh_forest.DEEPEST, 0.8) < lsh_forest.RECALL < lsh_forest.reached({}, lsh_forest.SHORTEST, 0.8)


def test_words_with_alike_hashes_are_told_apart(spark):
    one, other = alike()
    words_ = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words_[:20] + [one] + words_[20:])), (2, " ".join(words_[:20] + [other] + words_[20:])), (3, f"{one}\n{other}\n{one} a b c d {one} a b c e"), (4, f"{one} a b c d {other} a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.join(df).collect()), key=str) == brute_links(rows)
    raw = [t.encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    assert np.column_stack(quality_rules.measure(np.frombuffer(b"".join(raw), np.uint8), offsets)).tolist() == [brute_counts(t) for _, t in rows]


def test_of_rows_with_one_id_each_text_is_judged(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, a, "x"), (3, b, "x"), (4, "", "x"), (4, "", "y"), (5, "c d", "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, digest string")
    got = [(r["doc_id"], r["text"]) for r in lsh_forest.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (4, ""), (4, ""), (5, "c d"), (None, a)], key=str)
    assert lsh_forest.keep_one(df).schema == df.schema and lsh_forest.keep_one(df.limit(0)).count() == 0


# 6


def brute_cost(places, within, window):
    """The least cost of any choice of cuts among the places (no gap above a window)."""
    at = [0, *places]
    best = [0.0] + [float("inf")] * len(places)
    for j in range(1, len(at)):
        for i in range(j):
            gap = at[j] - at[i]
            full = -(-gap // window)
            if full <= packing.REACH:
                best[j] = min(best[j], best[i] + full * window - gap + (full - 1) * packing.FULL_CUT + (packing.SENTENCE_CUT if within[j - 1] == 1 else 0))
    return best[-1]


def test_cuts_cost_least():
    rng = np.random.default_rng(4)
    for _ in range(30):
        places = np.unique(rng.integers(1, 400, 60))
        places = np.unique(np.append(places, np.arange(10, 401, 10)))
        within = (rng.random(len(places)) < 0.8).astype(np.int8)
        within[-1] = 0
        cuts = packing.choose_cuts(places, within, 16)
        cost, kind, last = 0.0, dict(zip(places.tolist(), within.tolist())), 0
        for c in cuts:
            cost += 16 - (c - last) + (packing.FULL_CUT if c not in kind else packing.SENTENCE_CUT * kind[c])
            assert 0 < c - last <= 16
            last = c
        assert cuts[-1] == places[-1] and cost <= brute_cost(places.tolist(), within.tolist(), 16) + 1e-9


def test_packing_keeps_every_id_once(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, tokenizer()).collect()
    by_text = collections.Counter()
    for r in docs.collect():
        by_text[r["doc_id"], crc(ids_of(r["text"])), len(ids_of(r["text"]))] += 1
    expected = {(r["doc_id"], len(ids_of(r["text"]))): ids_of(r["text"]) for r in docs.collect()}
    covered = collections.Counter()
    for r in rows:
        ids = expected[r["doc_id"], r["doc_tokens"]]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(covered[d, n] == n * sum(c for (d2, _, n2), c in by_text.items() if (d, n) == (d2, n2)) for d, n in covered) and len(covered) == len(expected)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 1024
    assert packing.pack(no_docs(spark), tokenizer()).count() == 0


# 7


def test_whole_licences_in_other_spelling(spark):
    text = "Copyright (c) 2020 Some One\n\n" + license_digest._MIT.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ,")
    rows = [(1, text), (2, "Released under the MIT License."), (3, "x\nLicensed  under CC BY-NC 4.0\ny"), (4, None), (5, ""), (6, text + " more"), (1, text)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"], r["notices"]) for r in license_digest.scan(df).collect()}
    assert got == {(1, "MIT", None), (2, "MIT", "MIT"), (3, None, "CC-BY-NC-4.0"), (4, None, None), (5, None, None), (6, None, None)}
    long = spark.createDataFrame([(1, "Some Long\tLicence\n\n  of words"), (2, "nothing")], "doc_id int, text string")
    form = license_digest.scan(long).filter("doc_id = 1").first()["digest"]
    assert {r["doc_id"]: r["license"] for r in license_digest.scan(long, digests=[("LONG", form)]).collect()} == {1: "LONG", 2: None} and license_digest.scan(long, known=[("x", "y")], digests=[("z", form)]).count() == 2
    assert license_digest.scan(df).count() == 7 and license_digest.scan(df.limit(0)).count() == 0


# 8


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), len(re.findall("[!?]", text))]


def test_counts_equal_brute_force(spark):
    texts = [r["text"] for r in odd_docs(spark).collect()]
    texts += ["\n", "a\n", "\na", "a\n\na", "a b c d e a b c d e", "x x x x x x", "\n\n \n", "a|b #$ é!", "w\na b\nw\r\nw", "a b c d"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = np.column_stack(quality_rules.measure(np.frombuffer(b"".join(raw), np.uint8), offsets)).tolist()
    assert got == [brute_counts(t) for t in texts]


def test_bounds_are_exact():
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert abs(np.exp(quality_rules.log_binomial_cdf(3, 10, 0.3)) - 0.6496107184) < 1e-9
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_keep_the_limit(spark):
    rng = np.random.default_rng(6)
    n = 6000
    noise = rng.integers(0, 3, n)
    rows = [(i, "en", 100, 500, int(x) if i % 10 else 300, 0, 0, 5, 0) for i, x in enumerate(noise)]
    counts = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(n)], "doc_id long, quality int")
    cut = {r[1]: r for r in quality_rules.choose_cutoffs(counts, labels)}
    assert cut["symbols"][2] < 0.6 and all(r[3] <= quality_rules.MAX_FALSE_REJECTION / len(quality_rules.RULES) + 1e-9 for r in cut.values())
    assert quality_rules.choose_cutoffs(counts, labels.limit(50)) == []


def test_quality_on_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["kept"] != r["base_failed"] for r in rows)
    assert quality_rules.judge(no_docs(spark), labels).count() == 0


def test_small_strata_get_joint_cutoffs_within_the_limit(spark):
    rng = np.random.default_rng(13)
    rows, labels = [], []
    for stratum, n in (("en", 2000), ("de", 300), ("tiny", 100)):
        for i in range(n + n // 5):
            bad, labelled = i >= n, i % 6 != 5
            # good documents: a rule of their own now and then, so that the rules' shares add up
            odd = int(rng.integers(0, 150)) if not bad else -1
            doc = len(rows)
            rows.append((doc, stratum, 100, 700 if odd == 1 else 500, 200 if bad else 0, 2 if odd == 2 else 0, 15 if odd == 3 else 0, 5, 40 if odd == 4 else 0))
            labels += [(doc, int(not bad))] if labelled else []
    counts = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long")
    cut = quality_rules.choose_cutoffs(counts, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {c[0] for c in cut} == {"en", "de"} and all(c[3] <= quality_rules.MAX_FALSE_REJECTION for c in cut)
    levels = {(c[0], c[1]): c[2] for c in cut}
    assert all(levels[x, "symbols"] < 0.4 for x in ("en", "de"))
    quality = dict(labels)
    for x in ("en", "de"):
        good = [dict(zip(counts.columns, r)) for r in rows if r[1] == x and quality.get(r[0]) == 1]
        k = sum(any(r[a] / max(r[b], 1) > levels.get((x, name), np.inf) for name, (a, b, _) in quality_rules.RULES.items()) for r in good)
        bound = quality_rules.upper_bound(k, len(good), quality_rules.ALPHA / 2)
        assert {c[3] for c in cut if c[0] == x} == {bound}


# 9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_accepts_what_is_near():
    terms = ["moron", "idiot", "scum", "idyll"]
    model = toxicity.Model(terms, [1.0] * 4)
    m = toxicity.Matcher(model)
    rng = np.random.default_rng(8)
    pool = [*terms, "mron", "morron", "morom", "scam", "iddiot", "oron", "m", ""]
    pool += ["".join(rng.choice(list("moronidtscuyl"), rng.integers(1, 8))) for _ in range(3000)]
    text = " ".join(pool)
    _, starts, ends, _, kind = m.words([text])
    words = text.split()
    found, _ = m.hits(starts, ends, kind)
    near = [i for i, w in enumerate(words) if any(distance(w, t) <= (1 if len(t) >= toxicity.EXACT_BELOW else 0) for t in terms)]
    assert sorted(found.tolist()) == near


def test_quotation_is_told_apart():
    m = toxicity.Matcher(toxicity.Model(["moron"], [5.0]))
    x = m.features(['he said "you moron" to him', "you moron", "", "moron " * 3, '"a" ' + "b " * 20 + "moron"])
    assert x[0, 2] > 0 == x[0, 1] and x[1, 1] > 0 == x[1, 2] and (x[2, 1:] == 0).all() and x[4, 1] > 0


def test_toxicity_learns_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.93 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_odd_rows(spark):
    docs = odd_docs(spark)
    model = toxicity.learn(docs, spark.createDataFrame([(1, 0), (3, 0), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == docs.count()
    kept = toxicity.below(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score(no_docs(spark), model).count() == 0


def test_copies_of_a_long_toxic_text_push_no_term_out(spark):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("bcdfgklnprtv"), n))
    common = [word(6) for _ in range(300)]
    plain = lambda: " ".join(rng.choice(common, 30))
    long = " ".join(word(9) for _ in range(1500))
    rows = [(i, plain(), 0) for i in range(200)] + [(1000 + i, f"{plain()} you moron {plain()}", 1) for i in range(40)]
    rows += [(2000 + i, long, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "moron" in model.terms and not set(model.terms) & set(long.split())
    new = spark.createDataFrame([(1, f"{plain()} moron {plain()}"), (2, plain())], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(new, model).collect()}
    assert got[1] >= 0.5 > got[2]


def test_lexicon_has_no_most_terms(spark):
    rng = np.random.default_rng(12)
    many = sorted({"".join(rng.choice(list("bcdfgklnprtvaeiou"), 9)) for _ in range(600)})
    rows = [(i, " ".join(many) + f" x{i}", 1) for i in range(20)] + [(100 + i, f"moron y{i}", 1) for i in range(10)] + [(200 + i, f"fine z{i}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert set(model.terms) == {*many, "moron"}


def test_states_made_again_and_large_alphabets():
    terms = [chr(0x4E00 + 7 * i) * 2 + chr(0x5E00 + 3 * i) for i in range(400)] + ["moron"]
    m = toxicity.Matcher(toxicity.Model(terms, [1.0] * len(terms)))
    text = " ".join([*terms, "moon", "xmoron", terms[3][:2]])
    found = []
    for _ in range(2):
        _, starts, ends, _, kind = m.words([text])
        word, state = m.hits(starts, ends, kind)
        found.append((word.tolist(), m.automaton.accept[state].tolist()))
        m.automaton.clear()
    assert found[0] == found[1] == ([*range(403)], [*range(401), 400, 400])


# 10


def test_fingerprints_within_the_radius_share_a_block(spark):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for k in rng.choice(63, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(k)
        rows.append((a, b))

    df = spark.createDataFrame(rows, "a long, b long")
    same = F.exists(F.arrays_zip(F.array(*decontaminate.blocks(F.col("a"))).alias("x"), F.array(*decontaminate.blocks(F.col("b"))).alias("y")), lambda p: p["x"] == p["y"])
    assert df.filter(~same).count() == 0


def test_simhash_is_the_majority_of_bits(spark):

    rng = np.random.default_rng(10)
    sets = [rng.integers(-(2**63), 2**63 - 1, n).tolist() for n in (1, 2, 3, 40)]
    for lane in (16, 32):
        got = [r[0] for r in spark.createDataFrame([(s,) for s in sets], "s array<long>").select(decontaminate.simhash(F.col("s"), lane)).collect()]
        for s, g in zip(sets, got):
            want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in s) > len(s))
            assert g % 2**64 == want


def test_leaks_on_odd_rows(spark):
    docs = odd_docs(spark)
    by_id = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"]}
    items = [(1, " ".join(by_id[9].split()[3000:3040])), (2, "one two"), (3, None), (4, ""), (5, " ".join(by_id[9].split()[3000:3040]).upper()), (6, "never seen words in a row at all")]
    bench = spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {(9, 1), (7, 2), (8, 2)} <= got and all(i not in (3, 4, 6) for _, i in got)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == set(by_id) - {7, 8, 9} | {None}
    leaky = " ".join(by_id[9].split()[2990:3050])
    rows = spark.createDataFrame([(None, leaky, "a"), (None, "fine", "b"), (1, leaky, "c"), (1, "fine", "d"), (2, None, "e")], "doc_id long, text string, digest string")
    assert sorted(r["digest"] for r in decontaminate.drop_leaks(rows, bench).collect()) == ["b", "d", "e"]
    assert decontaminate.find_leaks(no_docs(spark), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_windows_meet_items_of_their_shingle_alone(spark):
    """Items of one size that share no words: their fingerprints agree in some block for most pairs, yet few rows are made."""
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 100_000, 40))) for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(t for _, t in items[20 * i : 20 * i + 4])) for i in range(6)], "doc_id long, text string")
    shingles = decontaminate.with_shingles(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    shingles = shingles.select("*", F.size("shingles").alias("size"), decontaminate.simhash(F.col("shingles"), 16).alias("item_print"))
    rows = decontaminate.with_shingles(docs, "doc_id").select("doc_id", "shingles", F.posexplode("shingles").alias("pos", "h"), F.lit(36).alias("size"))
    windows = rows.join(decontaminate.starts(shingles), ["h", "size"]).select("doc_id", "pos", "item_ids", decontaminate.simhash(F.slice("shingles", F.col("pos") + 1, F.lit(36)), 16).alias("print"))
    n, made = windows.count(), decontaminate.met(windows, shingles).count()
    assert n > 700 and made < 25 * n
    leaks = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(i, 20 * i + k) for i in range(6) for k in range(4)}


def test_any_number_of_known_licences(spark, monkeypatch):
    texts = [(f"L{i}", f"Licence text number {i} of many." + " more words" * (i % 1500)) for i in range(10_050)]
    docs = spark.createDataFrame([(i, f"intro\n{texts[i][1].upper()}\nend" if i % 2 else texts[i][1]) for i in range(300)] + [(7, texts[7][1]), (None, texts[9][1])], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["notices"]) for r in license_digest.scan(docs, texts).collect()}
    assert got == {(i, None, f"L{i}") if i % 2 else (i, f"L{i}", f"L{i}") for i in range(300)} | {(7, "L7", "L7"), (None, "L9", "L9")}
    monkeypatch.setattr(license_digest, "MOST_BROADCAST", 0)
    known = spark.createDataFrame(texts, "license string, text string")
    assert {(r["doc_id"], r["license"], r["notices"]) for r in license_digest.scan(docs, known).collect()} == got


def test_lines_and_words_made_to_agree_without_a_key_are_told_apart(spark):
    """The second block of each cancels what the first differs by, for who knows how hashes begin."""
    a, b = bytes.fromhex("3269294130605a5d2121212140402121").decode(), bytes.fromhex("2468287629673e5a656b276c787b477d").decode()
    docs = spark.createDataFrame([(1, f"{a}\n{b}", "en"), (2, f"{a}\n{a}", "en"), (3, a, "en"), (4, b, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.counted(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {r["doc_id"]: r["class_id"] for r in lsh_forest.join(docs.select("doc_id", "text")).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_unlike_texts_in_one_group_are_not_all_compared(spark, monkeypatch):
    """Texts with much text in common, all below the threshold: prefixes chain most of them into one group."""
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([*common, *(f"u{i}x{k}" for k in range(36))])) for i in range(700)]
    raw = np.frombuffer(" ".join(t for _, t in rows).encode(), np.uint8)
    sizes = [len(t) + 1 for _, t in rows]
    values, at = lsh_forest.sets_of(raw, np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(raw)))
    sets, marks = [values[a:b] for a, b in zip(at[:-1], at[1:])], lsh_forest.labels(values, at)[:, :, : 8 * lsh_forest.MINIMUM_BYTES]
    share = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert 0.4 < share < 0.6
    sides = [np.arange(700)]
    pairs = lsh_forest.meeting(marks, sides, 8, 0)
    shared = {(i, j) for t in range(lsh_forest.TREES) for i in range(700) for j in range(i + 1, min(i + 40, 700)) if (marks[i, t] == marks[j, t]).all()}
    assert shared <= set(map(tuple, pairs.tolist())) and 0 < len(pairs) < 700 * 699 // 2 // 5
    assert lsh_forest.compare(sets, np.ones(700, np.int64), sides, 0.8, pairs)[0].sum() == 0
    six = set(map(tuple, lsh_forest.meeting(marks, sides, 6, 0).tolist()))
    assert set(map(tuple, lsh_forest.meeting(marks, sides, 6, 8).tolist())) == six - set(map(tuple, pairs.tolist())) and len(six) > len(pairs)
    few = rng.choice(700, 60, replace=False)
    some, ones, side = [sets[i] for i in few], np.ones(60, np.int64), [np.arange(60)]
    every = np.argwhere(np.triu(np.ones((60, 60), bool), 1))
    for threshold in (share - 0.02, 0.3, 0.8):
        dense, sparse = lsh_forest.compare(some, ones, side, threshold), lsh_forest.compare(some, ones, side, threshold, every)
        assert all((a == b).all() for a, b in zip(dense, sparse))


def brute_features_of(model, text):
    """Words, nearest terms and quotation by plain loops over one text alone."""
    text, quotes = text.lower(), set(toxicity.QUOTES)
    words, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j].isalnum():
            j += 1
        if j > i:
            words.append((i, j))
        i = max(j, i + 1)
    plain = said = 0.0
    for k, (a, b) in enumerate(words):
        near = [(distance(text[a:b], t), n) for n, t in enumerate(model.terms) if distance(text[a:b], t) <= (len(t) >= toxicity.EXACT_BELOW)]
        if near:
            d, n = min(near)
            weight = model.weights[n] if d == 0 else model.forms.get(text[a:b], model.unseen * model.weights[n])
            low, high = words[max(0, k - toxicity.CONTEXT_WORDS)][0], words[min(len(words) - 1, k + toxicity.CONTEXT_WORDS)][1]
            if quotes & set(text[max(0, low - 1) : a]) and quotes & set(text[b : high + 1]):
                said += weight
            else:
                plain += weight
    mild = lambda x: np.sign(x) * np.log1p(abs(x))
    return [1.0, mild(plain), mild(said), plain / max(len(words), 1) ** 0.5, min(plain, 20) / 10]


def test_features_equal_brute_force_whatever_stands_beside():
    rng = np.random.default_rng(11)
    model = toxicity.Model(["moron", "idiot", "scum", "idyll"], [1.5, 2.0, 3.0, -0.5], {"morom": 0.7, "idioot": 1.1})
    pool = ["moron", "morom", "idioot", "idoit", "scum", "scam", "idyl", "fine", "a", "said", "„", '"', "»", "x\"y", "moron”", "“idiot", "é", "\n"]
    texts = ["", '"', "moron", '"', 'moron "', '" moron', '"moron"', "moron", " ", "«", "idiot", "»", *(" ".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(300))]
    got = toxicity.Matcher(model).features(texts)
    assert np.allclose(got, [brute_features_of(model, t) for t in texts])
    assert np.allclose(got[6:7], toxicity.Matcher(model).features(texts[6:7]))


def test_kept_equals_brute_force_over_joint_levels(spark):
    """Each joint level of the path is judged document by document, with the binomial sum written out."""
    import math

    rng = np.random.default_rng(21)
    docs, labels = [], []
    for i in range(1400):
        bad = rng.random() < 0.3
        words = ["w" * int(rng.integers(2, 9)) + str(rng.integers(0, 500)) for _ in range(int(rng.integers(3, 60)))]
        words += ["#" * int(rng.integers(1, 9)) if bad or rng.random() < 0.02 else "ok"] * int(rng.integers(0, 6)) + ["!?"] * int(rng.integers(0, 3 + 4 * bad))
        docs.append((i, " ".join(rng.permutation(words)) + ("\nsame line\nsame line" if rng.random() < 0.2 else ""), ["en", "de", None, "fr"][int(rng.integers(0, 4))]))
        if i % 10:
            labels.append((i, int(not bad)))
    labels += labels[:40]
    df, ls = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = {r["doc_id"]: r.asDict() for r in quality_rules.counted(df).collect()}
    share = lambda r, name: r[quality_rules.RULES[name][0]] / max(r[quality_rules.RULES[name][1]], 1)
    failed = {i: r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"] for i, r in rows.items()}
    good = collections.defaultdict(list)
    for i, q in labels:
        if not failed[i] and rows[i]["stratum"]:
            good[rows[i]["stratum"], q].append(i)
    seen = {i for i, _ in labels}
    sizes = {x: len(good[x, 1]) for x in ("en", "de", "fr")}
    strata = next(sorted(sizes, key=lambda x: (-sizes[x], x))[:m] for m in (3, 2, 1, 0) if m == 0 or sorted(sizes.values())[-m] >= math.log(quality_rules.ALPHA / m) / math.log(1 - quality_rules.MAX_FALSE_REJECTION))
    cut = {}
    for x in strata:
        others = [i for i, r in rows.items() if r["stratum"] == x and not failed[i] and i not in seen]
        over = lambda ids: {name: [sum(share(rows[i], name) > level for i in ids) for level in rule[2]] for name, rule in quality_rules.RULES.items()}
        cut[x], now, n, p = {}, {}, len(good[x, 1]), quality_rules.MAX_FALSE_REJECTION
        for name, k in quality_rules.path(over(good[x, 0]), len(good[x, 0]), over(others), len(others)):
            now[name] = quality_rules.RULES[name][2][k]
            lost = sum(any(share(rows[i], a) > b for a, b in now.items()) for i in good[x, 1])
            if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(lost + 1)) > quality_rules.ALPHA / len(strata):
                break
            cut[x] = dict(now)
    expected = {i: not failed[i] and not any(share(r, a) > b for a, b in cut.get(r["stratum"], {}).items()) for i, r in rows.items()}
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, ls).collect()}
    assert len(strata) >= 2 and got == expected and sum(expected[i] != (not failed[i]) for i in rows) > 20
