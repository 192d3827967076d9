"""The corpus pipeline against a chain of brute forces."""

import collections
import random

import pytest
from fixtures import no_docs, odd_docs
from test_operators import brute_links, brute_suffix, crc, ids_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def removed(rows):
    """What is left of each text: bytes of 50-byte strings that a smaller id has are gone, and so are characters that lost a byte."""
    key = lambda d: (d is None, d or 0)
    seen, raw = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], key(d)), key(d))
    out = []
    for (d, b), (_, text) in zip(raw, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < key(d):
                gone[p : p + 50] = b"\1" * 50
        out.append((d, bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else text))
    return out


def small(spark, tmp_path):
    """A folder of tables whose documents hold near copies, a shared passage, a leak, toxic texts and repeated ids."""
    rng = random.Random(3)
    word = lambda n=6: "".join(rng.choice("bcdfgklmnprstv") for _ in range(n))
    common = [word() for _ in range(400)]
    plain = lambda n=60: " ".join(rng.choice(common) for _ in range(n))
    rows, labels = [], []
    for i in range(60):
        rows.append((i, plain()))
        labels.append((i, 0))
    for i in range(60, 90):
        rows.append((i, f"{plain(20)} you moron {plain(20)}"))
        labels.append((i, 1))
    passage, item = plain(40), plain(30)
    near = plain(100).split()
    other = list(near)
    other[50] = "changed"
    rows += [(100, " ".join(near)), (101, " ".join(other)), (102, " ".join(near)), (103, f"{plain(30)} {passage} {plain(30)}"), (104, f"{passage} {plain(50)}"), (105, f"{plain(40)} {item} {plain(40)}")]
    rows += [(106, ""), (107, None), (None, plain(30)), (108, plain(30)), (108, plain(30)), (109, "two words"), (110, "two words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, node string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, x) for d, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_pipeline_equals_a_chain_of_brute_forces(spark, tmp_path):
    sf, rows = small(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, key = docs.columns, lambda x: str(x)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)

    kept = stages["toxicity"](spark, docs, sf)
    want = sorted(((d, t) for d, t in rows if "moron" not in (t or "")), key=key)
    assert kept.columns == columns and pairs(kept) == want

    docs = spark.createDataFrame(kept.collect(), kept.schema)
    kept = stages["ngram_jaccard"](spark, docs, sf)
    classes = {}
    for (d, c, _), in zip(brute_links(want)):
        classes.setdefault(d, set()).add(c)
    seen, left = set(), []
    for d, t in want:
        alone = d is None or not (t or "").split()
        if alone or (d in classes[d] and (d, t) not in seen):
            left.append((d, t))
            seen.add((d, t))
    assert kept.columns == columns and pairs(kept) == sorted(left, key=key)

    docs = spark.createDataFrame(kept.collect(), kept.schema)
    kept = stages["suffix_dedup"](spark, docs, sf)
    want = sorted(removed(left), key=key)
    assert kept.columns == columns and pairs(kept) == want and brute_suffix(left)

    docs = spark.createDataFrame(kept.collect(), kept.schema)
    kept = stages["decontamination"](spark, docs, sf)
    want = [x for x in want if x[0] != 105]
    assert kept.columns == columns and pairs(kept) == want

    pieces = stages["packing"](spark, spark.createDataFrame(kept.collect(), kept.schema), sf).collect()
    check_pieces(pieces, want)
    check_pieces(corpus_pipeline.run(spark, sf).collect(), want)


def check_pieces(pieces, rows):
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[d].append(ids_of(t))
    held = collections.Counter()
    for p in pieces:
        assert any(p["ids_crc32"] == crc(x[p["start"] : p["start"] + p["length"]]) for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"])
        held[p["doc_id"]] += p["length"]
    assert held == {d: sum(map(len, x)) for d, x in ids.items()}


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_stages_take_odd_and_empty_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.schema == docs.schema and kept.count() <= docs.count(), name
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0) == (docs.count() == 0)
