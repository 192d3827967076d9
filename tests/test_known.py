"""Known values anywhere in texts, against plain containment."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.functions.vocab import ATTACHED
from tidemark.operators import deid, known

WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}]"


def brute(docs, values, alone):
    out = set()
    for doc_id, text in docs:
        for v in values:
            if not v or not text or v not in text:
                continue
            begins = rf"(?:(?<!{WORD})|(?<=(?<!{WORD})[{''.join(ATTACHED)}]))" if regex.match(WORD, v[0]) else ""
            ends = rf"(?!{WORD})" if regex.match(WORD, v[-1]) else ""
            if not alone(v) or regex.search(begins + regex.escape(v) + ends, text):
                out.add((doc_id, v))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abé ", "אבגל ו", "a1-.😀 "])
@pytest.mark.parametrize("whole", [None, True, False])
def test_held_equals_brute_force(spark, alphabet, whole):
    rng = random.Random(len(alphabet))
    some = lambda low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    docs = [(i, some(0, 60)) for i in range(120)] + [(5, some(20, 90)), (None, some(20, 60)), (200, None), (201, "")]
    values = [some(1, 3) for _ in range(10)] + [some(2, 25) for _ in range(150)] + [d[1][3:30] for d in docs[::4] if d[1]] + [None, "", "a", "ab"]
    df, vs = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(v,) for v in values], "value string")
    rule = {None: lambda v: bool(regex.fullmatch("[0-9A-Za-z_]+", v)), True: lambda v: True, False: lambda v: False}[whole]
    got = deid.held(df, vs, None if whole is None else F.lit(whole)).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(docs, values, rule)


def test_values_inside_words_are_swept_and_fail_the_gate(spark):
    texts = ["ולדנה היה", "ד דן", "xdana@y.com!", "Annabel Anna", "בAnna", None, "", "לדנה-דנה"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [("דנה", "PERSON", "0" * 64), ("dana@y.com", "EMAIL", "1" * 64), ("Anna", "PERSON", "2" * 64)]
    reid = spark.createDataFrame(rows, "value string, type string, key string")
    assert {r["doc_id"]: r["n_leaks"] for r in deid.leaks(docs, reid).collect()} == {0: 1, 2: 1, 3: 1, 4: 1, 7: 1}
    assert {r["doc_id"] for r in deid.gate(docs, reid, patterns=[("X", "zzzz")]).filter("failure_type = 'reid_map'").collect()} == {0, 2, 3, 4, 7}
    got = {r["doc_id"]: r["text"] for r in deid.sweep(docs, reid).collect()}
    person, mail, anna = "PERSON_" + "0" * 64, "EMAIL_" + "1" * 64, "PERSON_" + "2" * 64
    assert got == {0: f"ול{person} היה", 1: "ד דן", 2: f"x{mail}!", 3: f"Annabel {anna}", 4: f"ב{anna}", 5: None, 6: "", 7: f"ל{person}-{person}"}
    swept = deid.sweep(docs, reid).select("doc_id", "text")
    assert deid.leaks(swept, reid).count() == 0 and deid.leaks(docs.limit(0), reid).count() == 0 and deid.leaks(docs, reid.limit(0)).count() == 0


def test_windows_of_equal_bytes_have_equal_hashes():
    import numpy as np

    raw = np.frombuffer(b"abcdefghijkl" * 40, np.uint8)
    windows = known.Windows(raw)
    for size in (1, 2, 5, 8, 9, 30, 100):
        at = np.arange(0, len(raw) - size)
        h = windows.whole(size, at)
        assert (h[at % 12 == 3] == h[3]).all() and len(set(h.tolist())) == 12
        assert known.Windows(raw[7 : 7 + size]).whole(size, np.zeros(1, np.int64))[0] == h[7]


def test_a_full_filter_lets_through_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(known, "MOST_BITS", 1 << 12)
    docs = [(i, f"x{i}y {i * 7} abc-{i}") for i in range(300)]
    values = [f"c-{i}" for i in range(3000)]
    got = known.held(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(v,) for v in values], "value string"))
    assert set(map(tuple, got.collect())) == {(i, v) for i, t in docs for v in values if v in t}
