"""Odd tables for every operator: nulls, empty and long texts, ties, repeats, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _chunk string, score string, c0 string"


def words(rng, n, size=4000):
    return " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_docs(spark):
    rng = random.Random(7)
    base = words(rng, 120)
    edited = base.split()
    edited[60] = "other"
    long = words(rng, 30_000)
    texts = [
        (1, base), (2, base), (3, " ".join(edited)), (4, ""), (5, None), (6, "   \n\t "), (7, "one two"), (8, "one two"), (9, long), (9, long), (10, base[:300] + long[5000:5600]),
        (11, "x" * 500), (12, "x" * 700), (None, base), (None, None), (13, "a\x00b " * 40), (14, "a\x00b " * 40), (15, "line one two\nline one two\nother " * 5), (16, words(rng, 40)),
        (17, "😀é日本語 " * 30), (18, "日本語 " * 31),
    ]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t), "k", "v", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
