"""Model boundaries with offline stand-ins."""

from pyspark.sql import functions as F

from tidemark.operators import boundary, vector


def test_entities_at_window_edges_are_found_once(spark):
    places = [0, 640, 647, 660, 790, 1297, 2417, 4990]
    text = list("x " * 2500)
    for p in places:
        text[p : p + 6] = " Dana "
    docs = spark.createDataFrame([(1, "".join(text)), (2, "Danax xDana"), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r["start"], r["end"], r["text"]) for r in boundary.entities(docs, boundary.gazetteer(["Dana"])).collect())
    assert got == [(p + 1, p + 5, "Dana") for p in places]
    assert boundary.entities(docs, boundary.gazetteer(["Dana"]), letters=r"\p{IsHebrew}").count() == 0


def test_embedding_is_the_same_everywhere_and_ranks_itself_first(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "d e f", "a b d", "", None])], "vec_id long, text string").repartition(3)
    out = boundary.embed(rows, "text", boundary.hashing_embedder(32))
    got = {r["vec_id"]: r["embedding"] for r in out.collect()}
    assert got[3] is None and got[4] is None and len(got[0]) == 32
    best = vector.top_k(out.filter("embedding is not null"), got[0], 2).collect()
    assert [r["vec_id"] for r in best] == [0, 2] and best[0]["score"] == 1.0


def test_an_error_stops_no_other_row(spark):
    def factory():
        def model(texts):
            if texts[0] == "bad":
                raise ValueError
            return [f"<{t}>" for t in texts]

        return model

    rows = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    assert {r["prompt"]: (r["answer"], r["status"]) for r in boundary.answers(rows, factory).collect()} == {"ok": ("<ok>", "ok"), "bad": (None, "error")}


def test_scores_of_a_judge(spark):
    texts = ['x {"relevance": 5, "faithfulness": 1, "completeness": 9, "fluency": 3}', "none", None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(boundary.scores(F.col("t"))).collect()]
    assert got == [(5, 1, 0, 3), (0, 0, 0, 0), (0, 0, 0, 0)]
