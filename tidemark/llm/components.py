"""Connected components of a distributed edge list, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.llm.store import saved

SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b): root is its component's least node.

    Labels form trees that point to smaller nodes. Each round every root with a smaller neighbour is
    hooked on the least one, each node takes the label of its label, and each edge then stands
    between the labels of its ends: what fell together is dropped, what became equal is one edge. A
    group tied many times so costs its edges about once, not once a round. Chains of n nodes settle in
    about log2(n) rounds, whatever the order of their ids. Rounds go on until no edge is left and no
    label moves, which the writes of a round count themselves; they go to the shared folder, so a
    lost executor repeats one round. Edges with nulls are left out; repeated edges and loops do no harm.
    """
    near = saved(edges.dropna(subset=["a", "b"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = near.select(F.col("b").alias("node"), "a").unionByName(near.select(F.col("a").alias("node"), "a"))
    labels, hooks = ends.groupBy("node").agg(F.min("a").alias("root")), None
    left = True
    while True:
        # labels that have a smaller label themselves, or are hooked; one of many nodes is met in SALTS tasks
        tops = labels.filter("root < node").select(F.col("node").alias("root"), F.col("root").alias("top")).join(labels.select("root").distinct(), "root", "left_semi")
        tops = tops if hooks is None else tops.unionByName(hooks)
        step, moved = spread(labels, tops, ["root"], "node", "left"), Observation()
        labels = saved(step.observe(moved, F.count("top").alias("n")).select("node", F.coalesce("top", "root").alias("root")), "labels")
        if left:
            for end in ("a", "b"):
                near = near.join(labels.select(F.col("node").alias(end), F.col("root").alias("_root")), end).withColumn(end, F.col("_root")).drop("_root")
            near = near.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            kept = Observation()
            near = saved(near.observe(kept, F.count(F.lit(1)).alias("n")), "edges")
            left = bool(kept.get.get("n"))
        if not left and not moved.get.get("n"):
            return labels
        hooks = near.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("top")).join(labels.filter("root = node").select("root"), "root", "left_semi") if left else None


def spread(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join on ``keys``, unique on the right; a key of many rows on the left is met in SALTS tasks, dealt by ``by``.

    Merged, never broadcast: the planner does not see that the right side has SALTS times its rows.
    """
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(right, [*keys, "_salt"], how).drop("_salt")


def components_of_some_first(edges: DataFrame, first: Column) -> DataFrame:
    """``components`` of edges that mostly tell the same: those with ``first`` are settled before the others.

    The others then are edges between roots, of which few are no loops.
    """
    some = saved(components(edges.filter(first).select("a", "b")), "some")
    rest = edges.filter(~first).select("a", "b").dropna()
    for end, other in (("a", "b"), ("b", "a")):
        rest = spread(rest, some.select(F.col("node").alias(end), F.col("root").alias("_root")), [end], other, "left")
        rest = rest.withColumn(end, F.coalesce("_root", end)).drop("_root")
    more = components(saved(rest.filter("a <> b").distinct(), "rest"))
    tops = spread(some, more.select(F.col("node").alias("root"), F.col("root").alias("_top")), ["root"], "node", "left")
    tops = tops.select("node", F.coalesce("_top", "root").alias("root"))
    return tops.unionByName(more.join(some.select("node"), "node", "left_anti"))
