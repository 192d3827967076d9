"""Exact inner-product top k by an impact-ordered index, score at a time.

Vectors are dealt into shards. A shard keeps, for each dimension and each quantised value, one posting
segment: the vectors that have it, and the least and largest value among them. A query takes a shard's
segments by descending impact (its own component times the segment's largest value) and adds up, for
each vector, an upper bound of what it has seen. What is unseen is bounded by Cauchy and Schwarz: the
norm of the query's unseen part times that of the vector's. Once the bounds of all but a few vectors
lie below the k-th best score known, these few are all possible members, and are scored exactly; with
no such proof all segments are taken. The k-th best score among the vectors of one shard is known to
all others from the start.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part,
nor do rows without id; the shorter of two vectors counts as filled up with zeros, an empty one scores
0; all rows with a query's id are its own, so none of them is its neighbour; other repeated rows are
neighbours each by itself, and each of repeated queries has its own answer; ties go to the smaller id;
extra columns are not read; an empty table gives none. A score beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.store import saved

#: Vectors of a shard, about; queries that meet a shard in one task; values that a dimension's are rounded to.
SHARD, BLOCK, LEVELS = 2048, 1024, 64
SEGMENTS = "shard long, dim int, low array<long>, high array<long>, sizes array<int>, members binary, ids binary, vectors binary, width int"
ANSWER = "q long, times long, query_id long, vec_id long, score long"
#: Shares of a shard's postings after which bounds are compared.
ROUNDS = (0.15, 0.3, 0.45, 0.6, 0.8)


def quantised(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, vec_id and integer components of the vectors that take part, written once."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ok = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: odd(x.cast("double")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.filter(ok).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("vector"))
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def build(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index of ``quantised`` rows: for each shard a row for each dimension (its segments by ascending value), and one with ids and vectors."""
    shards = max(1, -(-rows.count() // shard))
    return saved(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInArrow(_segments, SEGMENTS), "index")


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _segments(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    v = matrix(rows["vector"])
    told: dict[str, list] = {name: [] for name in ("dim", "low", "high", "sizes", "members")}
    step = max(1, int(np.ptp(v.astype(np.float64), axis=None) / LEVELS) + 1) if v.size else 1
    for d in range(v.shape[1]):
        order = np.argsort(v[:, d], kind="stable")
        values = v[order, d]
        first = np.flatnonzero(np.diff(values // step, prepend=values[0] // step - 1))
        last = np.append(first[1:], len(order))
        for name, x in (("dim", d), ("low", values[first]), ("high", values[last - 1]), ("sizes", (last - first).astype(np.int32)), ("members", order.astype(np.uint32).tobytes())):
            told[name].append(x)
    n = v.shape[1]
    none = [None] * n
    columns = [
        pa.array([rows["shard"][0].as_py()] * (n + 1), pa.int64()), pa.array([*told["dim"], None], pa.int32()), pa.array([*told["low"], None], pa.list_(pa.int64())), pa.array([*told["high"], None], pa.list_(pa.int64())),
        pa.array([*told["sizes"], None], pa.list_(pa.int32())), pa.array([*told["members"], None], pa.binary()), pa.array([*none, rows["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([*none, v.tobytes()], pa.binary()), pa.array([*none, n], pa.int32()),
    ]
    return pa.Table.from_arrays(columns, ["shard", "dim", "low", "high", "sizes", "members", "ids", "vectors", "width"])


def inner(v: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Exact products of rows with a query; ``most`` bounds each of them."""
    if most < 1 << 52:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return v @ q
    exact = [sum(a * b for a, b in zip(row, q.tolist())) for row in v.tolist()]
    return np.array(exact, np.int64).reshape(len(v))  # raises beyond 64 bits


class Shard:
    """Posting segments of some vectors, and the vectors themselves in order of their ids."""

    def __init__(self, rows: pa.Table) -> None:
        whole = rows.filter(pc.is_null(rows["dim"])).slice(0, 1).to_pylist()[0]
        rows = rows.filter(pc.is_valid(rows["dim"])).sort_by("dim")
        self.ids = np.frombuffer(whole["ids"], np.int64)
        self.v = np.frombuffer(whole["vectors"], np.int64).reshape(len(self.ids), whole["width"])
        flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.array(x.as_py(), kind) for x in rows[name])])
        self.low, self.high, self.size = flat("low", np.float64), flat("high", np.float64), flat("sizes", np.int64)
        self.dim = np.repeat(np.arange(self.v.shape[1]), [len(x) for x in rows["sizes"]])
        self.members = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in rows["members"])])
        self.begin = np.cumsum(self.size) - self.size
        self.least = np.where((self.low <= 0) & (self.high >= 0), 0.0, np.minimum(self.low**2, self.high**2))  # of a member's square
        self.peak = np.maximum(np.abs(self.low), np.abs(self.high))
        self.norm = (self.v.astype(np.float64) ** 2).sum(1)
        self.exact = self.v.astype(np.float64)

    def best(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at most ``k`` members whose score reaches ``floor``: the best ones, ties to smaller ids."""
        n = len(self.ids)
        q = np.zeros(self.v.shape[1], np.int64)
        q[: min(len(q), len(query))] = query[: len(q)]
        most = len(q) * int(np.abs(q.astype(np.float64)).max(initial=0)) * int(self.peak.max(initial=0))
        others = self.ids != own
        alive = np.flatnonzero(others)
        x = q.astype(np.float64)
        upper, seen_q, seen_v = np.zeros(n), np.zeros(n), np.zeros(n)
        norm = float(x @ x)
        slack = 1 + 1e-9 * np.sqrt(norm * self.norm)  # of rounding in bounds
        bound = np.maximum(x[self.dim] * self.low, x[self.dim] * self.high)
        order = np.argsort(-np.abs(x[self.dim]) * self.peak, kind="stable")
        upto = np.cumsum(self.size[order])
        at, enough = 0, max(4 * k, n // 32)
        for share in ROUNDS:
            if len(alive) <= enough:
                break
            stop = int(np.searchsorted(upto, share * len(self.members))) + 1
            taken, at = order[at:stop], stop
            sizes = self.size[taken]
            places = np.repeat(self.begin[taken] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            places = self.members[places]
            for out, w in ((upper, bound[taken]), (seen_q, x[self.dim[taken]] ** 2), (seen_v, self.least[taken])):
                out += np.bincount(places, np.repeat(w, sizes), n)
            if floor is None and len(alive) > k:  # the best so far, scored exactly, bound the k-th best
                some = alive[np.argpartition(-upper[alive], k - 1)[:k]]
                floor = int(inner(self.v[some], q, most).min())
            if floor is not None:
                rest = np.sqrt(np.maximum(norm - seen_q[alive], 0) * np.maximum(self.norm[alive] - seen_v[alive], 0))
                alive = alive[upper[alive] + rest + slack[alive] >= floor]
        scores = (self.exact[alive] @ x).astype(np.int64) if most < 1 << 52 else inner(self.v[alive], q, most)
        if floor is not None:
            alive, scores = alive[scores >= floor], scores[scores >= floor]
        top = np.lexsort((alive, -scores.astype(object) if most >= 1 << 62 else -scores))[:k]  # places are in order of ids
        return self.ids[alive[top]], scores[top]


def _search(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(index) and len(queries):
            shard, asked = Shard(index), matrix(queries["vector"])
            for query, q, times, own, floor in zip(asked, *(queries[c].to_pylist() for c in ("q", "times", "vec_id", "floor"))):
                ids, scores = shard.best(query, own, k, floor)
                for to, x in zip(out, ([q] * len(ids), [times] * len(ids), [own] * len(ids), ids.tolist(), scores.tolist())):
                    to += x
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], ["q", "times", "query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of each of ``queries`` (vec_id, vector).

    A task has one shard and one block of queries. Queries are copied once for each shard, the index once for each block.
    """
    asked = saved(queries.groupBy("vec_id", "vector").agg(F.count("*").alias("times")).withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // block))
    shards = index.agg(F.max("shard")).first()[0] or 0
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))

    def met(of: DataFrame, rows: DataFrame, among: Column) -> DataFrame:
        left = of.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        right = rows.withColumn("shard", F.explode(among))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), ANSWER)

    first = met(index.filter("shard = 0"), asked.withColumn("floor", F.lit(None).cast("long")), F.array(F.lit(0).cast("long")))
    floors = saved(first.groupBy("q").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).select("q", "floor"), "floors")
    found = met(index, asked.join(floors, "q", "left"), F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` nearest of all rows for each row whose vec_id is divisible by ``every``."""
    rows = quantised(vectors, scale)
    return search(build(rows), rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vector"), k)
