"""Exact vector top-k over cells: most rows are ruled out by what is known of their cell.

Vectors of length one are dealt to the nearest of a few centroids; a cell is what one centroid has of
one key within one span of dates. Of each cell its count, its dates and its least and largest distance
from the centroid are kept. A query first reads the cells that could hold the nearest vectors, until
they hold k; the k-th score then closes every cell whose bound (the triangle inequality, on chords)
does not reach it, and the others are read. So the result is that of a scan, whatever the centroids
are; they are fitted to a bounded sample and decide only how much is read.

Defined results: as ``vector.top_k_batch``, that is, scores are rounded to six digits, ties go by vec_id, vectors
without length or of another length than the query's score null and come last; those with null or infinite
components or NaN score null, too; a null key meets no query; rows without a date count for queries without
dates alone; repeated rows each count; repeated query ids are one query that must not differ; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.session import work_folder
from tidemark.operators.vector import cosine, dot

#: Rows that centroids are fitted to, about; parts that a cell's rows are dealt to.
FIT_ROWS, SALTS = 100_000, 16

#: Rounding of a score, and of the arithmetic behind a bound.
SLACK = 2e-6


class Found(NamedTuple):
    """``hits`` (query_id, vec_id, score, rank) and ``visits`` (query_id, the cells, their count ``n``, and whether ``first`` or later)."""

    hits: DataFrame
    visits: DataFrame


def _unit(v: Column) -> Column:
    """``v`` at length one; null if it has none, or if a component is null, infinite or no number."""
    length = F.sqrt(dot(v, v))
    return F.when((length > 0) & (length < F.lit(float("inf"))), F.transform(v, lambda x: x / length))


def _chord(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * dot(a, b)))


@dataclass
class CellIndex:
    """Vectors by cell in ``rows``, what is known of each cell in ``cells``, and the ``centroids``."""

    rows: DataFrame
    cells: DataFrame
    centroids: DataFrame
    by: list[str]

    @classmethod
    def build(cls, vectors: DataFrame, by: list[str], k: int = 64, span: str = "quarter", fit_rows: int = FIT_ROWS, seed: int = 1) -> CellIndex:
        """Index ``vectors`` (vec_id, session_date, embedding, and the keys ``by``).

        At most ``k`` centroids, of as many components as most of the sample have, are broadcast: 8 MB at
        1,024 of 1,024. Rows that no centroid fits (no direction, another length) have the cells -1 and -2.
        """
        spark, home = vectors.sparkSession, work_folder(vectors.sparkSession, "cells")
        known = vectors.select("vec_id", "session_date", "embedding", *by).withColumn("_unit", _unit(F.col("embedding"))).withColumn("_size", F.size("embedding"))
        total = known.filter("_unit is not null").count()
        sample = known.filter("_unit is not null").sample(min(1.0, fit_rows / max(total, 1)), seed=seed)
        sizes = sample.groupBy("_size").count().orderBy(F.desc("count"), "_size").first()
        centres = []
        if sizes is not None:
            fit = sample.filter(F.col("_size") == sizes["_size"]).select(array_to_vector("_unit").alias("features"))
            centres = [(i, [float(x) for x in c]) for i, c in enumerate(KMeans(k=max(2, k), seed=seed, maxIter=8).fit(fit).clusterCenters())]
        centroids = spark.createDataFrame(centres, "_cell int, _centre array<double>")
        # One row of all centroids beside each vector, without a shuffle: distances are told in the JVM.
        table = centroids.agg(F.sort_array(F.collect_list(F.struct("_cell", "_centre"))).alias("_all"))
        near = F.array_min(F.transform("_all", lambda c: F.struct((-dot(c["_centre"], F.col("_unit"))).alias("far"), c["_cell"].alias("cell"))))
        size = sizes["_size"] if sizes is not None else -1
        placed = (
            known.crossJoin(F.broadcast(table))  # a single row
            .withColumn("_cell", F.when(F.col("_unit").isNull(), F.lit(-1)).when(F.col("_size") != size, F.lit(-2)).otherwise(near["cell"]))
            .drop("_all")
            .withColumn("_span", F.trunc("session_date", span))
            .withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
            .join(F.broadcast(centroids), "_cell", "left")
            .withColumn("_far", _chord(F.col("_unit"), F.col("_centre")))
            .drop("_unit", "_size", "_centre")
        )
        # Files of one cell and few keys: a query's cells tell the folders, and the keys' least and largest values the row groups.
        placed.repartitionByRange("_cell", *by, "_span", "_salt").sortWithinPartitions("_cell", *by, "_span").write.partitionBy("_cell").parquet(f"{home}/rows")
        rows = spark.read.schema(placed.schema).parquet(f"{home}/rows")
        summary = rows.groupBy(*by, "_span", "_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_far").alias("least"), F.max("_far").alias("most"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))
        summary.write.parquet(f"{home}/cells")
        return cls(rows, spark.read.schema(summary.schema).parquet(f"{home}/cells"), centroids, by)

    def top_k(self, queries: DataFrame, k: int = 10) -> Found:
        """The ``k`` nearest vectors of each of ``queries`` (query_id, date_from, date_to, query, and the keys), in two readings."""
        home = work_folder(queries.sparkSession, "cell-search")
        asked = queries.select("query_id", "date_from", "date_to", "query", *self.by).dropDuplicates(["query_id"])
        spans = asked.join(self.cells, self.by).filter(_within(F.col("last_date"), F.col("first_date")))
        whole = F.coalesce(F.col("date_from").isNull() | (F.col("first_date") >= F.col("date_from")), F.lit(False)) & F.coalesce(F.col("date_to").isNull() | (F.col("last_date") <= F.col("date_to")), F.lit(False))
        away = F.when((F.size("query") == F.size("_centre")) & F.col("_unit").isNotNull(), _chord(F.col("_unit"), F.col("_centre")))
        near = F.greatest(F.lit(0.0), F.col("_away") - F.col("most"), F.col("least") - F.col("_away"))
        # What a cell's best score can be: nothing in -1 scores at all; what no distance is known of may hold anything.
        best = F.when(F.col("_cell") == -1, F.lit(-2.0)).when(F.col("_away").isNull(), F.lit(2.0)).otherwise(F.lit(1.0) - near * near / 2)
        bounds = (
            spans.join(F.broadcast(self.centroids), "_cell", "left")
            .withColumn("_unit", _unit(F.col("query")))
            .withColumn("_away", away)
            .select("query_id", "_cell", "_span", "n", best.alias("best"), F.coalesce("_away", F.lit(0.0)).alias("away"), F.when(whole & (F.col("_cell") >= 0), F.col("n")).otherwise(0).alias("sure"))
        )
        order = Window.partitionBy("query_id").orderBy(F.desc("best"), "away", "_cell", "_span").rowsBetween(Window.unboundedPreceding, -1)
        bounds.withColumn("first", F.coalesce(F.sum("sure").over(order), F.lit(0)) < k).write.parquet(f"{home}/bounds")
        told = queries.sparkSession.read.parquet(f"{home}/bounds")
        opened = self._read(asked, told.filter("first"), k)
        opened.write.parquet(f"{home}/opened")
        opened = queries.sparkSession.read.schema(opened.schema).parquet(f"{home}/opened")
        closing = opened.groupBy("query_id").agg(F.count("score").alias("scored"), F.min("score").alias("last"))
        later = told.filter("not first").join(closing, "query_id", "left").filter(F.col("scored").isNull() | (F.col("scored") < k) | (F.col("best") >= F.col("last") - SLACK)).select(told.columns)
        later.write.parquet(f"{home}/later")
        later = queries.sparkSession.read.schema(later.schema).parquet(f"{home}/later")
        hits = _best(opened.unionByName(self._read(asked, later, k)), ["query_id"], k)
        visits = told.filter("first").unionByName(later).select("query_id", "_cell", "_span", "n", "first")
        return Found(hits.select("query_id", "vec_id", "score", F.col("_rank").cast("long").alias("rank")), visits)

    def _read(self, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """The k best of each query in the cells it visits; a cell's rows and its queries meet in salted tasks, and each salt keeps k."""
        spread = asked.join(visits.select("query_id", "_cell", "_span"), "query_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = spread.withColumnRenamed("_span", "_asked").join(self.rows, [*self.by, "_cell", "_salt"]).filter(F.col("_span").eqNullSafe(F.col("_asked")) & _within(F.col("session_date"), F.col("session_date")))
        finite = F.when(F.col("_cell") != -1, F.round(cosine(F.col("embedding"), F.col("query")), 6))
        scored = pairs.select("query_id", "_salt", "vec_id", F.nanvl(finite, F.lit(None).cast("double")).alias("score"))
        return _best(_best(scored, ["query_id", "_salt"], k).drop("_rank"), ["query_id"], k).drop("_salt", "_rank")


def _within(late: Column, early: Column) -> Column:
    """Whether a span of dates from ``early`` to ``late`` can hold one that the query asks for."""
    return (F.col("date_from").isNull() | (late >= F.col("date_from"))) & (F.col("date_to").isNull() | (early <= F.col("date_to")))


def _best(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id"))
    return scored.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
