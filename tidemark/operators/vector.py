"""Filtered vector top-k.

Defined results: a vector without length has no score and comes last; vectors of another length than
the query's score null; ties go by vec_id; repeated rows each count; a caller's own ``score`` stays
under its name, and the new one takes an underscore; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import free_names


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The ``k`` nearest vectors by cosine; the filter runs first, ties go by vec_id.

    A take-ordered plan: each task keeps k rows, so k rows a task reach the driver side of the sort.
    """
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    (score,) = free_names(rows, "score")
    scored = rows.withColumn(score, F.round(cosine(F.col("embedding"), q), 6)).drop("embedding")
    return scored.orderBy(F.desc(score), "vec_id").limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, salts: int = 16) -> DataFrame:
    """The ``k`` nearest vectors of each query within its patient and dates.

    ``queries``: query_id, patient_id, date_from, date_to, query. An equi-join on the patient and a
    salt of the vectors, so that a patient with very many is spread over tasks; each salt keeps its
    k best of a query, and the best of those are left.
    """
    spread = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = vectors.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    pairs = spread.join(dealt, ["patient_id", "_salt"]).filter((F.col("date_from").isNull() | (F.col("session_date") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("session_date") <= F.col("date_to"))))
    scored = pairs.select("query_id", "_salt", "vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("score"))
    best = [F.desc("score"), F.col("vec_id")]
    scored = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*best))).filter(F.col("_rank") <= k)
    return scored.select("query_id", "vec_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("long").alias("rank")).filter(F.col("rank") <= k)
