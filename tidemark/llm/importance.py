"""Importance resampling towards a target distribution, on counts of hashed n-grams.

Separators collapse to single spaces; an overlapped ``finditer`` with lookarounds at both ends then
emits each run of n words as one span of bytes, whose CRC names its bucket. A document's weight is
the sum of its buckets' gains (log odds of the target against all documents), and documents are
drawn without replacement by Gumbel noise: those with the highest scores.

Defined results: a null, empty or wordless text has no features and weight 0, and is never drawn; a
null doc_id takes the noise of the empty id and comes after other ids in ties; each row is drawn by
itself, so rows with one id and text take neighbouring ranks; words of any length count, whole; an
empty target gives gains towards rare buckets alone; an empty table gives no rows. Extra columns of
either table are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.store import saved
from tidemark.llm.words import portions

BUCKETS = 10_000
#: Words are digits, letters and all bytes beyond ASCII; the other bytes separate them.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FEATURES = "row long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def spans(n: int) -> regex.Pattern:
    """Runs of ``n`` words in bytes with single spaces; to be searched with ``overlapped=True``."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapsed(text: str | None) -> bytes:
    """Words of a text in lower case (A-Z alone), a space between them."""
    return b" ".join((text or "").encode().translate(_PLAIN).split())


def hashed(plain: bytes, patterns: list[regex.Pattern]) -> np.ndarray:
    """The CRC of every span, in one stream; nothing else of a span is kept."""
    whole = methodcaller("group")
    return np.concatenate([np.fromiter(map(zlib.crc32, map(whole, p.finditer(plain, overlapped=True))), np.uint32) for p in patterns])


def features(docs: DataFrame, n: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """A row of bucket counts for each row of ``docs`` (doc_id, text), written once."""

    def scan(batches):
        patterns = [spans(k) for k in range(n[0], n[1] + 1)]
        for batch in batches:
            for part in portions(batch, 2):
                plain = [collapsed(t) for t in part.column(2).to_pylist()]
                found = [hashed(p, patterns) for p in plain]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                keys = np.repeat(np.arange(len(found)), sizes) * buckets + np.concatenate(found).astype(np.int64) % buckets
                keys, counts = np.unique(keys, return_counts=True)
                at = pa.array(np.searchsorted(keys, np.arange(len(found) + 1) * buckets), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (keys % buckets, counts)]
                words = pa.array([p.count(b" ") + 1 if p else 0 for p in plain], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words, pa.array(sizes), *lists], ["row", "doc_id", "n_words", "n_features", "buckets", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(scan, FEATURES), "features")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts and where each row's begin (n + 1)."""
    buckets, counts = batch.column(batch.schema.names.index("buckets")), batch.column(batch.schema.names.index("counts"))
    at = buckets.offsets.to_numpy()
    return buckets.flatten().to_numpy(), counts.flatten().to_numpy(), at - at[0]


def totals(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows; each task sends a sum for each bucket, not its words."""

    def add(batches):
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            of, counts, _ = _lists(batch)
            np.add.at(out, of, counts)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["bucket", "n"])

    return counted.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counted: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log odds of each bucket, rounded down; as many numbers as buckets reach the driver."""
    spark = counted.sparkSession
    s, t = (saved(totals(x, buckets), "totals") for x in (counted, target))
    all_s, all_t = ((x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) for x in (s, t))
    rows = spark.range(buckets).withColumnRenamed("id", "bucket").join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    plus = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + F.lit(1.0)
    odds = plus("t") * F.lit(float(all_s + buckets)) / (plus("s") * F.lit(float(all_t + buckets)))
    out = rows.select("bucket", F.floor(F.lit(1000.0) * F.ln(odds)).alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in out], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the first 32 bits of the SHA-256 of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, n: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    Of the N documents with ``least_words`` words, ``percent`` of a hundred are drawn, rounded down.
    Ranks come from one sort by ranges: a row's place in its range and the sizes of the ranges before it.
    """
    counted = features(docs, n, buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(counted, features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets), buckets))

    def weigh(batches):
        for batch in batches:
            of, counts, at = _lists(batch)
            upto = np.concatenate([[0], np.cumsum(gain.value[of] * counts)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(upto[at[1:]] - upto[at[:-1]])], ["row", "doc_id", "n_words", "n_features", "weight"])

    rows = counted.mapInArrow(weigh, "row long, doc_id long, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("open", F.col("n_words") >= least_words)
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    return _ranked(placed, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def _ranked(placed: DataFrame, percent: int) -> DataFrame:
    """``at`` holds the range in its upper bits and the place there in the lower 33."""
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("n_open")).orderBy("part").collect()  # a row for each range
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    drawn = sum(r["n_open"] for r in sizes) * percent // 100
    starts = placed.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(F.col("open") & (rank <= drawn), rank))


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has a rank, with all their columns."""
    return docs.join(ranks.filter("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
