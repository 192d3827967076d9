"""Continuous loads: micro-batches of rows merged into a versioned table, late-data counts, and files as they come.

Defined results: a repeated batch changes nothing; rows with a null key are one key; a null time is in no
window; a row later than the watermark is left out of windows that are closed; empty batches write nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.store import Database, VersionedTable


def merge_stream(rows: DataFrame, target: VersionedTable, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Last write wins, batch by batch; a repeated batch changes nothing, as merging is idempotent."""

    def apply(batch: DataFrame, _: int) -> None:
        target.merge(batch, keys, order)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(rows: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are left out of closed windows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def merge_counts(rows: DataFrame, target: VersionedTable, time: str, key: str, checkpoint: str) -> StreamingQuery:
    """Counts by window kept in ``target``: each batch brings the windows that changed, and the state of closed ones is dropped."""
    counts = counts_by_window(rows, time, key)
    merged = lambda batch, _: target.merge(batch, ["start", key], ["n"])  # noqa: E731  a window's count only grows
    return counts.writeStream.outputMode("update").foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edited(found: DataFrame, log: DataFrame | None) -> DataFrame:
    """Of ``found`` (path, modificationTime, ...), the files that the log (path, ingested_at) has and that were written since."""
    if log is None:
        return found.limit(0)
    known = log.select("path", F.col("ingested_at").alias("_at"))
    return found.join(known, "path").filter(F.col("modificationTime") >= F.col("_at")).select(*found.columns)


def take_files(spark: SparkSession, roots: list[str], root: str, checkpoint: str, at: Callable[[], Column], **how) -> list[DataFrame]:
    """Word files below ``roots`` go through ``jobs.ingest.run`` into the database at ``root``: the status of each, by batch.

    New files come by a stream, which knows a path once it has seen it; files edited in place are found by
    their time of writing, of which a listing alone is read. The hash in the log decides: a file that was touched
    but holds what it held is skipped. A batch that is repeated after a crash changes nothing.
    """
    from tidemark.jobs import ingest
    from tidemark.sources import docx

    out: list[DataFrame] = []

    def run(batch: DataFrame, _: int = 0) -> None:
        out.append(ingest.run(spark, docx.documents(docx.described(batch)), root, at(), **how))

    of = lambda folder: spark.readStream.schema(docx.LISTED).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    stream = of(roots[0])
    for more in roots[1:]:
        stream = stream.unionByName(of(more))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    listed = docx.listing(spark, roots)
    changed = edited(listed.select("path", "modificationTime"), Database(spark, root).read("log"))
    again = listed.join(changed.select("path"), "path", "left_semi")
    if not changed.isEmpty():
        run(again)
    return out
