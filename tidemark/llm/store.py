"""Tables and files that cut a lineage, kept where every executor can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.session import work_folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder URI below ``spark.checkpoint.dir``, which all executors share."""
    return work_folder(spark, label)


def saved(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet by Spark's own committer, and read back."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_files(uri: str):
    """A file system for ``uri`` and the path in it, for formats Spark has no writer for."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_file(uri: str, parts) -> str:
    """Stream ``parts`` (bytes) to a file that no other attempt of the task writes; its URI.

    A retried or speculative task makes another file; readers go by the manifest that Spark
    commits, so the leftover of a lost attempt is never read.
    """
    folder, _, name = uri.rpartition("/")
    own = f"{folder}/{uuid.uuid4().hex[:8]}-{name}"
    system, path = open_files(own)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)
    return own
