"""What a session needs before tasks can run this package's Python functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package's source, once for each application, wherever the driver runs."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="tidemark-src-"), "tidemark_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


_roots: dict[str, str] = {}


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; in local mode one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _roots:
            _roots[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _roots[app].removeprefix("file://"), ignore_errors=True)
        root = _roots[app]
    return f"{root.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex[:12]}"


def saved(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once as Parquet in the shared folder, and read back."""
    path = work_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
