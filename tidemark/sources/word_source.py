"""Word files as a Spark data source: ``spark.read.format("docx")`` and ``df.write.format("docx")``.

Reading: partitions of files of about ``partitionBytes`` (64 MB) each, listed below the path; options
``recursive`` (true) and ``prefix`` (of file names). A schema given to the reader names the columns that are made:
without ``paragraphs``, ``cells`` and ``error`` no file is taken apart, and without ``hash`` none is opened.

Writing: one file for each row (name, paragraphs, and headings: the ordinals of paragraphs that are headings).
A task writes to a folder of its own, which no reader sees; the commit gives each a name by one rename, so what
failed and doubled tasks leave is never read. ``overwrite`` removes what was there once the new files are in place.

Paths are those that pyarrow opens (file, hdfs and s3 among them); ``docx.files`` takes all that Spark opens.

Defined results: a file that is no Word file has an error and null paragraphs and cells; lock files (``~$``) and
files below folders that begin with ``_`` or ``.`` are left out; folders without such files give no rows; rows to
write without a name, or with one that holds a slash or is taken in the task, fail the write; null paragraphs are none.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources import docx

_TYPES = {"path": pa.string(), "folder": pa.string(), "hash": pa.string(), "length": pa.int64(), "paragraphs": pa.list_(pa.string()), "cells": pa.list_(pa.list_(pa.string())), "error": pa.string()}
_SCHEMA = "path string, folder string, hash string, length long, paragraphs array<string>, cells array<array<string>>, error string"


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    count: int


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith(("/", "file:")) else posixpath.abspath(root))


def _listed(root: str, recursive: bool = True) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Word files below ``root``; a folder that begins with ``_`` or ``.`` hides what is in it."""
    system, base = _opened(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=recursive, allow_not_found=True))
    shown = lambda path: not any(p.startswith(("_", ".")) for p in posixpath.relpath(path, base).split("/")[:-1])
    return system, [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".docx") and not f.base_name.startswith("~") and shown(f.path)]


class WordReader(DataSourceReader):
    def __init__(self, columns: list[str], options: Mapping[str, str]) -> None:
        unknown = set(columns) - set(_TYPES)
        if unknown:
            raise ValueError(f"a Word file has no {sorted(unknown)}")
        self.columns, self.root, self.prefix = columns, options["path"], options.get("prefix", "")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.size = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[Files]:
        found = sorted((f.path, f.size or 0) for f in _listed(self.root, self.recursive)[1] if f.base_name.startswith(self.prefix))
        out, held = [], self.size
        for path, size in found:
            # A file costs an opening, however short it is.
            held += size + (1 << 20)
            if held > self.size:
                out.append(Files([]))
                held = size + (1 << 20)
            out[-1].files.append((path, size))
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)
        for at in range(0, len(partition.files), 64):
            rows = [self._row(system, *file) for file in partition.files[at : at + 64]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES[c]) for c in self.columns], self.columns)

    def _row(self, system: fs.FileSystem, path: str, size: int) -> dict:
        row = dict.fromkeys(_TYPES) | {"path": path, "folder": posixpath.basename(posixpath.dirname(path)), "length": size}
        taken = {"paragraphs", "cells", "error"} & set(self.columns)
        if taken or "hash" in self.columns:
            with system.open_input_stream(path, compression=None) as source:
                content = source.read()
            row["hash"] = hashlib.sha256(content).hexdigest()
            if taken:
                try:
                    row["paragraphs"], row["cells"] = docx.parse(content)
                except Exception as error:  # noqa: BLE001  the file is at fault, whatever is wrong with it
                    row["error"] = type(error).__name__
        return row


class WordWriter(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _opened(self.root)
        folder, names = f"_{uuid.uuid4().hex}", set()
        for batch in iterator:
            columns = batch.to_pydict()
            heads = columns.get("headings", [None] * batch.num_rows)
            for name, lines, marked in zip(columns["name"], columns["paragraphs"], heads):
                if not name or "/" in name or name.startswith("~") or not name.endswith(".docx") or name in names:
                    raise ValueError(f"{name!r} is no name for a Word file, or is taken")
                names.add(name)
                made = io.BytesIO()
                docx.write(made, [(line or "", i in set(marked or [])) for i, line in enumerate(lines or [])])
                system.create_dir(f"{base}/{folder}", recursive=True)
                with system.open_output_stream(f"{base}/{folder}/{name}", compression=None) as to:
                    to.write(made.getvalue())
        return Written(folder, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.root)
        system.create_dir(base, recursive=True)
        old = [f for f in system.get_file_info(fs.FileSelector(base)) if not f.base_name.startswith(("_", "."))] if self.overwrite else []
        for message in messages:
            if message is not None and message.count:
                system.move(f"{base}/{message.folder}", f"{base}/part-{message.folder[1:]}")
        for entry in old:
            system.delete_dir(entry.path) if entry.type == fs.FileType.Directory else system.delete_file(entry.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.root)
        for message in messages:
            if message is not None and message.count:
                system.delete_dir(f"{base}/{message.folder}")


class WordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> WordReader:
        return WordReader(schema.names, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WordWriter:
        if not {"name", "paragraphs"} <= set(schema.names):
            raise ValueError("rows to write need name and paragraphs")
        return WordWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session; once is enough."""
    spark.dataSource.register(WordSource)
    return spark
