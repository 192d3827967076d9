"""Keyed writes without a table format: last write wins, cascades, incremental loads, versions.

Defined results: a null key is a key like any other; repeated rows count once; extra columns, whatever
their names, come through; empty tables give no rows.
"""

from __future__ import annotations

import functools
import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.functions.columns import free_names


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the last by ``order``; one aggregation, partial before the shuffle.

    ``order`` columns are non-null and tell the rows of a key apart, or equal rows are alike.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    (own,) = free_names(rows, "_last")
    return rows.groupBy(*keys).agg(last.alias(own)).select(*keys, *[F.col(own)[c].alias(c) for c in rest]).select(*rows.columns)


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing and incoming rows, last write wins; incoming wins a tie of ``order``."""
    (new,) = free_names(existing, "_new")
    both = existing.withColumn(new, F.lit(0)).unionByName(incoming.withColumn(new, F.lit(1)))
    return upsert(both, keys, [*order, new]).drop(new)


def overwritten(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of each key lost."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("n_lost")).filter("n_lost > 0")


def set_values(rows: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Conditional update: ``column`` from ``updates`` where it has the key."""
    (own,) = free_names(rows, "_new")
    new = updates.select(*keys, F.col(column).alias(own))
    return rows.join(new, keys, "left").withColumn(column, F.coalesce(own, column)).select(*rows.columns)


def without_sources(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose source is not among ``gone``'s."""
    return rows.join(gone.select(F.col(column)).distinct(), column, "left_anti").select(*rows.columns)


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children without those that share the keys of a deleted parent."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti").select(*children.columns)


def changed(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose path and hash the log lacks, and whether they are new or changed."""
    (old,) = free_names(files, "_old")
    rows = files.join(log.select(F.col("path"), F.col("hash").alias(old)), "path", "left")
    return rows.filter(F.col(old).isNull() | (F.col(old) != F.col("hash"))).withColumn("status", F.when(F.col(old).isNull(), "new").otherwise("changed")).drop(old)


def replace_sources(existing: DataFrame, incoming: DataFrame, source: str, keys: list[str], order: list[str]) -> DataFrame:
    """Re-ingest: all rows of the incoming sources go, then the incoming rows are merged."""
    return merge(without_sources(existing, incoming, source), incoming, keys, order)


#: Bytes of a bucket, and of a file in it, about; folders of a table before a merge writes it whole.
BUCKET, FILE, MOST_FOLDERS = 256 << 20, 64 << 20, 32


class Database:
    """Tables in one folder with one history: the newest snapshot file names the data of every table.

    Data is written first, into folders of its own; then a small file appears under the version's name
    by one rename, which never replaces another. So tables change together or not at all, and a job that
    dies between any two steps leaves the version before in place; what it wrote is never read, and
    ``unreferenced`` tells it. This holds where a rename is atomic and fails on an existing name (HDFS,
    local disks); an object store without that needs a single writer, whose later version then wins.
    Of two writers of one version the second fails.

    Tables are cut into buckets by a hash of their keys, as many as their bytes ask for; a table that
    outgrows them is cut anew. Merges and deletes write the buckets they touch alone.
    """

    def __init__(self, spark: SparkSession, path: str, bucket: int = BUCKET, file: int = FILE) -> None:
        self.spark, self.path, self.bucket, self.file = spark, path.rstrip("/"), bucket, file

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self) -> list:
        fs, root = self._fs(), self._path("x").getParent()
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(root)] if fs.exists(root) else []

    def bytes_of(self, folder: str) -> int:
        return self._fs().getContentSummary(self._path(folder)).getLength()

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("version-")) for n, _ in self._listed() if n.startswith("version-"))

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The newest version, or one of those kept, and what it says of each table."""
        known = self.versions() if version is None else [version]
        if not known:
            return 0, {}
        return known[-1], json.loads(self.spark.read.text(f"{self.path}/version-{known[-1]:012d}", wholetext=True).first()[0])

    def _publish(self, version: int, tables: dict) -> int:
        jvm, fs, draft = self.spark.sparkContext._jvm, self._fs(), self._path(f"_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        name = self._path(f"version-{version:012d}")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE  # fails if the name is there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, name, kinds)
        except Exception as e:
            raise RuntimeError(f"version {version} of {self.path} has been written by another job") from e
        return version

    def rows(self, table: dict, buckets: set[int] | None = None) -> DataFrame:
        """The rows that a state tells of a table, or of some of its buckets."""
        schema = T.StructType.fromJson(table["schema"])
        parts = []
        for folder, own in table["folders"].items():
            if own is None:
                parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/{folder}"))
            elif wanted := [b for b in own["live"] if buckets is None or b in buckets]:
                rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(table["by"], T.IntegerType())])).parquet(f"{self.path}/{folder}")
                parts.append((rows if len(wanted) == own["written"] else rows.filter(F.col(table["by"]).isin(wanted))).select(*schema.names))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return functools.reduce(DataFrame.unionAll, parts)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        tables = self.state(version)[1]
        return self.rows(tables[name]) if name in tables else None

    def begin(self) -> Transaction:
        return Transaction(self)

    def unreferenced(self, keep: int = 1) -> list[tuple[str, int]]:
        """Folders and drafts that none of the ``keep`` newest versions names, with the time they were written (ms)."""
        kept = self.versions()[-keep:]
        named = {f for v in kept for t in self.state(v)[1].values() for f in t["folders"]}
        return sorted((n, at) for n, at in self._listed() if n.startswith(("data-", "_draft-")) and n not in named)

    def vacuum(self, keep: int = 1, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Deletes versions but the ``keep`` newest, and what they do not name if it is old enough to belong to no running job."""
        fs, now = self._fs(), int(time.time() * 1000)
        gone = [n for n, at in self.unreferenced(keep) if now - at >= older_than_ms]
        for name in [*(f"version-{v:012d}" for v in self.versions()[:-keep]), *gone]:
            fs.delete(self._path(name), True)
        return gone


class Transaction:
    """Changes of several tables of a database, written as they come and published by ``commit`` at once.

    Reads see the changes made so far. Without ``commit`` nothing has changed.
    """

    def __init__(self, db: Database) -> None:
        self.db = db
        self.version, tables = db.state()
        self.tables = {name: dict(t) for name, t in tables.items()}
        self.changed = False

    def read(self, name: str) -> DataFrame | None:
        return self.db.rows(self.tables[name]) if name in self.tables else None

    def commit(self) -> int:
        return self.db._publish(self.version + 1, self.tables) if self.changed else self.version

    def _folder(self, name: str) -> str:
        return f"data-{name}-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"

    def overwrite(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """The table's rows from now on, without buckets; a later merge makes them."""
        folder, writer = self._folder(name), rows.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.db.path}/{folder}")
        self.tables[name] = {"schema": rows.schema.jsonValue(), "folders": {folder: None}, "bytes": self.db.bytes_of(folder)}
        self.changed = True

    def merge(self, name: str, rows: DataFrame, keys: list[str], order: list[str], least: int = 1) -> None:
        """Last write wins; incoming rows win ties. ``least``: buckets of a new table."""
        batch, db = self._folder("batch"), self.db
        rows.write.parquet(f"{db.path}/{batch}")  # once: it is read for its buckets and for its rows
        rows = db.spark.read.schema(rows.schema).parquet(f"{db.path}/{batch}")
        size, now = db.bytes_of(batch), self.tables.get(name)
        total = size + (now["bytes"] if now else 0)
        wanted = max(least, 1 << max(0, math.ceil(math.log2(max(1, total / db.bucket)))))
        if now is None or not now.get("n") or wanted > 2 * now["n"] or now["keys"] != keys or len(now["folders"]) >= MOST_FOLDERS:
            old = None if now is None else db.rows(now)
            self._put(name, upsert(rows, keys, order) if old is None else merge(old, rows.select(old.columns), keys, order), keys, max(wanted, now.get("n", 1) if now else 1), total)
        elif touched := {r[0] for r in rows.select(_bucket(keys, now["n"])).distinct().collect()}:  # numbers of buckets
            old = db.rows(now, touched)
            self._put(name, merge(old, rows.select(old.columns), keys, order), keys, now["n"], size + now["bytes"] * len(touched) // now["n"], touched)
        db._fs().delete(db._path(batch), True)

    def delete(self, name: str, gone: DataFrame, on: list[str]) -> None:
        """Without the rows that share ``on`` with a row of ``gone``; nulls match nothing."""
        if name not in self.tables:
            return
        now, db, gone = self.tables[name], self.db, gone.select(*on).distinct()
        hit = db.rows(now).join(gone, on, "left_semi")
        if not now.get("n"):
            if not hit.isEmpty():
                self.overwrite(name, db.rows(now).join(gone, on, "left_anti").select(*T.StructType.fromJson(now["schema"]).names))
        elif touched := {r[0] for r in hit.select(_bucket(now["keys"], now["n"])).distinct().collect()}:  # numbers of buckets
            old = db.rows(now, touched)
            self._put(name, old.join(gone, on, "left_anti").select(*old.columns), now["keys"], now["n"], now["bytes"] * len(touched) // now["n"], touched)

    def _put(self, name: str, rows: DataFrame, keys: list[str], n: int, size: int, touched: set[int] | None = None) -> None:
        """Write buckets, all or those touched; a bucket of many bytes by several tasks."""
        db, folder = self.db, self._folder(name)
        (by,) = free_names(rows, "_bucket")
        count = n if touched is None else len(touched)
        salts = max(1, math.ceil(size / count / db.file))
        dealt = rows.withColumn(by, _bucket(keys, n))
        dealt = dealt.repartition(max(1, min(count * salts, math.ceil(size / db.file))), F.col(by), F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(salts)))
        dealt.write.partitionBy(by).parquet(f"{db.path}/{folder}")
        fs, prefix = db._fs(), f"{by}="
        written = sorted(int(f.getPath().getName().removeprefix(prefix)) for f in fs.listStatus(db._path(folder)) if f.getPath().getName().startswith(prefix))
        kept, before = {}, self.tables.get(name)
        if touched is not None:
            for old, own in before["folders"].items():
                if live := [b for b in own["live"] if b not in touched]:
                    kept[old] = {"written": own["written"], "live": live}
        gone = 0 if touched is None else before["bytes"] * len(touched) // before["n"]
        had = before["bytes"] - gone if touched is not None else 0
        if written:
            kept[folder] = {"written": len(written), "live": written}
        self.tables[name] = {"schema": rows.schema.jsonValue(), "by": by, "keys": keys, "n": n, "folders": kept, "bytes": had + db.bytes_of(folder)}
        self.changed = True


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class VersionedTable(Database):
    """A database of one table."""

    def read(self) -> DataFrame | None:
        return super().read("rows")

    def _manifest(self) -> tuple[int, dict]:
        """The newest version and the folder of each bucket."""
        version, tables = self.state()
        return version, {"buckets": {str(b): folder for folder, own in tables.get("rows", {}).get("folders", {}).items() for b in (own or {"live": []})["live"]}}

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        t = self.begin()
        t.overwrite("rows", rows, partition_by)
        return t.commit()

    def merge(self, rows: DataFrame, keys: list[str], order: list[str], buckets: int = 1) -> int:
        """Last write wins, in the buckets of the rows' keys alone; ``buckets``: of a new table, at least."""
        t = self.begin()
        t.merge("rows", rows, keys, order, buckets)
        return t.commit()


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame, column: str = "source_file") -> dict[str, DataFrame]:
    """All tables without the rows of the sources in ``gone``, to be written as one version of each."""
    gone = gone.select(column).distinct()
    return {name: rows.join(gone, column, "left_anti").select(*rows.columns) for name, rows in tables.items()}


def mark_ingested(log: DataFrame | None, files: DataFrame, at) -> DataFrame:
    """The log (path, hash, ingested_at) with these files, ingested at the UTC time ``at`` (a Column, one for all)."""
    fresh = files.select("path", "hash", at.alias("ingested_at"))
    return fresh if log is None else merge(log, fresh, ["path"], ["ingested_at"])


def numbered_names(names: DataFrame, prefix: str) -> DataFrame:
    """The next name of a numbered series: one above the largest number in use."""
    number = F.regexp_extract("name", f"^{prefix}_(\\d+)", 1)
    return names.agg((F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0)) + 1).alias("next"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rank-1 rows of each key by a window; for when ties must all stay."""
    (rank,) = free_names(rows, "_rank")
    return rows.withColumn(rank, F.rank().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter(F.col(rank) == 1).drop(rank)
