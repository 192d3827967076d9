"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that can be decompressed alone; a skippable frame at the end holds
the seek table (compressed and plain size of every frame, then a footer), and a manifest maps each
record to its bundle, frame and place in the plain frame.

Defined results: a null html is an empty payload, a null url an empty target; rows are written in
the order of page_id in each task; repeated page_ids are repeated records. Of records with equal
payloads of ``least`` bytes or more, those of the largest page_id are responses and all others
revisit it. A row without page_id is written and revisits a page that has one and the same payload;
where none has one, rows without page_id are responses. An empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import spread
from tidemark.llm.store import open_files, saved, scratch, write_file

FRAME = 1 << 20
MOST_BROADCAST = 500_000  # shared digests (about 60 bytes each) that are sent to all tasks
# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, least: int = 1000, most: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to of every page.

    Payloads shared by pages are found by (digest, id) pairs alone. Up to ``most`` such digests are
    broadcast to where the payloads are. More are first joined with the pairs, and each page then
    meets its own answer, so no digest gathers the payloads of its copies.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    keys = rows.filter(F.col("n") >= least).select("page_id", "payload_digest", "n")
    shared = keys.groupBy("payload_digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1 and last is not null")
    shared = saved(shared.select("payload_digest", "n", "last"), "warc-shared")
    if shared.count() <= most:
        rows = rows.join(F.broadcast(shared), ["payload_digest", "n"], "left")
    else:
        told = spread(keys.distinct(), shared, ["payload_digest", "n"], "page_id").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "last")
        rows = rows.join(told, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    later = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "payload_digest", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("last")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and content of the record at ``at``, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = stop + 4
    upto = body + int(head["Content-Length"])
    return head, data[body:upto], upto + 4


def page_of(record_id: str) -> int | None:
    number = record_id[len("<urn:page:") : -1]
    return int(number) if number else None


def write_bundle(uri: str, records) -> tuple[str, list[tuple[int, int, int]]]:
    """Write ``(page_id, bytes)``; the URI and, for each record, page_id, frame, place in the frame."""
    import zstandard

    press, places, table = zstandard.ZstdCompressor(level=3, write_content_size=True), [], []

    def parts():
        held, size = [], 0
        for page_id, data in records:
            places.append((page_id, len(table), size))
            held.append(data)
            size += len(data)
            if size >= FRAME:
                yield frame(held, size)
                held, size = [], 0
        if held:
            yield frame(held, size)
        entries = b"".join(struct.pack("<II", c, p) for c, p in table)
        body = entries + struct.pack("<IBI", len(table), 0, SEEKABLE_MAGIC)
        yield struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body

    def frame(held, size):
        out = press.compress(b"".join(held))
        table.append((len(out), size))
        return out

    return write_file(uri, parts()), places


def seek_table(f) -> list[tuple[int, int]]:
    """Place and compressed size of every frame of an open bundle."""
    f.seek(f.size() - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    f.seek(f.size() - 9 - 8 * n)
    raw, at, out = f.read(8 * n), 0, []
    for i in range(n):
        packed, _ = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed))
        at += packed
    return out


def read_frames(uri: str, wanted=None):
    """Number and plain bytes of the frames of a bundle, or of those ``wanted``."""
    import zstandard

    system, path = open_files(uri)
    with system.open_input_file(path) as f:
        table = seek_table(f)
        for i in range(len(table)) if wanted is None else sorted(wanted):
            f.seek(table[i][0])
            yield i, zstandard.ZstdDecompressor().decompress(f.read(table[i][1]))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write all pages; the manifest: a row a record with bundle, frame and place."""
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches):
        from pyspark import TaskContext

        def records():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield row[0], record(*row)

        rows = records()
        first = next(rows, None)
        if first is None:
            return

        def all_rows():
            yield first
            yield from rows

        path, places = write_bundle(f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst", all_rows())
        ids, frames, offsets = zip(*places)
        yield pa.RecordBatch.from_pydict({"bundle": [path] * len(ids), "page_id": list(ids), "frame": pa.array(frames, pa.int32()), "offset": pa.array(offsets, pa.int64())})

    return saved(classify(pages, least).mapInArrow(write, "bundle string, page_id long, frame int, offset long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record through its frame: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digests of responses are computed from what was read and compared with the record's header.
    """
    frames = manifest.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # bounded by a frame's size

    def read(batches):
        for batch in batches:
            todo: dict[str, dict[int, list[int]]] = {}
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                todo.setdefault(bundle, {})[frame] = offsets
            for bundle, wanted in todo.items():
                out = []
                for i, data in read_frames(bundle, wanted):
                    for at in wanted[i]:
                        head, body, _ = parse(data, at)
                        digest, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), page_of(head["WARC-Record-ID"])
                        if head["WARC-Type"] == "response":
                            if hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"page {page} is damaged")
                            out.append((page, len(body), digest, "response", None))
                        else:
                            out.append((page, None, digest, "revisit", int(head["WARC-Refers-To"][len("<urn:page:") : -1])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = frames.repartition("bundle", F.floor(F.col("frame") / 16)).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = saved(rows, "warc-read")
    sizes = rows.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    revisits = spread(rows.filter("record_type = 'revisit'"), sizes, ["refers_to", "payload_digest"], "page_id", "left").withColumn("payload_bytes", F.col("size"))
    return rows.filter("record_type = 'response'").unionByName(revisits.select(rows.columns))
