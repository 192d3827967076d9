"""Token ids as Simple-8b word-aligned shards.

File: ``S8B1``, then blocks of at most ``BLOCK`` ids as little-endian 64-bit words, then a footer
(one row a document: id, number of ids; one row a block: first word) and a fixed trailer. The low
4 bits of a word select how many ids of how many bits its other 60 hold; selector 0 escapes to the
next word, which holds one id of up to 64 bits. A block can be decoded on its own, and all words
of any run of blocks at once.

Defined results: a null text is empty and has the end id only; rows with equal doc_id follow each
other in order of text; a null doc_id comes first; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.pieces import encoder, with_end
from tidemark.llm.store import open_files, saved, scratch, write_file
from tidemark.llm.words import keep, portions

MAGIC, BLOCK, ESCAPE = b"S8B1", 1024, 0
# How many ids of how many bits a word holds, for selectors 1, 2, ...
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_TRAILER = struct.Struct("<qqqqI")  # documents, blocks, ids, words; CRC-32 of the footer
U64 = np.uint64


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks, and the first word of each block (blocks + 1)."""
    ids = ids.astype(U64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    ends = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)  # of the id's own block
    room = ends - np.arange(n)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # rounding up to the next power is harmless
    choice = np.zeros(n, np.uint8)
    widest: dict[int, np.ndarray] = {1: bits}
    for s in range(len(LAYOUTS), 0, -1):  # from one id a word to sixty: the last that fits wins
        count, width = LAYOUTS[s - 1]
        if count not in widest:  # the most bits of ``count`` ids from here on; ids past the end need none
            have = max(k for k in widest if k <= count)
            low, shift = widest[have], count - have
            while shift > have:
                padded = np.zeros(n, np.uint8)
                padded[: max(n - have, 0)] = low[have:]
                low, have = np.maximum(low, padded), 2 * have
                shift = count - have
            padded = np.zeros(n, np.uint8)
            padded[: max(n - shift, 0)] = low[shift:]
            widest[count] = np.maximum(low, padded)
        np.copyto(choice, s, where=widest[count] <= width, casting="unsafe")
    sizes = np.array([1, *[c for c, _ in LAYOUTS]])
    step = np.minimum(sizes[choice], room)
    begin = np.zeros(n, bool)
    here = np.arange(blocks) * BLOCK
    stop = np.minimum(here + BLOCK, n)
    while len(here):  # all blocks go forward word by word together
        begin[here] = True
        here = here + step[here]
        more = here < stop
        here, stop = here[more], stop[more]
    at = np.flatnonzero(begin)
    picked = choice[at]
    width = np.array([0, *[b for _, b in LAYOUTS]], U64)[picked]
    words = picked.astype(U64)
    took = step[at]
    for k in range(60):
        live = np.flatnonzero(took > k)
        live = live[picked[live] != ESCAPE]
        if not len(live):
            break
        words[live] |= ids[at[live] + k] << (U64(4) + U64(k) * width[live])
    escaped = np.flatnonzero(picked == ESCAPE)
    first = np.searchsorted(at, np.arange(blocks + 1) * BLOCK)
    first = first + np.searchsorted(escaped, first)
    return np.insert(words, escaped + 1, ids[at[escaped]]), first


def decode_blocks(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All ids of the blocks whose words begin at ``first``; ``sizes``: ids of each block."""
    if not len(words):
        return np.zeros(0, U64)
    selector = (words & U64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that an escape points to hold any bits
    at = np.flatnonzero((selector == ESCAPE) | (selector == 15))
    for i in at.tolist():
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.array([0, *[c for c, _ in LAYOUTS], 0])[selector]
    counts[raw] = 1
    width = np.array([0, *[b for _, b in LAYOUTS], 0])[selector]
    upto = np.concatenate([[0], np.cumsum(counts)])
    block = np.repeat(np.arange(len(sizes)), np.diff(np.append(first, len(words))))
    inside = upto[:-1] - upto[first][block]  # the place of a word's first id in its block
    took = np.minimum(counts, sizes[block] - inside)
    start = np.concatenate([[0], np.cumsum(took)])
    out = np.empty(start[-1], U64)
    for s, (_, b) in enumerate(LAYOUTS, 1):
        mine = np.flatnonzero((selector == s) & ~raw)
        mask = U64((1 << b) - 1)
        for k in range(LAYOUTS[s - 1][0]):
            mine = mine[took[mine] > k]
            if not len(mine):
                break
            out[start[mine] + k] = (words[mine] >> U64(4 + k * b)) & mask
    out[start[:-1][raw]] = words[raw]
    return out


def write_shard(uri: str, batches) -> tuple[str, int, int]:
    """Write ``(doc_ids, ids, offsets)`` batches as one shard; its URI, ids and documents."""
    docs, sizes, first, total = [], [], [np.zeros(1, np.int64)], [0, 0]

    def parts():
        rest = np.zeros(0, np.int64)
        yield MAGIC + b"\0" * 4
        for doc_ids, ids, at in batches:
            docs.extend(doc_ids)
            sizes.append(np.diff(at))
            total[0] += len(ids)
            rest = np.concatenate([rest, ids])
            whole = len(rest) // BLOCK * BLOCK
            yield from put(rest[:whole])
            rest = rest[whole:]
        yield from put(rest)
        footer = np.array([-1 if d is None else d for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
        footer += np.concatenate([*sizes, np.zeros(0, np.int64)]).astype("<i8").tobytes() + np.concatenate(first).astype("<i8").tobytes()
        yield footer + _TRAILER.pack(len(docs), sum(map(len, first)) - 1, total[0], total[1], zlib.crc32(footer))

    def put(ids):
        if len(ids):
            words, at = encode_blocks(ids)
            first.append(at[1:] + total[1])
            total[1] += len(words)
            yield words.astype("<u8").tobytes()

    return write_file(uri, parts()), total[0], len(docs)


def read_shard(uri: str, slab: int = 1024):
    """``(doc_ids, sizes, ids)`` of a shard, some blocks and whole documents at a time.

    A document longer than a slab comes in parts: the last document of a yield goes on in the
    next one where its size is not reached yet.
    """
    system, path = open_files(uri)
    with system.open_input_file(path) as f:
        f.seek(f.size() - _TRAILER.size)
        n_docs, n_blocks, n_ids, n_words, crc = _TRAILER.unpack(f.read(_TRAILER.size))
        size = 17 * n_docs + 8 * (n_blocks + 1)
        f.seek(f.size() - _TRAILER.size - size)
        footer = f.read(size)
        if zlib.crc32(footer) != crc:
            raise ValueError(f"the footer of {uri} is damaged")
        doc_ids = np.frombuffer(footer, "<i8", n_docs)
        null = np.frombuffer(footer, np.uint8, n_docs, 8 * n_docs)
        sizes = np.frombuffer(footer, "<i8", n_docs, 9 * n_docs)
        first = np.frombuffer(footer, "<i8", n_blocks + 1, 17 * n_docs)
        yield doc_ids, null.astype(bool), sizes
        for b in range(0, n_blocks, slab):
            e = min(b + slab, n_blocks)
            f.seek(8 + 8 * first[b])
            words = np.frombuffer(f.read(8 * (first[e] - first[b])), "<u8")
            yield decode_blocks(words, first[b:e] - first[b], np.minimum(BLOCK, n_ids - np.arange(b, e) * BLOCK))


def in_ranges(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in ascending doc_id order, a range of ids in each partition, about 16 MB of text."""
    spark = docs.sparkSession
    rows = docs.select(*columns)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, -(-size // (1 << 23)))) if size < most << 24 else -(-size // (1 << 24))
    return rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text")


def token_batches(batches, tokenizer: str, end: int | None):
    """``(doc_ids, ids, offsets)`` for Arrow batches of (doc_id, text)."""
    encode = encoder(tokenizer)
    keep("segments", encode.clear)
    for batch in batches:
        for part in portions(batch, 1, 1 << 21):
            ids, at = encode.encode(part.column(1))
            if end is not None:
                ids, at = with_end(ids, at, end)
            yield part.column(0).to_pylist(), ids, at


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int | None = 0) -> DataFrame:
    """Encode every text and write shards in doc_id order; the manifest, a row a shard.

    ``docs`` needs doc_id and text; other columns are left alone.
    """
    folder = folder or scratch(docs.sparkSession, "ids")

    def write(batches):
        from pyspark import TaskContext

        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        shard = TaskContext.get().partitionId()

        def all_batches():
            yield head
            yield from batches

        path, n_ids, n_docs = write_shard(f"{folder}/shard-{shard:06d}.s8b", token_batches(all_batches(), tokenizer, end))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_ids": [n_ids], "n_docs": [n_docs]})

    rows = in_ranges(docs, ["doc_id", "text"])
    return saved(rows.mapInArrow(write, "shard long, path string, n_ids long, n_docs long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """A row a document from the shards: doc_id, shard, n-th place, start, n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))  # a row a shard
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slabs = read_shard(path)
                doc_ids, null, sizes = next(slabs)
                upto = np.cumsum(sizes)
                crcs, doc, left, crc = [], 0, int(sizes[0]) if len(sizes) else 0, 0
                for ids in slabs:
                    raw, at = ids.astype("<u4").tobytes(), 0
                    while doc < len(sizes) and (at < len(raw) or not left):
                        took = min(left, (len(raw) - at) // 4)
                        crc = zlib.crc32(raw[at : at + 4 * took], crc)
                        at, left = at + 4 * took, left - took
                        if left:
                            break
                        crcs.append(crc)
                        doc, crc = doc + 1, 0
                        left = int(sizes[doc]) if doc < len(sizes) else 0
                crcs += [0] * (len(sizes) - len(crcs))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null), pa.array(base + upto - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, min(4096, manifest.count()))).mapInArrow(read, schema)
