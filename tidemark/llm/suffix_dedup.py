"""Exact substring deduplication with a sparse suffix array.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.

Suffixes are sampled so that equal 50-byte strings have sampled suffixes at the same places: those
whose first 8 bytes have the least hash of the 31 places in some 50-byte string that leave room for
20 bytes (all of them on a tie). First, hashes alone are exchanged to find the sampled suffixes whose first 20 bytes occur
in two documents. Only those go on, with the bytes around them, each distinct one once for a chunk
of documents. They are range-partitioned by their leading bytes at sampled splitters; a splitter
never parts suffixes with the same 20 leading bytes, so no comparison crosses a boundary unseen.
Each range is sorted by multikey quicksort (eight bytes a key), and within suffixes that agree in
20 bytes the strings that contain them are compared, by hash and then byte for byte, to find the
smallest doc_id of each. The answers return to the chunks, which find the same suffixes again.
Leading bytes so frequent in the sample that they would fill a range by themselves are salted: the
50-byte strings around them, each once a chunk, are dealt by their own hashes instead.

Text is moved once, into a table bucketed by chunk, so that answers are joined without a shuffle of
text. A hot string costs one row a chunk, not one a document.

Defined results: a null or empty text has no bytes and no spans; texts below 50 bytes stay whole;
rows with equal doc_id never remove each other's bytes; a row without doc_id comes after all
others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.store import saved, scratch
from tidemark.llm.words import U64, give_back, mix, utf8

LENGTH, GRAM = 50, 20
BEFORE = LENGTH - GRAM  # bytes before a sampled suffix that a string can reach
OFFSETS = BEFORE + 1  # places of the suffix in a string
SPAN = BEFORE + LENGTH
CHUNK_ROWS_BITS, CHUNK_TEXT = 11, 8192  # 2048 texts of up to twice so many bytes a chunk; half as many of those twice as long, and so on
SAMPLED = 1 << 16  # suffixes that the splitters are taken from, at most
HOT_LEAST = 8  # samples of the same leading bytes that make them hot, at least; and half a range's share
_PORTION = 1 << 17  # bytes looked at together, few enough for a processor's cache
_LAST = np.iinfo(np.int64).max
_NO_DOC = _LAST - 1


def _order_hash(raw: np.ndarray) -> np.ndarray:
    """A 31-bit hash of the 8 bytes from each place on, never 0."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw),), "<u8", padded.data, 0, (1,))
    return ((view * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def _combine(words: list[np.ndarray]) -> np.ndarray:
    h = words[0] * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h += words[1]
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(31)
    h += words[2]
    h *= U64(0x94D049BB133111EB)
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` of each run of ``width`` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        extra = width - have
        out = pick(out[: len(out) - extra], out[extra:])
    return out


def sampled(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sampled suffixes of texts laid end to end, and hashes of their 20 bytes."""
    found, n = [], len(offsets) - 1
    low = 0
    while low < n:  # some texts at a time; a long text by itself in overlapping parts
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _PORTION, "right")) - 1)
        begin, end = int(offsets[low]), int(offsets[high])
        for a in range(begin, max(end, begin + 1), 4 * _PORTION):
            found.append(_sampled_part(raw, offsets[low : high + 1], max(begin, a - 2 * LENGTH), min(end, a + 4 * _PORTION)))
        low = high
    places = np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
    places = places[np.diff(places, prepend=-1) > 0]
    return places, mix(_combine(_words_20(raw, places)))


def _words_20(raw: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    if not len(places):
        return [np.zeros(0, U64)] * 3
    view = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # a sampled suffix has 20 bytes at least
    return [view[places], view[places + 8], view[places + 12]]


def _sampled_part(raw: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> np.ndarray:
    if end - begin < LENGTH:
        return np.zeros(0, np.int64)
    part = raw[begin:end]
    h = _order_hash(part)[: len(part) - GRAM + 1]
    least = _sliding(h, OFFSETS, np.minimum)  # of the string from each place on
    cuts = offsets[(offsets > begin) & (offsets < end)] - begin
    for k in range(1, LENGTH):  # strings that would cross into the next text
        at = cuts - k
        least[at[(at >= 0) & (at < len(least))]] = 0
    padded = np.concatenate([np.zeros(BEFORE, np.uint32), least, np.zeros(BEFORE, np.uint32)])
    reach = _sliding(padded, OFFSETS, np.maximum)  # the largest minimum of all strings around a place
    return np.flatnonzero(reach[: len(h)] == h) + begin


def _spread(doc_ids: pa.Array) -> np.ndarray:
    return np.array([_NO_DOC if d is None else d for d in doc_ids.to_pylist()], np.int64)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of all equal rows, and for each row which of those it equals: by hash, then byte for byte."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    h = np.zeros(n, U64)
    for column in padded.view("<u8").T:
        h = (h ^ column) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (padded.view("<u8") != padded.view("<u8")[first[inverse]]).any():  # equal hashes of unequal rows
        _, first, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{width}").ravel(), return_index=True, return_inverse=True)
    return first, inverse


class Contexts:
    """The distinct surroundings of a chunk's shared suffixes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, docs: np.ndarray, shared: np.ndarray) -> None:
        places, hashes = sampled(raw, offsets)
        if len(shared):
            at = np.searchsorted(shared, hashes)
            places = places[shared[np.minimum(at, len(shared) - 1)] == hashes]
        else:
            places = places[:0]
        text = np.searchsorted(offsets, places, "right") - 1
        left = np.minimum(places - offsets[text], BEFORE)
        right = np.minimum(offsets[text + 1] - places, LENGTH)
        spread = np.arange(-BEFORE, LENGTH)
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
        bytes_ = np.empty((len(places), SPAN + 2), np.uint8)
        for low in range(0, len(places), 1 << 16):
            s = slice(low, low + (1 << 16))
            got = padded[places[s, None] + BEFORE + spread]
            got[(spread < -left[s, None]) | (spread >= right[s, None])] = 0
            bytes_[s, :SPAN] = got
        bytes_[:, SPAN], bytes_[:, SPAN + 1] = left, right
        first, inverse = distinct_rows(bytes_)
        self.places, self.text, self.inverse, self.rows = places, text, inverse, bytes_[first]
        self.docs = docs[text]
        self.low, self.high = np.full(len(first), _LAST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(self.low, inverse, self.docs)
        np.maximum.at(self.high, inverse, self.docs)

    def hot(self, grams: np.ndarray) -> np.ndarray:
        """Which contexts have leading bytes among ``grams``."""
        return np.isin(_keys(self.rows), grams) if len(grams) else np.zeros(len(self.rows), bool)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct 50-byte strings around some contexts with their smallest and largest doc_id;
        and for each context and offset the number of its string."""
        rows = np.flatnonzero(which)
        left, right = self.rows[rows, SPAN].astype(np.int64), self.rows[rows, SPAN + 1].astype(np.int64)
        context, offset, text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, LENGTH), np.uint8)]
        for o in range(OFFSETS):
            valid = rows[(left >= o) & (right >= LENGTH - o)]
            context.append(valid)
            offset.append(np.full(len(valid), o))
            text.append(self.rows[valid, BEFORE - o : BEFORE - o + LENGTH])
        context, offset, text = np.concatenate(context), np.concatenate(offset), np.concatenate(text)
        first, inverse = distinct_rows(text)
        low, high = np.full(len(first), _LAST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.low[context])
        np.maximum.at(high, inverse, self.high[context])
        return text[first], low, high, context, offset, inverse

    def spans(self, index: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes to remove, as (text, start, stop) in the chunk: answers for contexts by index."""
        order = np.argsort(self.inverse, kind="stable")
        upto = np.searchsorted(self.inverse[order], np.arange(len(self.rows) + 1))
        times = upto[index + 1] - upto[index]
        answer = np.repeat(np.arange(len(index)), times)
        use = order[np.repeat(upto[index] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        ok = self.docs[use] > least[answer]
        use, answer = use[ok], answer[ok]
        return self.text[use], self.places[use] - end[answer], self.places[use] - begin[answer] + LENGTH


def _keys(rows: np.ndarray) -> np.ndarray:
    """The leading bytes of contexts as comparable keys; the last byte keeps zeros before it."""
    keys = np.ones((len(rows), GRAM + 1), np.uint8)
    keys[:, :GRAM] = rows[:, BEFORE : BEFORE + GRAM]
    return keys.view(f"S{GRAM + 1}").ravel()


def compare_strings(text: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest doc_id of all equal rows, for each row."""
    first, inverse = distinct_rows(text)
    least = np.full(len(first), _LAST)
    np.minimum.at(least, inverse, low)
    return least[inverse]


def multikey_order(suffixes: np.ndarray) -> np.ndarray:
    """The order of equally long byte rows, eight bytes a key: ties alone see the next key."""
    n, width = suffixes.shape
    keys = -(-width // 8)
    padded = np.zeros((n, keys * 8), np.uint8)
    padded[:, :width] = suffixes
    columns = padded.view(">u8").astype(U64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)  # places in ``order`` that still tie with a neighbour
    for k in range(keys):
        if not len(live):
            break
        rows = order[live]
        local = np.lexsort((columns[rows, k], group[live]))
        order[live] = rows[local]
        key = columns[order[live], k]
        opens = np.ones(len(live), bool)
        opens[1:] = (group[live][1:] != group[live][:-1]) | (key[1:] != key[:-1])
        group[live] = live[np.maximum.accumulate(np.where(opens, np.arange(len(live)), 0))]
        same = np.zeros(len(live), bool)
        same[1:] = ~opens[1:]
        same[:-1] |= ~opens[1:]
        live = live[same]
    return order


def compare_range(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Answers for contexts of one range: (row, first offset, last offset, smallest doc_id)."""
    order = multikey_order(rows[:, BEFORE : BEFORE + LENGTH])
    grams = rows[order, BEFORE : BEFORE + GRAM]
    opens = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]).any(1)]) if len(rows) else np.zeros(0, np.int64)
    out, at = [], 0
    while at < len(opens):  # whole groups of equal leading bytes, about 16,000 suffixes at once
        upto = max(at + 1, int(np.searchsorted(opens, opens[at] + (1 << 14), "right")))
        s = order[opens[at] : opens[upto] if upto < len(opens) else len(rows)]
        out.append(_compare_groups(rows[s], low[s], high[s], s))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _compare_groups(rows: np.ndarray, low: np.ndarray, high: np.ndarray, numbers: np.ndarray):
    n = len(rows)
    left, right = rows[:, SPAN].astype(np.int64), rows[:, SPAN + 1].astype(np.int64)
    weights = np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15, U64))
    sums = np.zeros((n, SPAN + 1), U64)
    np.cumsum((rows[:, :SPAN].astype(U64) + U64(1)) * weights, axis=1, out=sums[:, 1:])
    least = np.full((n, OFFSETS), _LAST)
    for o in range(OFFSETS):  # the strings that begin ``o`` bytes before the suffix
        valid = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(valid) < 1:
            continue
        a = BEFORE - o
        key = mix(sums[valid, a + LENGTH] - sums[valid, a])
        order = np.argsort(key)
        key, who = key[order], valid[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        text = rows[who, a : a + LENGTH]
        if (text != text[heads]).any():  # equal hashes of unequal strings: sort the strings
            order = np.lexsort(rows[valid, a : a + LENGTH].T[::-1])
            who = valid[order]
            text = rows[who, a : a + LENGTH]
            new[1:] = (text[1:] != text[:-1]).any(1)
            heads = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        firsts = np.flatnonzero(new)
        least[who, o] = np.minimum.reduceat(low[who], firsts)[np.searchsorted(firsts, heads)]
    useful = least < high[:, None]
    change = np.ones((n, OFFSETS + 1), bool)
    change[:, 1:-1] = least[:, 1:] != least[:, :-1]
    row, begin = np.nonzero(change[:, :-1] & useful)
    ends = np.nonzero(change[:, 1:] & useful)
    return numbers[row], begin, ends[1], least[row, begin]


def _pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _dealt(part: np.ndarray, items: np.ndarray):
    """``items`` by part: each part that has any, and its items."""
    order = np.argsort(part, kind="stable")
    live, cuts = np.unique(part[order], return_index=True)
    cuts = np.append(cuts, len(order))
    for k, p in enumerate(live.tolist()):
        yield p, items[order[cuts[k] : cuts[k + 1]]]


def _by_chunk(batches, at: dict[str, int]):
    """Rows of each chunk, as often as a batch has it."""
    for batch in batches:
        chunks = batch.column(at["chunk"]).to_numpy()
        cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(chunks[a]), batch.slice(a, b - a)


def _chunked(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """All columns and ``_chunk``, as a table whose files are bucketed by it; number of buckets.

    Each task writes the chunks it reads, so no text is shuffled. Texts of a chunk are about as long
    as each other, the fewer the longer they are, so that none holds more than some 32 MB or one text.
    """
    spark = docs.sparkSession
    # 0 up to twice CHUNK_TEXT bytes, 1 up to four times, ...
    class_ = F.least(F.floor(F.log2(F.greatest(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / CHUNK_TEXT, F.lit(1)))), F.lit(CHUNK_ROWS_BITS)).cast("int")
    run = F.expr(f"shiftright(_row, {CHUNK_ROWS_BITS} - _class)")
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_class", class_).withColumn("_chunk", run * (CHUNK_ROWS_BITS + 1) + F.col("_class")).drop("_row", "_class")
    parts = docs.rdd.getNumPartitions()
    buckets = min(100_000, max(2 * parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"tidemark_chunks_{uuid.uuid4().hex[:12]}"
    rows.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "chunks")).bucketBy(buckets, "_chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and so does what was read of the catalogue
    return table, buckets


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any others), with what is left of each text.

    Adds dedup_kept (bytes; or text, less any character that lost a byte), dedup_n_bytes,
    dedup_n_removed and dedup_n_spans, after the columns of ``docs``.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    table, buckets = _chunked(plain.withColumn(names[doc_at], F.col(names[doc_at]).cast("long")), names[text_at])
    texts = table.select("_chunk", F.col(names[doc_at]).alias("doc_id"), F.col(names[text_at]).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)

    # 1. which hashes of leading bytes occur in two documents
    def hashes(batches):
        for chunk, rows in _by_chunk(batches, {"chunk": 0}):
            raw, offsets = utf8(rows.column(2))
            places, found = sampled(raw, offsets)
            docs_ = _spread(rows.column(1))[np.searchsorted(offsets, places, "right") - 1]
            order = np.argsort(found)
            found, docs_ = found[order], docs_[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            firsts = np.flatnonzero(new)
            several = np.minimum.reduceat(docs_, firsts) != np.maximum.reduceat(docs_, firsts) if len(firsts) else np.zeros(0, bool)
            found = found[firsts]
            edges = np.searchsorted(found, [U64((i << 64) // parts) for i in range(parts)]) if len(found) else np.zeros(parts, np.int64)
            edges = np.append(edges, len(found))
            live = np.flatnonzero(edges[1:] > edges[:-1])
            blobs = [_pack(found[edges[i] : edges[i + 1]], several[edges[i] : edges[i + 1]]) for i in live]
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([chunk] * len(live), pa.int64()), pa.array(blobs, pa.binary())], ["part", "chunk", "blob"])
        give_back()

    def shared(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append((chunk, blob))
        for rows in held.values():  # one range of hashes each, as even as the hash
            pieces = []
            for _, blob in rows:
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                pieces.append((np.frombuffer(blob, U64, n, 8), np.frombuffer(blob, bool, n, 8 + 8 * n)))
            values = np.concatenate([p[0] for p in pieces])
            order = np.argsort(values)
            ranked = values[order]
            same = np.zeros(len(values) + 1, bool)
            same[1:-1] = ranked[1:] == ranked[:-1]
            many = np.empty(len(values), bool)
            many[order] = same[:-1] | same[1:]
            many |= np.concatenate([p[1] for p in pieces])
            at = 0
            chunks, out = [], []
            for (chunk, _), (own, _) in zip(rows, pieces):
                got = own[many[at : at + len(own)]]
                at += len(own)
                if len(got):
                    chunks.append(chunk)
                    out.append(got.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], ["_chunk", "shared"])

    known = texts.mapInArrow(hashes, "part int, chunk long, blob binary").repartition(parts, "part").mapInArrow(shared, "_chunk long, shared binary")
    known = saved(known, "shared")

    # 2. splitters from a sample of suffixes
    rows_total = max(1, table.count())

    def leading(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            places, _ = sampled(raw, offsets)
            step = max(1, len(places) // 64)
            yield pa.RecordBatch.from_arrays([pa.array([raw[p : p + GRAM].tobytes() for p in places[::step].tolist()], pa.binary())], ["gram"])

    fraction = min(1.0, SAMPLED / 64 / rows_total)
    grams = texts.sample(fraction, seed=1).mapInArrow(leading, "gram binary")
    grams = sorted(bytes(r["gram"]) for r in grams.limit(2 * SAMPLED).collect())  # a bounded sample
    splitters = sorted({grams[i * len(grams) // parts] for i in range(1, parts)}) if grams else []
    ranges = np.array([g + b"\x01" for g in splitters], f"S{GRAM + 1}")
    often = [g for g, n in Counter(grams).items() if n >= max(HOT_LEAST, len(grams) / (2 * parts))]
    often = np.array([g + b"\x01" for g in often], f"S{GRAM + 1}")

    # 3. the surroundings of shared suffixes, dealt by range
    def chunk_contexts(rows: pa.Table, found: list):
        got = np.sort(np.concatenate([np.frombuffer(b, U64) for b in found])) if found else np.zeros(0, U64)
        give_back()
        column = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        raw, offsets = utf8(column)
        return Contexts(raw, offsets, _spread(rows.column("doc_id")), got), raw, offsets

    def surround(rows: pa.Table, replies: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not rows.num_rows or not replies.num_rows:
            return empty
        own, _, _ = chunk_contexts(rows, replies.column("shared").to_pylist())
        if not len(own.rows):
            return empty
        hot = own.hot(often)
        calm = np.flatnonzero(~hot)
        rows_out = [(part, 0, _pack(own.rows[s], s.astype(np.int32), own.low[s], own.high[s])) for part, s in _dealt(np.searchsorted(ranges, _keys(own.rows[calm]), "right"), calm)]
        text, low, high, *_ = own.strings(hot)
        weights = np.cumprod(np.full(LENGTH, 0x9E3779B97F4A7C15, U64))
        salt = (mix(((text.astype(U64) + U64(1)) * weights).sum(1, dtype=U64)) % U64(parts)).astype(np.int64)
        rows_out += [(part, 1, _pack(text[s], s.astype(np.int32), low[s], high[s])) for part, s in _dealt(salt, np.arange(len(text)))]
        if not rows_out:
            return empty
        part, kind, blobs = zip(*rows_out)
        chunk = rows.column("_chunk")[0].as_py()
        return pa.table({"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "chunk": pa.array([chunk] * len(part), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def answer(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, kind, chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((part, kind), []).append((chunk, blob))
        for (_, kind), rows in held.items():
            parts_, width = [], SPAN + 2 if kind == 0 else LENGTH
            for k, (_, blob) in enumerate(rows):
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                at = 8 + n * width
                parts_.append((np.frombuffer(blob, np.uint8, n * width, 8).reshape(n, width), np.frombuffer(blob, np.int32, n, at), np.frombuffer(blob, np.int64, n, at + 4 * n), np.frombuffer(blob, np.int64, n, at + 12 * n), np.full(n, k)))
            bytes_, index, low, high, source = (np.concatenate(x) for x in zip(*parts_))
            if kind == 0:
                row, begin, end, least = compare_range(bytes_, low, high)
            else:
                least = compare_strings(bytes_, low)
                row = np.flatnonzero(least < high)
                least, begin = least[row], np.zeros(len(row), np.int64)
                end = begin
            order = np.argsort(source[row], kind="stable")
            row, begin, end, least = row[order], begin[order], end[order], least[order]
            who, cuts = np.unique(source[row], return_index=True)
            cuts = np.append(cuts, len(row))
            blobs = [_pack(index[row[a:b]], begin[a:b].astype(np.uint8), end[a:b].astype(np.uint8), least[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in who], pa.int64()), pa.array([kind] * len(who), pa.int32()), pa.array(blobs, pa.binary())], ["_chunk", "kind", "answers"])
        give_back()

    around = texts.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(surround, "part int, kind int, chunk long, blob binary")
    answers = saved(around.repartition(parts, "part").mapInArrow(answer, "_chunk long, kind int, answers binary"), "answers")

    # 4. remove the bytes where the text is
    fields = [*plain.withColumn(names[doc_at], F.col(names[doc_at]).cast("long")).schema.fields, *T._parse_datatype_string(f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long").fields]
    replies = known.select("_chunk", "shared", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("answers")).unionByName(answers.withColumn("shared", F.lit(None).cast("binary")))
    doc_name, text_name = names[doc_at], names[text_at]

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        n = rows.num_rows
        own_rows = rows.select(["_chunk", doc_name, text_name]).rename_columns(["_chunk", "doc_id", "text"])
        own, raw, offsets = chunk_contexts(own_rows, [b for b in told.column("shared").to_pylist() if b is not None])
        delta = np.zeros(len(raw) + 1, np.int32)
        salted = None
        for kind, blob in zip(told.column("kind").to_pylist(), told.column("answers").to_pylist()):
            if blob is not None:
                k = int(np.frombuffer(blob, np.int64, 1)[0])
                index, begin = np.frombuffer(blob, np.int32, k, 8).astype(np.int64), np.frombuffer(blob, np.uint8, k, 8 + 4 * k).astype(np.int64)
                end, least = np.frombuffer(blob, np.uint8, k, 8 + 5 * k).astype(np.int64), np.frombuffer(blob, np.int64, k, 8 + 6 * k)
                if kind == 1:  # of strings by number: all contexts and offsets that have them
                    salted = salted or own.strings(own.hot(often))
                    _, _, _, context, offset, number = salted
                    told_least = np.full(len(salted[0]), _LAST)
                    told_least[index] = least
                    use = told_least[number] < _LAST
                    index, begin, end, least = context[use], offset[use], offset[use], told_least[number[use]]
                _, start, stop = own.spans(index, begin, end, least)
                np.add.at(delta, start, 1)
                np.add.at(delta, stop, -1)
        gone = np.cumsum(delta[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(raw)]
        opens[cuts] = gone[cuts]
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
        sizes, removed = np.diff(offsets), count(gone)
        left = raw[~gone]
        kept_at = np.concatenate([[0], np.cumsum(sizes - removed)])
        kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(left))]).cast(pa.binary())
        if as_text:
            kept = pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())
        return pa.table([*(rows.column(c) for c in names), kept, pa.array(sizes), pa.array(removed), pa.array(count(opens))], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    out = table.groupBy("_chunk").cogroup(replies.groupBy("_chunk")).applyInArrow(cut, T.StructType(fields))
    added = [c for c in ("kept", "n_bytes", "n_removed", "n_spans")]
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], *[F.col(c).alias(f"dedup_{c}") for c in added])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = remove_repeats(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.col("dedup_n_bytes").alias("n_bytes"), F.col("dedup_n_removed").alias("n_removed"), F.col("dedup_n_spans").alias("n_spans"), F.sha2("dedup_kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes gone from text; characters that lost bytes go whole.

    ``n_chars`` follows the text where ``docs`` has it. No row is dropped.
    """
    rows = remove_repeats(docs, as_text=True)
    rows = rows.withColumn("text", F.when(F.col("dedup_n_removed") == 0, F.col("text")).otherwise(F.col("dedup_kept")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("dedup_n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
