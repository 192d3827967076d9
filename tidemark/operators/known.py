"""Known values anywhere in texts, without comparing every text with every value.

For each distinct length of a value there is a window of as many bytes over the text, with a rolling
hash. Windows are looked at only where the first bytes of some value stand, and go on only if their
hash is in a Bloom filter of all values, both read off whole arrays. What passes leaves its task as the text itself, and meets
the values in an equi-join on the string, so hashes only save work and never decide.

Defined results: a null or empty text holds nothing; null and empty values are never held; rows of
texts and values that repeat count once; values of any length and number are looked for, whatever
stands around them; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.vocab import ATTACHED

#: Bits of the filter for each value, at least, and at most: 32 MB are sent to the tasks. Beyond that it lets more through, and the join decides.
BITS_EACH, LEAST_BITS, MOST_BITS = 24, 1 << 20, 1 << 28
#: Widths of a value's first bytes, which are looked for at every place.
ANCHORS = (1, 2, 4, 8)
#: Tasks that rows of one value are dealt to.
SALTS = 16
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LETTER = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]")


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ np.uint64(size)) * _ODD
    h ^= h >> np.uint64(29)
    h *= _BASE
    return h ^ (h >> np.uint64(32))


class Windows:
    """Hashes of runs of bytes: of up to eight by themselves, of others by a polynomial, summed up once for all lengths."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(raw) + 1,), "<u8", self.raw.data, 0, (1,))
        self._sums: np.ndarray | None = None

    def first(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of ``width`` bytes (eight at most), everywhere or at some places."""
        some = self.eight[:-1] if at is None else self.eight[at]
        return _mixed(some & np.uint64((1 << 8 * width) - 1), width)

    def whole(self, size: int, at: np.ndarray) -> np.ndarray:
        """Of ``size`` bytes at some places."""
        if size <= 8:
            return self.first(size, at)
        if self._sums is None:
            n = len(self.raw)
            powers = np.cumprod(np.full(n, _BASE))
            self._back = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers)])
        return _mixed((self._sums[at + size] - self._sums[at]) * self._back[at], size)


class Filter:
    """A Bloom filter of 64-bit hashes with two bits each."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return h & np.uint64(bits - 1), (h >> np.uint64(33)) & np.uint64(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, len(self.words) * 64):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
        return out


def anchor_of(size: int) -> int:
    return max(w for w in ANCHORS if w <= size)


def build_filter(values: DataFrame) -> tuple[Filter, list[int]]:
    """The filter of ``values`` (value, distinct) and their lengths in bytes; what reaches the driver is bounded by MOST_BITS and a number a length."""
    sizes = sorted((r["size"], r["n"]) for r in values.groupBy(F.octet_length("value").alias("size")).agg(F.count("*").alias("n")).collect())
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(LEAST_BITS.bit_length() - 1, (BITS_EACH * sum(n for _, n in sizes)).bit_length()))

    def fill(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                raw = np.frombuffer(value.encode(), np.uint8)
                own, at = Windows(raw), np.zeros(1, np.int64)
                for h in (own.whole(len(raw), at), own.first(anchor_of(len(raw)), at)):
                    for p in Filter.places(h, bits):
                        words[p >> np.uint64(6)] |= np.uint64(1) << (p & np.uint64(63))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["at", "word"])

    rows = values.select("value").mapInArrow(fill, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return Filter(words), [s for s, _ in sizes]


def _alone(raw: bytes, begin: int, end: int) -> bool:
    """Whether a run of bytes stands as whole words: one attached letter before it aside."""
    own = raw[begin:end].decode()
    before, after = raw[max(0, begin - 8) : begin].decode(errors="ignore"), raw[end : end + 4].decode(errors="ignore")
    if _LETTER.match(own[-1]) and after and _LETTER.match(after[0]):
        return False
    if not (_LETTER.match(own[0]) and before and _LETTER.match(before[-1])):
        return True
    return before[-1] in ATTACHED and not (len(before) > 1 and _LETTER.match(before[-2]))


def candidates(docs: DataFrame, known: Filter, sizes: list[int], text: Column) -> DataFrame:
    """``(doc_id, surface, alone)``: the windows of each row that pass the filter, each once, and whether one stands as whole words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("surface", T.StringType()), T.StructField("alone", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast((known.words, sizes))

    def find(batches):
        words, lengths = sent.value
        known, by_anchor = Filter(words), {}
        for size in lengths:
            by_anchor.setdefault(anchor_of(size), []).append(size)
        for batch in batches:
            for part in portions(batch, 1):
                yield _found(part, known, by_anchor)

    return docs.select("doc_id", text.alias("text")).filter("text <> ''").mapInArrow(find, schema)


def portions(batch: pa.RecordBatch, column: int, most: int = 1 << 21):
    """Runs of rows with about ``most`` bytes of text in a column, a row at least."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _found(part: pa.RecordBatch, known: Filter, by_anchor: dict[int, list[int]]) -> pa.RecordBatch:
    texts = [t.encode() for t in part.column(1).to_pylist()]
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    raw = np.frombuffer(joined, np.uint8)
    windows, seen = Windows(raw), {}
    for width, sizes in by_anchor.items():
        at = np.flatnonzero(known.has(windows.first(width)))
        at = at[(raw[at] & 0xC0) != 0x80]
        row = np.searchsorted(ends, at, "right")
        for size in sizes:
            fits = at + size <= ends[row]
            places, rows = at[fits], row[fits]
            hit = known.has(windows.whole(size, places))
            for p, r in zip(places[hit].tolist(), rows[hit].tolist()):
                key = (r, joined[p : p + size])
                if not seen.get(key):
                    begin = int(ends[r]) - len(texts[r])
                    seen[key] = _whole_characters(key[1]) and _alone(texts[r], p - begin, p - begin + size)
    good = [(r, s.decode(), alone) for (r, s), alone in seen.items() if _whole_characters(s)]
    rows = pa.array([r for r, _, _ in good], pa.int64())
    return pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([s for _, s, _ in good], pa.string()), pa.array([a for _, _, a in good], pa.bool_())], ["doc_id", "surface", "alone"])


def _whole_characters(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:  # a window that ends within a character
        return False
    return True


def held(docs: DataFrame, known: DataFrame, text: Column | None = None, alone: Column | None = None) -> DataFrame:
    """``(doc_id, value)``, distinct: the values of ``known`` that the texts of ``docs`` hold.

    A value counts wherever it stands; where ``alone`` (over ``value``) is true only as whole words,
    one attached letter before it aside. Rows of a value are dealt to SALTS tasks.
    """
    known = known.select("value").filter("value <> ''").distinct()
    bloom, sizes = build_filter(known)
    found = candidates(docs, bloom, sizes, F.col("text") if text is None else text)
    found = found.groupBy("doc_id", "surface").agg(F.max("alone").alias("whole"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    values = known.withColumn("must", F.lit(False) if alone is None else alone).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = found.join(values.hint("merge"), (F.col("surface") == F.col("value")) & (found["salt"] == values["salt"]))
    return pairs.filter(F.col("whole") | ~F.col("must")).select("doc_id", "value")
