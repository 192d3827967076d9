"""Fill-in-the-middle: a text's middle is moved to its end, cut at exact ranks of units.

Ranks are found in an indexable skip list over the text's units. Its lowest lane has a link for each
unit; a link of each express lane covers STEP links of the lane below. Every link carries its width
in units, in code points and in bytes, so a descent that adds widths up reaches a rank after at most
STEP links a lane, and tells where the cut lies in all three.

Defined results: a null or empty text is plain with n = 0; a text that holds a sentinel is plain, as
its parts could not be told apart; a null doc_id draws as the empty id; rows with one id draw alike,
each is cut by its own text; texts are of any length, and a lane takes a byte a unit where widths are
small; an empty table gives none; all columns come through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import free_names
from tidemark.llm.words import portions

STEP = 16
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINTS = None


class SkipList:
    """Lanes of link widths over the units of one text, the lowest first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        """``points`` and ``sizes``: code points and bytes of each unit, in order."""
        self.n = len(points)
        lane = tuple(_small(x) for x in (np.ones(self.n, np.int64), points, sizes))
        self.lanes = [lane]
        while len(lane[0]) > STEP:
            at = np.arange(0, len(lane[0]), STEP)
            lane = tuple(_small(np.add.reduceat(x, at, dtype=np.int64)) for x in lane)
            self.lanes.append(lane)

    def seek(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit with ``rank`` (counted from 0; n: the end)."""
        link, done = 0, [0, 0, 0]
        for units, points, sizes in reversed(self.lanes):
            link *= STEP
            while link < len(units) and done[0] + int(units[link]) <= rank:
                done = [a + int(w[link]) for a, w in zip(done, (units, points, sizes))]
                link += 1
        return done[1], done[2]


def _small(widths: np.ndarray) -> np.ndarray:
    return widths.astype(np.min_scalar_type(int(widths.max()) if len(widths) else 0))


def units_of(raw: bytes, pattern: regex.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points and bytes of each unit of a text in UTF-8.

    Without a pattern units are code points. With one, a unit begins at each match, from left to
    right, and reaches to the next; what stands before the first match belongs to it.
    """
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    sizes = np.diff(starts, append=len(raw))
    if pattern is None:
        return np.ones(len(starts), np.int64), sizes
    begin = np.array([m.start() for m in pattern.finditer(raw.decode()) if m.end() > m.start()], np.int64)
    if not len(begin):
        return (np.array([len(starts)]), np.array([len(raw)])) if len(starts) else (begin, begin)
    begin[0] = 0
    return np.diff(begin, append=len(starts)), np.add.reduceat(sizes, begin)


def moved(raw: bytes, draws: tuple[int, int, int, int], pattern: regex.Pattern | None, marks: Iterable[bytes], percent: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    marks = tuple(marks)
    units = SkipList(*units_of(raw, pattern))
    plain = (units.n, "plain", None, None, raw)
    if not raw or draws[2] % 100 >= percent or any(m in raw for m in marks):
        return plain
    low, high = sorted((draws[0] % (units.n + 1), draws[1] % (units.n + 1)))
    (first, a), (second, b) = units.seek(low), units.seek(high)
    p, s, m = marks
    form, out = ("spm", [s, raw[b:], p, raw[:a], m, raw[a:b]]) if draws[3] % 100 < spm else ("psm", [p, raw[:a], s, raw[b:], m, raw[a:b]])
    out = b"".join(out)
    # sentinels that a text's ends could complete would be found twice
    return (units.n, form, first, second - first, out) if all(out.count(x) == 1 for x in marks) else plain


def draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS, unit: str | None = CODE_POINTS) -> DataFrame:
    """All columns of ``docs``, and n, form, prefix_chars, middle_chars and output (with underscores where a name is taken).

    ``percent`` of a hundred texts are transformed, of these ``spm`` of a hundred with the suffix first. ``unit`` is
    the expression of a unit, for cuts at words or sentences. No row is moved.
    """
    own = free_names(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    names = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any names
    at, width = docs.columns.index("text"), len(names)
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        pattern, marks = regex.compile(unit) if unit else None, [s.encode() for s in sentinels]
        for batch in batches:
            for part in portions(batch, at):
                drawn = zip(*(part.column(width + i).to_pylist() for i in range(4)))
                done = [moved((t or "").encode(), d, pattern, marks, percent, spm) for t, d in zip(part.column(at).to_pylist(), drawn)]
                cols = [pa.array(x, kind) for x, kind in zip(zip(*[(*d[:4], d[4].decode()) for d in done]), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *cols], [*names, *[f.name for f in added]])

    key = docs.columns.index("doc_id")
    plain = docs.toDF(*names).withColumns({f"h{i}": h for i, h in enumerate(draws(F.col(names[key]), seed))})
    rows = plain.mapInArrow(run, T.StructType([*plain.schema.fields[:width], *added]))
    return rows.toDF(*docs.columns, *own)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from, by its sentinels alone."""
    p, s, m = (F.lit(x) for x in sentinels)
    head, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.split_part(F.split_part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
