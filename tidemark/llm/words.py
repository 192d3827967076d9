"""Vectorised words and word hashes of whole texts, straight from Arrow buffers.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), so words never
split a UTF-8 character. Hashes are 64 bits with a key: one that is drawn for each run, as the
operators do, is not known to whoever wrote the texts, so no two can be made to agree.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from collections.abc import Callable

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system's allocator
    _libc = None
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEPS = 256  # steps of eight bytes; what is left of longer runs is hashed by itself
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def new_key() -> int:
    """A key for the hashes of one run, drawn on the driver."""
    return secrets.randbits(64)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of ``raw[s:e]`` for each run under ``key``.

    Eight bytes a step go through a bijective mixer, so runs of equal length up to eight bytes never
    share a hash. Of longer ones a later step can undo what an earlier one did, but only for who knows
    the key, which enters before the first; else they agree by chance alone.
    """
    sizes = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    out = mix(mix(np.array([key], U64)) ^ (sizes.astype(U64) * U64(_BASE) + U64(1)))
    live, at, left = np.flatnonzero(sizes > 0), starts[sizes > 0], sizes[sizes > 0]
    for _ in range(_STEPS):
        if not len(live):
            return out
        words = view[at]
        short = np.flatnonzero(left < 8)
        words[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        out[live] = mix(out[live] ^ words) * U64(_BASE)
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i, a, n in zip(live.tolist(), at.tolist(), left.tolist()):  # very long runs
        rest = hashlib.blake2b(raw[a : a + n].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        out[i] ^= np.frombuffer(rest, "<u8")[0]
    out[live] = mix(out[live])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, text: int, most: int = 1 << 21, rows: int = 4096):
    """Cut a batch into runs of rows with about ``most`` bytes of text, a row at least."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, min(at + rows, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield batch.slice(at, upto - at)
        at = upto
    give_back()


_kept: dict[str, tuple[int | None, Callable[[], None]]] = {}  # by name: the stage that used it last, and what empties it


def _stage() -> int | None:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.stageId() if task else None


def keep(name: str, forget: Callable[[], None]) -> None:
    """Tell that this worker keeps something for further tasks of its stage."""
    _kept[name] = _stage(), forget


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should not hold it.

    What tasks of another stage have kept goes first.
    """
    for name in [n for n, (stage, _) in _kept.items() if stage != _stage()]:
        _kept.pop(name)[1]()
    if _libc is not None:
        _libc.malloc_trim(0)


def find_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (n + 1 positions)."""
    inside = IS_WORD[raw]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[cuts] = inside[cuts]
    stop[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5):
    """Hashes of all runs of ``width`` words within a text, and the first of each text.

    A text with fewer words than ``width`` but one at least has one shingle of all its words.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    pos = first[text] + np.arange(at[-1]) - at[text]
    out = np.zeros(len(pos), U64)
    last = first[text + 1]
    for k in range(width):
        here = pos + k
        ok = here < last
        out = np.where(ok, mix(out * U64(0xD6E8FEB86659FD93) + hashes[np.minimum(here, max(len(hashes) - 1, 0))]), out) if len(hashes) else out
    return out, at
