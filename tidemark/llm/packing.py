"""Order-preserving packing of token streams into windows by dynamic programming.

The ids of a range of documents form one stream in doc_id order. Cuts may lie where a document or
a sentence ends; between two such cuts that lie more than a window apart, all windows but the last
are full. The cost of a path of cuts is its padding, plus a penalty for each cut within a document
and for each window that is cut full within a sentence. For each number of windows between two
cuts, a monotone queue keeps the best earlier cut, so that a cut costs constant time.

Defined results: a null text is empty and has the end id only; equal doc_ids follow each other in
order of text; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.pieces import encoder
from tidemark.llm.simple8b import in_ranges, token_batches

SENTENCE_CUT, FULL_CUT = 2.0, 8.0  # penalties in tokens of padding
REACH = 3  # windows between two neighbouring cuts at most
SEGMENT = 1 << 19  # ids that a task holds at once
# Characters that end a sentence.
SENTENCE_ENDS = [".", "!", "?", "\n", "。", "！", "？"]


def choose_cuts(places: np.ndarray, within: np.ndarray, window: int) -> list[int]:
    """The ends of all windows. ``places``: ascending possible cuts, the last is the stream's end.

    ``within``: whether a place lies within a document. Gaps of more than a window get more places.
    """
    places = np.concatenate([[0], places])
    gaps = np.diff(places)
    if (wide := np.flatnonzero(gaps > window)).size:
        extra = np.concatenate([np.arange(places[i] + window, places[i + 1], window) for i in wide])
        at = np.searchsorted(places, extra)
        places = np.insert(places, at, extra)
        within = np.insert(within, at - 1, 2)
    penalty = np.concatenate([[0], np.where(within == 2, FULL_CUT, np.where(within == 1, SENTENCE_CUT, 0.0))]).tolist()
    at = places.tolist()
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    queues = [deque() for _ in range(REACH)]  # queue q: places for q + 1 windows, best first
    nexts = [0] * REACH
    for j in range(1, n):
        here, best, parent = at[j], float("inf"), 0
        for q in range(REACH):
            queue, span, enter = queues[q], (q + 1) * window, here - q * window
            i = nexts[q]
            while i < j and at[i] < enter:  # near enough for q + 1 windows, too far for q
                value = cost[i] + at[i]
                while queue and queue[-1][0] >= value:
                    queue.pop()
                queue.append((value, i))
                i += 1
            nexts[q] = i
            while queue and at[queue[0][1]] < here - span:
                queue.popleft()
            if queue:
                total = queue[0][0] + span - here + q * FULL_CUT
                if total < best:
                    best, parent = total, queue[0][1]
        cost[j], back[j] = best + penalty[j], parent
    cuts, j = [], n - 1
    while j:
        i = back[j]
        full = range(at[i] + window, at[j], window)
        cuts.extend([at[j], *reversed(full)])
        j = i
    return cuts[::-1]


@functools.cache
def _sentence_table(tokenizer: str) -> np.ndarray:
    library = encoder(tokenizer).library
    texts = library.decode_batch([[i] for i in range(library.get_vocab_size())])
    return np.array([t.rstrip(" ").endswith(tuple(SENTENCE_ENDS)) for t in texts])


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0) -> DataFrame:
    """A row for each piece of a document: where it lies in the document and in its sequence.

    Sequences are numbered within each range of documents: the range's number times 2**40, plus
    one for each. Documents are never reordered; ``docs`` needs doc_id and text.
    """

    def run(batches):
        from pyspark import TaskContext

        ends_sentence, sequence = _sentence_table(tokenizer), TaskContext.get().partitionId() << 40
        held: list[list] = []  # doc_id, ids, ids that are out already, ids of the whole document
        size = 0

        def flush(last: bool):
            nonlocal sequence, size, held
            if not held:
                return None
            stream = np.concatenate([d[1] for d in held])
            doc_ends = np.cumsum([len(d[1]) for d in held])
            marks = ends_sentence[stream]
            marks[doc_ends - 1] = True
            places = np.flatnonzero(marks) + 1
            within = np.ones(len(places), np.int8)
            within[np.searchsorted(places, doc_ends)] = 0
            cuts = choose_cuts(places, within, window)
            if not last and len(cuts) > 1:
                cuts.pop()
            stop = cuts[-1]
            edges = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends < stop]]))
            lows, highs = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, lows, "right")
            doc_low = doc_ends - np.array([len(d[1]) for d in held])
            seq = np.searchsorted(cuts, lows, "right")
            seq_low = np.concatenate([[0], cuts])[seq]
            raw = memoryview(stream.astype("<u4").tobytes())
            done = np.array([d[2] for d in held])
            out = pa.RecordBatch.from_arrays([
                pa.array([held[d][0] for d in doc.tolist()], pa.int64()), pa.array(lows - doc_low[doc] + done[doc]), pa.array(highs - lows),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lows.tolist(), highs.tolist())], pa.int64()),
                pa.array([held[d][3] for d in doc.tolist()], pa.int64()), pa.array(seq + sequence), pa.array(lows - seq_low),
            ], NAMES)
            sequence += len(cuts)
            first = int(np.searchsorted(doc_ends, stop, "right"))
            rest = held[first:]
            if rest:
                gone = stop - int(doc_low[first])
                rest[0] = [rest[0][0], rest[0][1][gone:], rest[0][2] + gone, rest[0][3]]
            held, size = rest, int(doc_ends[-1]) - stop
            return out

        for doc_ids, ids, at in token_batches(batches, tokenizer, end):
            for i, doc_id in enumerate(doc_ids):
                held.append([doc_id, ids[at[i] : at[i + 1]], 0, int(at[i + 1] - at[i])])
            size += len(ids)
            if size >= SEGMENT and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return in_ranges(docs, ["doc_id", "text"]).mapInArrow(run, SCHEMA)
