"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

Texts are cut before a space that a visible character follows, between letters and simple marks,
and around single line ends. There the split pattern of a byte-level pre-tokenizer always ends a
piece, and merges never cross a piece, so the ids of the segments, end to end, are those of the
whole text. Arrow finds the distinct segments of a batch, the library encodes those that a worker
has not met, many in one call; segments are told apart by their text, never by a hash alone. Segments
of letters alone are one piece each, so they need no split pattern. A full memory keeps the segments
that more than one batch had. Texts with the string of an added token, and all texts of a tokenizer
that is set up in another way, go to the library whole.
"""

from __future__ import annotations

import functools
import json
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.words import utf8

_KEPT, _KEPT_CHARS = 500_000, 16 << 20  # segments that a worker remembers
LETTER, MARK, VISIBLE, SPACE, LINE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = VISIBLE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[list(b".,;:!?")], _KIND[32], _KIND[10] = MARK, SPACE, LINE


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8."""
    kind = _KIND[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))  # of the Latin letters beyond ASCII, in two bytes
    lead = lead[~((raw[lead] == 0xC3) & np.isin(raw[lead + 1], [0x97, 0xB7]))]  # two signs among them
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def cut_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin, for texts in UTF-8 laid end to end."""
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = _kinds(raw)
    seen = (kind > 0) & (kind <= VISIBLE)
    cut = np.zeros(len(raw) + 1, bool)
    cut[:-2] = (kind[:-1] == SPACE) & seen[1:]
    cut[1:-1] |= ((kind[:-1] == LETTER) & (kind[1:] == MARK)) | ((kind[:-1] == MARK) & (kind[1:] == LETTER))
    alone = np.flatnonzero((kind[1:-1] == LINE) & seen[:-2] & seen[2:]) + 1
    ends = np.isin(alone, offsets) | np.isin(alone + 1, offsets)
    cut[alone[~ends]] = cut[alone[~ends] + 1] = True
    last = offsets[1:-1]
    last = last[(last > 0) & (last < len(raw))]
    cut[last - 1] &= kind[last - 1] != SPACE  # a space that ends its text
    cut[offsets[offsets < len(raw)]] = True
    return np.flatnonzero(cut)


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file describes what ``Encoder`` relies on: pieces of the byte-level pattern, encoded by themselves."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = not told.get("normalizer") and not told.get("truncation") and not told.get("padding")
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    alone = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and level and alone


class Encoder:
    """``encode(texts)`` gives all ids and, for each text, where its ids begin (n + 1)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.lines = Tokenizer(self.library.model)  # each line is one piece
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_segments = cuts_at_spaces(path)
        self.widths = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)
        self.clear()

    def clear(self) -> None:
        """Forget all segments."""
        self.known: dict[str, int] = {}  # in the order of their numbers
        self.count, self.begin, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.times = np.zeros(1 << 12, np.int32)  # batches that had the segment
        self.used, self.chars = 0, 0

    def forget(self) -> None:
        """Forget the segments of one batch alone; all, if most are of more."""
        kept = np.flatnonzero(self.times[: len(self.known)] > 1)
        if 2 * len(kept) > _KEPT:
            return self.clear()
        listed = list(self.known)
        listed = [listed[i] for i in kept.tolist()]
        self.count = self.count[kept]
        self.flat, upto = _gathered(self.flat, self.begin[kept], self.count)
        self.begin, self.times = upto[:-1], np.zeros(len(kept), np.int32)
        self.known = dict(zip(listed, range(len(listed))))
        self.used, self.chars = len(self.flat), sum(len(x.encode()) for x in listed)
        if 2 * self.chars > _KEPT_CHARS:
            self.clear()

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined_ids(self, segments: list[str], sizes: np.ndarray, between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments from one call, and how many each has; cut where the bytes of tokens add up to ``sizes``."""
        return self._cut(np.array(self._library_ids([between.join(segments)])[0], np.int32), sizes, between)

    def _piece_ids(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for segments of one piece each."""
        return self._cut(np.array(self.lines.encode_batch_fast(["\n".join(segments)], add_special_tokens=False)[0].ids, np.int32), sizes, "")

    def _cut(self, ids: np.ndarray, sizes: np.ndarray, between: str) -> tuple[np.ndarray, np.ndarray]:
        upto = np.cumsum(self.widths[ids])
        ends = np.cumsum(sizes + len(between)) - len(between)
        last = np.searchsorted(upto, ends)
        if last[-1] >= len(ids) or (upto[last] != ends).any():
            raise ValueError("the tokens of joined texts do not end where the texts do")
        if between:  # of one token each
            ids = np.delete(ids, last[:-1] + 1)
            last = last - np.arange(len(last))
        return ids, np.diff(last, prepend=-1)

    def _learn(self, segments: pa.Array, listed: list[str]) -> np.ndarray:
        """Remember new segments; their numbers."""
        raw, at = utf8(segments)
        place = np.zeros(len(listed), np.int64)
        other = _kinds(raw) != LETTER
        other[at[:-1][(raw[at[:-1]] == 32) & (np.diff(at) > 1)]] = False
        letters = np.diff(np.concatenate([[0], np.cumsum(other)])[at]) == 0
        kind = _KIND[raw]
        lead, tail = kind[at[:-1]], kind[at[1:] - 1]
        spaced = (lead == SPACE) & (kind[np.minimum(at[:-1] + 1, len(raw) - 1)] != SPACE) & (np.diff(at) > 1)
        spaced &= np.isin(kind[np.minimum(at[:-1] + 1, len(raw) - 1)], [LETTER, MARK, VISIBLE])
        bare = np.isin(lead, [LETTER, MARK, VISIBLE]) & np.isin(tail, [LETTER, MARK, VISIBLE])
        spaced, bare = spaced & ~letters, bare & ~letters
        for group, between in ((letters, None), (spaced, ""), (bare, "\n"), (~letters & ~spaced & ~bare, None)):
            chosen = [listed[i] for i in np.flatnonzero(group).tolist()]
            if chosen and group is letters:
                ids, sizes = self._piece_ids(chosen, np.diff(at)[group])
            elif chosen and between is not None:
                ids, sizes = self._joined_ids(chosen, np.diff(at)[group], between)
            elif chosen:
                got = self._library_ids(chosen)
                ids, sizes = np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))
            else:
                continue
            n = len(self.known)
            place[group] = np.arange(n, n + len(chosen))
            for name, need in (("begin", n + len(chosen)), ("count", n + len(chosen)), ("times", n + len(chosen)), ("flat", self.used + len(ids))):
                have = getattr(self, name)
                if need > len(have):
                    setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))
            self.begin[n : n + len(chosen)] = self.used + np.cumsum(sizes) - sizes
            self.count[n : n + len(chosen)] = sizes
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.chars += int(np.diff(at)[group].sum())
            self.known.update(zip(chosen, range(n, n + len(chosen))))
        return place

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A null text has no ids."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self.known) > _KEPT or self.chars > _KEPT_CHARS:
            self.forget()
        whole = np.full(len(texts), not self.by_segments)
        for token in self.specials:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        raw, offsets = utf8(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        starts = cut_points(raw, offsets)
        ends = np.append(starts, len(raw)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        segments = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.get, segments, repeat(-1)), np.int64, len(segments))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = self._learn(coded.dictionary.take(pa.array(new)), [segments[i] for i in new.tolist()])
        self.times[place] += 1
        place = place[coded.indices.to_numpy()]
        ids, upto = _gathered(self.flat, self.begin[place], self.count[place])
        at = upto[np.searchsorted(starts, offsets)]
        if not whole.any():
            return ids, at
        return _spliced(ids, at, whole, [np.array(x, np.int32) for x in self._library_ids(texts.filter(pa.array(whole)).to_pylist())])


def _gathered(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` end to end, and where each begins (and the end)."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    return flat[np.repeat(begin - upto[:-1], counts) + np.arange(upto[-1])], upto


def _spliced(ids: np.ndarray, at: np.ndarray, which: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids with those of some texts replaced."""
    out, k = [], 0
    for i, own in zip(np.flatnonzero(which).tolist(), new):
        out += [ids[at[k] : at[i]], own]
        k = i + 1
    out.append(ids[at[k] : at[-1]])
    sizes = np.diff(at)
    sizes[which] = [len(x) for x in new]
    return np.concatenate(out).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with ``end`` added to each text."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))
