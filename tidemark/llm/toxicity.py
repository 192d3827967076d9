"""Toxicity by a learned lexicon, caught with Levenshtein automata.

Terms are all words that labelled training documents tie to toxicity, whatever their number. Their
trie is intersected with Levenshtein automata into one deterministic automaton that accepts each
term and each misspelling within its distance; its states are made as texts reach them, and it runs
over all words of a batch at once, a character a step. A hit counts
as quoted if quotation marks stand in the window of words on both of its sides. A logistic model
over the weights of plain and of quoted hits gives the score.

Defined results: a null or empty text has the score of no hits; without any toxic training row the
lexicon is empty and all scores are the share of toxic rows (0 without rows); repeated rows score
alike, and a training text counts once for each label it has, however many rows have it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.words import portions

TRAINING_ROWS = 20_000  # labelled rows that the model is fitted on, at most (about)
LEAST_SUPPORT, LEAST_SHARE, LEAST_PRECISION = 4, 0.004, 0.85
MOST_CELLS = 1 << 24  # transitions that a worker keeps between batches; beyond it they are made again
EXACT_BELOW = 5  # terms with fewer characters must match exactly
CONTEXT_WORDS = 8
# Quotation marks.
QUOTES = "\"“”„«»‹›「」『』"
WORD = r"[\p{L}\p{N}]+"
FEATURES = 5


class Automaton:
    """A trie of terms within Levenshtein distance: transitions, and the term and distance each state accepts (-1: none).

    States are sets of (trie node, edits so far); symbol 0 is any character outside the alphabet,
    state 0 is dead and state 1 the start. States are made when a text first reaches them, so a
    lexicon of any size costs only what its texts meet.
    """

    def __init__(self, terms: list[str], distance: int = 1) -> None:
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t}))}
        self.symbols = ["", *self.alphabet]
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, int]] = {}  # node: the term that ends there, and its distance
        self.edits = [0]  # most edits of any term below a node
        for k, term in enumerate(terms):
            allowed, node = distance if len(term) >= EXACT_BELOW else 0, 0
            self.edits[0] = max(self.edits[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            self.ends[node] = (k, allowed)
        self.clear()

    def clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves = np.full((64, len(self.symbols)), -1, np.int32)  # -1: not made yet
        self.accept, self.cost = np.full(64, -1, np.int32), np.zeros(64, np.int8)
        self.state(frozenset())
        self.state(self.closed([(0, 0)]))
        self.moves[0] = 0

    def closed(self, pairs) -> frozenset:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.edits[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.edits[node]:
                todo += [(child, e + 1) for child in self.children[node].values()]  # the text lacks a character
        return frozenset(best.items())

    def state(self, pairs: frozenset) -> int:
        if pairs in self.number:
            return self.number[pairs]
        i = self.number[pairs] = len(self.states)
        self.states.append(pairs)
        if i == len(self.accept):
            self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
            self.accept, self.cost = np.concatenate([self.accept, np.full_like(self.accept, -1)]), np.concatenate([self.cost, np.zeros_like(self.cost)])
        found = sorted((e, self.ends[node][0]) for node, e in pairs if node in self.ends and e <= self.ends[node][1])
        if found:
            self.cost[i], self.accept[i] = found[0]
        return i

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        to = self.moves[state, symbol]
        new = to < 0
        if not new.any():
            return to
        for key in np.unique(state[new].astype(np.int64) * len(self.symbols) + symbol[new]).tolist():
            i, k = divmod(key, len(self.symbols))
            c, moves = self.symbols[k], []
            for node, e in self.states[i]:
                own = self.children[node]
                if c in own:
                    moves.append((own[c], e))
                if e < self.edits[node]:
                    moves += [(child, e + 1) for child in own.values()]
                    moves.append((node, e + 1))
            j = self.state(self.closed(moves))
            self.moves[i, k] = j
        return self.moves[state, symbol]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # of exact hits
    forms: dict[str, float] = field(default_factory=dict)  # weights of misspellings that training texts have
    unseen: float = 0.5  # share of a term's weight for a misspelling that they lack
    coefficients: list[float] = field(default_factory=lambda: [0.0] * FEATURES)


class Matcher:
    """Runs a model's automaton over whole texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.automaton = Automaton(model.terms)
        self.longest = max(map(len, model.terms), default=0) + 1

    @cached_property
    def kinds(self) -> np.ndarray:
        kinds = np.zeros(0x110000, np.min_scalar_type(len(self.automaton.symbols)))  # 0: between words, 1: a character of words
        for i in range(0x110000):
            if chr(i).isalnum():
                kinds[i] = 1
        for c, k in self.automaton.alphabet.items():
            kinds[ord(c)] = k + 1
        return kinds

    def words(self, texts: list[str]):
        """Code points, words' starts and ends, each text's first word, automaton symbols; ``offsets``: where each text begins."""
        lowered = [t.lower() for t in texts]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])
        self.offsets = offsets
        kind = self.kinds[codes]
        inside = kind > 0
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(codes))]
        begin[cuts], stop[cuts - 1] = inside[cuts], inside[cuts - 1]
        starts = np.flatnonzero(begin)
        return codes, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets), kind

    def hits(self, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that the automaton accepts, and their final states (valid until the next call)."""
        if self.automaton.moves.size > MOST_CELLS:
            self.automaton.clear()  # made anew as texts need them
        live = np.flatnonzero((ends - starts <= self.longest) & (ends > starts))
        state = np.ones(len(live), np.int32)
        words, states = [], []
        for step in range(self.longest):
            if not len(live):
                break
            state = self.automaton.step(state, kind[starts[live] + step].astype(np.int64) - 1)
            done = ends[live] - starts[live] == step + 1
            found = done & (self.automaton.accept[state] >= 0)
            words.append(live[found])
            states.append(state[found])
            on = ~done & (state > 0)
            live, state = live[on], state[on]
        word = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(word, kind="stable")
        return word[order], np.concatenate([*states, np.zeros(0, np.int32)]).astype(np.int64)[order]

    def features(self, texts: list[str]) -> np.ndarray:
        codes, starts, ends, first, kind = self.words(texts)
        word, state = self.hits(starts, ends, kind)
        n = len(texts)
        text = np.searchsorted(first[1:], word, "right")
        weight = np.array(self.model.weights, float)[self.automaton.accept[state]] if len(word) else np.zeros(0)
        for i in np.flatnonzero(self.automaton.cost[state] > 0).tolist():
            form = "".join(map(chr, codes[starts[word[i]] : ends[word[i]]].tolist()))
            weight[i] = self.model.forms.get(form, self.model.unseen * weight[i])
        marks = np.concatenate([[0], np.cumsum(np.isin(codes, [ord(c) for c in QUOTES]))]) if len(word) else np.zeros(1, np.int64)
        if len(word):
            low, high = np.maximum(word - CONTEXT_WORDS, first[text]), np.minimum(word + CONTEXT_WORDS, first[text + 1] - 1)
            # a mark of the text may stand before the first word of the window or after its last
            left = marks[starts[word]] - marks[np.maximum(starts[low] - 1, self.offsets[text])]
            right = marks[np.minimum(ends[high] + 1, self.offsets[text + 1])] - marks[ends[word]]
            quoted = (left > 0) & (right > 0)
        else:
            quoted = np.zeros(0, bool)
        plain = np.bincount(text[~quoted], weight[~quoted], n)
        said = np.bincount(text[quoted], weight[quoted], n)
        size = np.maximum(np.diff(first), 1)
        return np.column_stack([np.ones(n), np.sign(plain) * np.log1p(np.abs(plain)), np.sign(said) * np.log1p(np.abs(said)), plain / np.sqrt(size), np.minimum(plain, 20) / 10])


def sample(labels: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` labelled rows, picked by a hash of doc_id."""
    n = labels.count()
    return labels if n <= most else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(most / n * 1_000_000))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Lexicon and weights from labelled documents: ``labels`` has doc_id and toxic (0 or 1).

    Evidence is counted over distinct texts, so a group of copies weighs as much as one of them,
    and every word with enough of it is a term.
    """
    labels = sample(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna(), rows)
    # at most about ``rows`` pairs of numbers are broadcast, so that no text is moved
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id")
    texts = saved_texts(texts.select(F.monotonically_increasing_id().alias("row"), "toxic", "text", F.sha2("text", 256).alias("digest")))
    # one row of each text and label; as few numbers as labels
    firsts = saved_texts(texts.groupBy("digest", "toxic").agg(F.min("row").alias("row")).select("row"))
    texts = texts.join(F.broadcast(firsts), "row", "left_semi").select("toxic", "text")
    n, bad = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == n:
        return Model(coefficients=[math.log((bad + 0.5) / (n - bad + 0.5)) if n else -20.0] + [0.0] * (FEATURES - 1))
    words = texts.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    precision = (F.col("bad") + 0.5) / (F.col("n") + 1)
    chosen = counts.filter((F.col("bad") >= max(LEAST_SUPPORT, LEAST_SHARE * bad)) & (precision >= LEAST_PRECISION) & (F.length("word") >= 3))
    chosen = chosen.orderBy(F.desc("bad"), "word").collect()  # words of at most ``rows`` texts that have the support
    odds = lambda b, m: math.log((b + 0.5) / (bad + 1)) - math.log((m - b + 0.5) / (n - bad + 1))
    model = Model([r["word"] for r in chosen], [odds(r["bad"], r["n"]) for r in chosen])
    sent = docs.sparkSession.sparkContext.broadcast(Matcher(model))  # a trie of the terms

    def near(frames):
        own = sent.value
        for frame in frames:
            texts = frame["word"].tolist()
            _, starts, ends, first, kind = own.words(texts)
            word, state = own.hits(starts, ends, kind)
            word = word[own.automaton.cost[state] > 0]
            yield frame.iloc[np.searchsorted(first[1:], word, "right")]

    # misspellings of the terms in the training rows
    known = set(model.terms)
    for r in counts.mapInPandas(near, counts.schema).filter("n >= 2").collect():
        if r["word"] not in known:
            model.forms[r["word"]] = max(0.0, odds(r["bad"], r["n"]))
    sent_all = docs.sparkSession.sparkContext.broadcast(Matcher(model))

    def measure(frames):
        own = sent_all.value
        for frame in frames:
            x = own.features(frame["text"].tolist())
            yield pd.DataFrame(np.column_stack([frame["toxic"], x]), columns=["y", *[f"x{i}" for i in range(FEATURES)]])

    # ``rows`` rows of a few numbers
    table = texts.mapInPandas(measure, "y double, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas().to_numpy()
    y, x = table[:, 0], table[:, 1:]
    b, ridge = np.zeros(FEATURES), np.diag([1e-6] + [1e-2] * (FEATURES - 1))
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.coefficients = b.tolist()
    return model


def saved_texts(texts: DataFrame) -> DataFrame:
    from tidemark.llm.store import saved

    return saved(texts, "training")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxic_score``; only the text is looked at, and no row is moved."""
    sent = docs.sparkSession.sparkContext.broadcast(Matcher(model))
    names = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any names
    at = docs.columns.index("text")

    def run(batches):
        own, b = sent.value, np.array(model.coefficients)
        for batch in batches:
            for part in portions(batch, at):
                x = own.features([t or "" for t in part.column(at).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*names, "score"])

    plain = docs.toDF(*names)
    rows = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("score").alias("toxic_score"))


def below(docs: DataFrame, model: Model, cutoff: float) -> DataFrame:
    """The rows of ``docs`` that score below ``cutoff``, with their columns alone."""
    rows = score(docs, model)
    return rows.filter(F.col(rows.columns[-1]) < cutoff).select(*docs.columns)
