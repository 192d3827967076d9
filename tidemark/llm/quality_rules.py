"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document if a measure of its whole text exceeds a cutoff. Cutoffs are chosen
per stratum (``lang``) on labelled documents. All rules are tightened along one path of joint
levels, each stricter than the one before; a joint level is accepted while the exact
(Clopper-Pearson) binomial bound on the share of good documents that any rule rejects stays within
the limit. The path is fixed before good labels are looked at: it is ordered by what bad and
unlabelled documents of the stratum show. So the levels, tested in order, need no correction, and
the error level is shared among the strata alone (Bonferroni). With probability 1 - alpha, no
stratum loses more than the limit.

Defined results: a null or empty text has zero counts and fails the base rules; a stratum with too
few labels, or a null one, gets no cutoffs, so that only the base rules reject, and
``has_cutoffs`` is false for its documents; a document with several labels counts once for each; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.store import saved
from tidemark.llm.words import IS_WORD, U64, find_words, mix, new_key, portions, run_hashes, shingles, utf8

MAX_FALSE_REJECTION, ALPHA = 0.02, 0.05
_RATIOS = [round(float(x), 6) for x in np.geomspace(1.0, 0.004, 48)]
#: Rules: what is measured, against what, and the levels from loose to tight.
RULES = {
    "symbols": ("n_symbols", "word_chars", _RATIOS),
    "marks": ("n_marks", "word_chars", _RATIOS),
    "dup_lines": ("n_dup_lines", "n_lines", _RATIOS),
    "repeats": ("n_repeat_words", "n_words", _RATIOS),
    "long_words": ("word_chars", "n_words", [float(x) for x in range(60, 5, -1)]),
}
# Symbols of the base measures, and the marks that shouting texts repeat.
SYMBOLS, MARKS = "#*$%&|<>", "!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _distinct(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether its text has it more than once, and the first of each in order."""
    order = np.argsort(keys ^ mix(text.astype(U64) + U64(1)), kind="stable")
    k, t = keys[order], text[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    again, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    again[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return again, twice


def measure(raw: np.ndarray, offsets: np.ndarray, key: int = 0) -> list[np.ndarray]:
    """The counts of all texts that lie end to end in ``raw``; lines and windows of a text are equal if their hashes under ``key`` are."""
    n = len(offsets) - 1
    starts, ends, first = find_words(raw, offsets)
    inside = IS_WORD[raw]
    table = lambda chars: np.isin(np.arange(256), list(chars.encode()))
    lead = (raw & 0xC0) != 0x80
    newline = raw == 10
    # lines: between newlines and the ends of texts
    line_starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1]))
    line_text = np.searchsorted(offsets[1:], line_starts, "right")
    tail = np.flatnonzero(newline) + 1
    line_text = np.minimum(line_text, n - 1) if n else line_text
    # a newline that ends its text opens an empty line there, which has no word
    line_ends = np.append(line_starts[1:], len(raw))
    line_ends = line_ends - (np.isin(line_ends, tail) & (line_ends > line_starts)) if len(tail) else line_ends
    worded = np.searchsorted(starts, line_ends, "left") > np.searchsorted(starts, line_starts, "left")
    line_starts, line_ends, line_text = line_starts[worded], line_ends[worded], line_text[worded]
    again, _ = _distinct(run_hashes(raw, line_starts, line_ends, key), line_text)
    windows, at = shingles(run_hashes(raw, starts, ends, key), first)
    counts = np.diff(first)
    window_text = np.repeat(np.arange(n), np.diff(at))
    _, twice = _distinct(windows, window_text)
    opens = (first[:-1] - at[:-1])[window_text] + np.arange(len(windows)) if n else np.zeros(0, np.int64)
    opens = opens[twice]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, opens, 1)
    np.add.at(cover, opens + 5, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return [
        counts, _per_text(inside & lead, offsets), _per_text(table(SYMBOLS)[raw], offsets), np.bincount(line_text[again], minlength=n), _per_text(covered, first),
        np.bincount(line_text, minlength=n), _per_text(table(MARKS)[raw], offsets),
    ]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each document; no row is moved."""
    key = new_key()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            for part in portions(batch, 2):
                cols = [c.astype(np.int64) for c in measure(*utf8(part.column(2)), key)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], ["doc_id", "stratum", *COUNTS])

    rows = docs.select("doc_id", lang.alias("stratum"), "text")
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def value(rule: str) -> Column:
    """The share that a rule looks at; 0 of nothing is 0."""
    part, of, _ = RULES[rule]
    return F.col(part) / F.greatest(of, F.lit(1))


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), exactly up to rounding."""
    if k >= n:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def upper_bound(k: int, n: int, alpha: float) -> float:
    """The exact upper confidence bound on a binomial share."""
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if k < n and 0 < mid < 1 and log_binomial_cdf(k, n, mid) > math.log(alpha) else (low, mid)
    return high


def tested_strata(sizes: dict[str, int], limit: float, alpha: float) -> list[str]:
    """As many strata as have the good labels that a test at alpha over so many needs, largest first."""
    ranked = sorted(sizes, key=lambda x: (-sizes[x], x))
    needs = lambda m: math.ceil(math.log(alpha / m) / math.log1p(-limit))
    return ranked[: max((m for m in range(1, len(ranked) + 1) if sizes[ranked[m - 1]] >= needs(m)), default=0)]


def path(bad: dict[str, list[int]], n_bad: int, others: dict[str, list[int]], n_others: int) -> list[tuple[str, int]]:
    """``(rule, level)`` in the order of tightening, each rule's levels from loose to tight.

    Each step goes to the level that rejects the most bad documents (``bad``: a count for each
    level) for what it rejects of unlabelled ones (``others``). Steps that reject nothing come after
    those whose rejects are mostly bad and before the others; steps alike go by how far rules have
    been tightened, so that without such documents all are tightened together.
    """
    least, at, out = 1e-4, dict.fromkeys(RULES, -1), []
    share = n_bad / max(n_bad + n_others, 1)
    seen = lambda counts, n, name, i: counts[name][i] / max(n, 1) if i >= 0 else 0.0
    while True:
        steps = []
        for name, (_, _, levels) in RULES.items():
            now = at[name]
            for i in range(now + 1, len(levels)):
                gain = share * (seen(bad, n_bad, name, i) - seen(bad, n_bad, name, now)) + least / 2
                cost = seen(others, n_others, name, i) - seen(others, n_others, name, now) + least * (i - now)
                steps.append((-gain / cost, i / len(levels), name, i))
        if not steps:
            return out
        _, _, name, i = min(steps)
        out += [(name, k) for k in range(at[name] + 1, i + 1)]
        at[name] = i


def choose_cutoffs(counts: DataFrame, labels: DataFrame, limit: float = MAX_FALSE_REJECTION, alpha: float = ALPHA) -> list[tuple[str, str, float, float]]:
    """``(stratum, rule, cutoff, bound)``; the bound is on the share that all rules of the stratum reject.

    Rules without an accepted level in a stratum are left out. What reaches the driver is a few
    rows for each stratum with enough good labels, with as many numbers as the grids have levels.
    """
    passing = counts.filter(~base_failed() & F.col("stratum").isNotNull())
    labelled = passing.join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    labelled = saved(labelled.select("stratum", "quality", *[value(name).alias(name) for name in RULES]), "labelled")
    sizes = labelled.filter("quality = 1").groupBy("stratum").count()
    sizes = {r["stratum"]: r["count"] for r in sizes.filter(F.col("count") >= math.ceil(math.log(alpha) / math.log1p(-limit))).collect()}
    strata = tested_strata(sizes, limit, alpha)
    if not strata:
        return []
    spark = counts.sparkSession
    tested = F.broadcast(spark.createDataFrame([(x,) for x in strata], "stratum string"))
    sums = [F.count("*").alias("n")]
    for name, (_, _, levels) in RULES.items():
        sums += [F.array(*[F.count_if(F.col(name) > level) for level in levels]).alias(name)]
    bad = {r["stratum"]: r for r in labelled.filter("quality = 0").join(tested, "stratum").groupBy("stratum").agg(*sums).collect()}
    others = passing.join(labels.select("doc_id"), "doc_id", "left_anti").join(tested, "stratum").select("stratum", *[value(name).alias(name) for name in RULES])
    others = {r["stratum"]: r for r in others.groupBy("stratum").agg(*sums).collect()}
    none = {"n": 0} | {name: [0] * len(levels) for name, (_, _, levels) in RULES.items()}
    paths = {}
    for x in strata:
        b, o = bad.get(x, none), others.get(x, none)
        paths[x] = path(b, b["n"], o, o["n"])
    # the step that first rejects a document: of each rule, that of its loosest level below the value
    total = sum(len(levels) for _, _, levels in RULES.values())
    steps = []
    for x, steps_of in paths.items():
        place = {step: i for i, step in enumerate(steps_of)}
        steps.append((x, *[[place[name, k] for k in range(len(levels))] + [total] for name, (_, _, levels) in RULES.items()]))
    steps = spark.createDataFrame(steps, "stratum string, " + ", ".join(f"at_{name} array<int>" for name in RULES))
    loosest = lambda name: F.size(F.filter(F.array(*map(F.lit, RULES[name][2])), lambda level: level >= F.col(name)))
    first = F.least(*[F.get(f"at_{name}", loosest(name)) for name in RULES])
    rejected = {x: [0] * (total + 1) for x in strata}
    for r in labelled.filter("quality = 1").join(F.broadcast(steps), "stratum").groupBy("stratum", first.alias("step")).count().collect():
        rejected[r["stratum"]][r["step"]] = r["count"]
    out = []
    for x in strata:
        n, k, cut, bound = sizes[x], 0, {}, 1.0
        for (name, level), more in zip(paths[x], rejected[x]):
            k += more
            if k > limit * n or log_binomial_cdf(k, n, limit) > math.log(alpha / len(strata)):
                break
            cut[name], bound = RULES[name][2][level], k
        if cut:
            bound = upper_bound(bound, n, alpha / len(strata))
            out += [(x, name, level, bound) for name, level in cut.items()]
    return out


def judge(docs: DataFrame, labels: DataFrame, limit: float = MAX_FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """The counts of every document, base_failed, kept: it passes the base rules and all cutoffs, and has_cutoffs: its stratum has any."""
    counts = saved(counted(docs), "counts")
    cutoffs = choose_cutoffs(counts, labels, limit, alpha)
    rejected, ruled = F.lit(False), F.lit(False)
    for stratum, rule, level, _ in cutoffs:
        rejected = rejected | (F.col("stratum").eqNullSafe(stratum) & (value(rule) > level))
    for stratum in sorted({c[0] for c in cutoffs}):
        ruled = ruled | F.col("stratum").eqNullSafe(stratum)
    return counts.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), ruled.alias("has_cutoffs"))
