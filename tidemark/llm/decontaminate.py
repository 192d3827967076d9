"""Benchmark decontamination, in DataFrame operations only.

Windows of a document as long as a benchmark item get a 64-bit SimHash of their word shingles.
Fingerprints are cut into radius + 1 blocks; two that differ in at most ``radius`` bits agree in a
block, so a hash join on an item and a block finds every item within the radius. Candidates are verified by the
exact weighted-shingle similarity: shingles weigh as often as they occur, sum of minima over sum of
maxima.

Which windows: a window that reaches the threshold for an item holds a shingle of that item. Moving
its start on to its first such shingle loses none, so each item is looked for only in windows that
begin with one of its own shingles, and blocks alone never bring unlike texts together; no window that
could reach the threshold is lost. All this happens where the text is
read; what is shuffled is a row for each verified pair.

Defined results: words are runs without ASCII white space, in lower case; null and empty texts and
items fit nothing; a text of fewer than five words has one shingle of all its words; windows at the
end of a document may be shorter; of equally similar windows the first counts; rows with equal
doc_id are one document; items with equal text are all reported; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import free_names
from tidemark.llm.components import SALTS

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 20
#: Rows of items' shingles, or of items' blocks, up to this many (about 64 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
_WHITE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WHITE), lambda w: w != "")


def with_shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``shingles``: hashes of all runs of five words, in order."""
    # a generator on each level keeps the arrays from being computed again for every element
    rows = rows.select(*keep, F.explode(F.array(words(F.col("text")))).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - WIDTH), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WIDTH)]))
    short = F.when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " "))))
    return rows.select(*keep, F.when(F.size("w") >= WIDTH, runs).otherwise(short).alias("shingles")).filter(F.col("shingles").isNotNull())


def _adder(k: int, ones: int):
    return lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ones))


def simhash(shingles: Column, lane: int) -> Column:
    """Bit b is set if more than half of the shingles have it; ``lane`` bits count each bit."""
    lanes = 64 // lane
    ones = sum(1 << (lane * j) for j in range(lanes))
    bits = F.lit(0).cast("long")
    for k in range(lane):
        total = F.aggregate(shingles, F.lit(0).cast("long"), _adder(k, ones))
        for j in range(lanes):
            count = F.shiftrightunsigned(total, lane * j).bitwiseAND(F.lit((1 << lane) - 1))
            b = k + lane * j
            value = (1 << b) if b < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * count > F.size(shingles), F.lit(value)).otherwise(F.lit(0).cast("long")))
    return bits


def blocks(fingerprint: Column, radius: int = RADIUS) -> list[Column]:
    """The fingerprint cut into radius + 1 runs of bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of how often each shingle occurs."""
    common = F.array_intersect(a, b)
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h))))
    return both / (F.size(a) + F.size(b) - both)


def _sent(rows: int):
    """What to do with a table of so many rows in a join: send it to all tasks, or leave it."""
    return F.broadcast if rows <= MOST_BROADCAST else (lambda df: df)


def starts(items: DataFrame) -> DataFrame:
    """(size, h, item_ids): the shingles that windows may begin with, and whose they are."""
    return items.select("size", "item_id", F.explode(F.array_distinct("shingles")).alias("h")).groupBy("size", "h").agg(F.collect_set("item_id").alias("item_ids"))


def met(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Windows (item_ids, print: the items that have their first shingle, and their fingerprint) and those of the items that agree in a block; a row for each such block.

    The index has radius + 1 rows an item.
    """
    index = items.select("item_id", "item_print", F.posexplode(F.array(*blocks(F.col("item_print"), radius))).alias("block", "value"))
    probes = windows.withColumn("item_id", F.explode("item_ids")).drop("item_ids")
    probes = probes.select("*", F.posexplode(F.array(*blocks(F.col("print"), radius))).alias("block", "value"))
    return probes.join(_sent(items.count() * (radius + 1))(index), ["item_id", "block", "value"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, item_id, start, similarity)``: the best window of each document for each item."""
    items = with_shingles(benchmark.select("item_id", "text"), "item_id").select("item_id", "shingles", F.size("shingles").alias("size"))
    n, longest = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    lane = 16 if longest < 1 << 15 else 32
    small = _sent(n)
    items = items.withColumn("item_print", simhash(F.col("shingles"), lane))

    rows = with_shingles(docs.select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", "shingles", F.posexplode("shingles").alias("pos", "h"))
    windows = rows.join(small(starts(items)), "h").select("doc_id", "pos", "item_ids", F.slice("shingles", F.col("pos") + 1, F.col("size")).alias("window"))
    near = met(windows.withColumn("print", simhash(F.col("window"), lane)), items, radius)
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    # of all blocks in which a pair agrees, the first stands for it
    first = F.array_position(F.array(*[(x == 0) for x in blocks(apart, radius)]), True) - 1
    near = near.filter((F.bit_count(apart) <= radius) & (first == F.col("block"))).select("doc_id", "pos", "window", "item_id")
    pairs = near.join(small(items.select("item_id", "shingles")), "item_id").select("doc_id", "item_id", "pos", similarity(F.col("window"), F.col("shingles")).alias("similarity"))
    pairs = pairs.filter(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("pos", "similarity"), F.struct("similarity", -F.col("pos")))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.pos").cast("long").alias("start"), F.col("b.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text has no passage of the benchmark, with all their columns.

    A row is judged by its text alone, whatever other rows have its doc_id, or none.
    """
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    found = find_leaks(docs.select(digest.alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("digest")).distinct()
    # copies of one text are dealt to SALTS tasks by their row
    key, salt = free_names(docs, "_digest", "_salt")
    rows = docs.withColumn(key, digest).withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    found = found.select(F.col("digest").alias(key), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt)).hint("merge")
    return rows.join(found, [key, salt], "left_anti").select(*docs.columns)
