"""N-gram Jaccard joins by a MinHash LSH forest with exact verification.

Each text is the set of its five-word shingles. Texts with equal sets are copies; one stands for
all. A signature holds ``TREES`` labels of ``DEEPEST`` minima (one permutation cut into bins; empty
bins borrow from others in an order of their own). Each tree's labels are sorted, by range
partitions; the prefixes that neighbours in that order share are the forest's tries, and one pass
over them gives, for every text, the least deep node that it hangs on. The tries are then walked
from full depth up. Texts below one node of some tree are candidates, and are compared exactly, each
pair once, at the deepest level that brings it together. What nodes of all trees connect goes together
to blocks of bounded size, so that a text is not sent once for each tree; there only pairs that share
a node are compared, or all if the group is small.
The links found tell how many more a shorter prefix would find: each stands for 1/p links of its
similarity, p being the chance to share a prefix of the level in some tree. Prefixes are shortened
until the share that this leaves unfound, with one more link at the threshold itself for what no
link has shown yet, falls below the target.

Defined results: words are runs without ASCII white space, as they are written; a text of fewer
than five words has one shingle of all its words; a null, empty or blank text is alone in its
class; a row without doc_id has no class and no links; rows with equal doc_id and shingles are
copies of each other, rows with equal doc_id and other shingles are texts of their own; an empty
table gives no rows. ``class_id`` is the least doc_id of all texts that links connect, ``n_links``
the number of other rows with a similarity of the threshold or more. Texts are told apart by a
128-bit digest of their sets, shingles by 64-bit hashes of five words under a key drawn for each run;
so which of the few links beyond the recall's target are missed may differ from run to run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.components import components, components_of_some_first, spread
from tidemark.llm.store import saved
from tidemark.llm.words import U64, find_words, mix, new_key, portions, run_hashes, shingles, utf8

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.99999
TREES, DEEPEST, SHORTEST = 32, 8, 3
FIRST_TREES = 4  # whose groups are settled first, where edges are many; most others repeat them
FEW_EDGES = 4  # a text, up to which all trees are settled at once, in half the jobs
MINIMUM_BYTES = 2  # of each minimum in a label; agreement by chance only adds candidates
SMALL = 64  # texts of a group that are all compared, whether they share a node or not
BLOCK = 1024  # texts compared with as many others at once
BINS = 20  # of similarity between the threshold and 1
_EMPTY = np.iinfo(np.uint64).max


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That two texts share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def reached(links: dict[int, int], depth: int, threshold: float) -> float:
    """The estimated share of all links that prefixes of ``depth`` find; ``links``: how many of each bin of similarity."""
    unfound, found = 1 - chance(threshold, depth), sum(links.values())
    for bin_, n in links.items():
        p = chance(threshold + (1 - threshold) * bin_ / BINS, depth)
        unfound += n * (1 - p) / p
    return 1 - unfound / (found + unfound + 1)


def sets_of(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingles of each text, end to end, and where each text's begin."""
    starts, ends, first = find_words(raw, offsets)
    values, at = shingles(run_hashes(raw, starts, ends, key), first, width)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(offsets)))


def labels(values: np.ndarray, at: np.ndarray, trees: int = TREES) -> np.ndarray:
    """For each text the label of each tree: the bytes of its minima (texts x trees x bytes)."""
    n, bins = len(at) - 1, trees * DEEPEST
    text = np.repeat(np.arange(n), np.diff(at))
    h = mix(values ^ U64(0x5851F42D4C957F2D))
    bin_ = ((h >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    key = text * bins + bin_
    order = np.argsort(key, kind="stable")
    key, h = key[order], mix(h[order])
    opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    table = np.full(n * bins, _EMPTY, U64)
    if len(opens):
        table[key[opens]] = np.minimum.reduceat(h, opens)
    table = table.reshape(n, bins)
    filled = table != _EMPTY
    out = table.copy()
    left = np.argwhere(~filled & filled.any(1)[:, None])
    tries = 1
    while len(left):  # an empty bin borrows from the first filled one in an order of its own
        source = (mix(left[:, 1].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(tries)) % U64(bins)).astype(np.int64)
        ok = filled[left[:, 0], source]
        got = left[ok]
        out[got[:, 0], got[:, 1]] = table[got[:, 0], source[ok]]
        left, tries = left[~ok], tries + 1
    return (out & U64((1 << 8 * MINIMUM_BYTES) - 1)).astype(f">u{MINIMUM_BYTES}").view(np.uint8).reshape(n, trees, DEEPEST * MINIMUM_BYTES)


def digest_of(shingle_set: bytes) -> bytes:
    return hashlib.blake2b(shingle_set, digest_size=16).digest()


def digest(docs: DataFrame, width: int = WIDTH, label: bool = True, key: int = 0) -> DataFrame:
    """All columns of ``docs`` but its text, size and digest of the shingle set, and the labels."""
    names = [f"c{i}" for i, c in enumerate(docs.columns) if c != "text"]
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], "text")

    def run(batches):
        for batch in batches:
            for part in portions(batch, len(names)):
                values, at = sets_of(*utf8(part.column(len(names))), width, key)
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
                out = [*part.columns[: len(names)], pa.array(np.diff(at)), pa.array(digests, pa.binary())]
                if label:
                    found = labels(values, at)
                    n, size = found.shape[0] * TREES, found.shape[2]
                    cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found))])
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * TREES), cells))
                yield pa.RecordBatch.from_arrays(out, [*names, "size", "digest", *["labels"] * label])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "text"] + ["size long, digest binary"] + ["labels array<binary>"] * label)
    rows = plain.mapInArrow(run, schema)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, [c for c in docs.columns if c != "text"])], *rows.columns[len(names) :])


def tries(texts: DataFrame) -> DataFrame:
    """``(a, b, tree, level)``: text ``a`` shares the first ``level`` minima of a tree with ``b``, the first text below that node.

    ``texts``: node and labels. Each text has at most one such row a tree, so the groups of a level
    are those that rows of this and deeper levels connect. Rows are range-partitioned in the order
    of the labels; where a partition ends, its last text is compared with the next one's first.
    """
    keys = texts.select(F.posexplode("labels").alias("tree", "label"), "node")
    keys = keys.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    depths = np.arange(SHORTEST, DEEPEST + 1)
    edge = {"first": 1, "last": 2}

    def run(batches):
        from pyspark import TaskContext

        part, before, heads = TaskContext.get().partitionId(), None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, nodes = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, DEEPEST, MINIMUM_BYTES)
            ends = [(nodes[0], int(tree[0]), label[0].tobytes(), edge["first"])] if before is None else []
            same = np.zeros((n, DEEPEST), bool)
            same[1:] = (label[1:] == label[:-1]).all(2) & (tree[1:] == tree[:-1])[:, None]
            if before is not None:
                same[0] = (label[0] == before[1]).all(1) & (tree[0] == before[0])
            common = np.cumprod(same, axis=1, dtype=np.int8).sum(1)
            a, b, level = [], [], []
            for k, depth in enumerate(depths.tolist()):
                head = np.maximum.accumulate(np.where(common < depth, np.arange(n), -1))
                mine = np.flatnonzero(common == depth)
                a += [nodes[i] for i in mine.tolist()]
                b += [nodes[h] if h >= 0 else heads[k] for h in head[mine].tolist()]
                level += [depth] * len(mine)
                if before is None:
                    heads.append(nodes[head[-1]])
                elif head[-1] >= 0:
                    heads[k] = nodes[head[-1]]
            before, last = (int(tree[-1]), label[-1]), nodes[-1]
            none = [None] * len(a)
            trees = tree[[i for k in depths.tolist() for i in np.flatnonzero(common == k).tolist()]].tolist()
            out = [a + [x[0] for x in ends], b + [None] * len(ends), level + [None] * len(ends), none + [part] * len(ends), none + [x[3] for x in ends], trees + [x[1] for x in ends], none + [x[2] for x in ends]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([last, None, None, part, edge["last"], before[0], before[1].tobytes()], types)], names)

    names = ["a", "b", "level", "part", "end", "tree", "label"]
    types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    rows = saved(keys.mapInArrow(run, "a binary, b binary, level int, part int, end int, tree int, label binary"), "tries")
    # two rows a partition
    order = Window.orderBy("part", "end")
    ends = rows.filter("part is not null").select("a", F.lag("a").over(order).alias("b"), "tree", "label", "end", F.lag("tree").over(order).alias("tree_before"), F.lag("label").over(order).alias("label_before"))
    agree = [(F.substring("label", 1, d * MINIMUM_BYTES) == F.substring("label_before", 1, d * MINIMUM_BYTES)).cast("int") for d in range(1, DEEPEST + 1)]
    ends = ends.filter(f"end = {edge['first']} and tree = tree_before").select("a", "b", "tree", sum(agree[1:], agree[0]).alias("level")).filter(F.col("level") >= SHORTEST)
    return rows.filter("part is null").select("a", "b", "tree", "level").unionByName(ends)


def meeting(marks: np.ndarray, sides: list[np.ndarray], level: int, before: int) -> np.ndarray:
    """The pairs of texts that share a node of ``level`` in some tree but none of the deeper level ``before`` (0: none was looked at), and no side; each once.

    ``marks``: the label's first bytes of each text in each tree. A group is what chains of nodes connect, so most of a
    large group of unlike texts never share one.
    """
    m = len(marks)

    def share(depth: int) -> np.ndarray:
        out = np.zeros((m, m), bool)
        for tree in range(marks.shape[1]):
            own = np.ascontiguousarray(marks[:, tree, : depth * MINIMUM_BYTES]).view([("", np.void, depth * MINIMUM_BYTES)]).ravel()
            _, node = np.unique(own, return_inverse=True)
            order = np.argsort(node, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(group) > 1:
                    out[np.ix_(group, group)] = True
        return out

    shares = share(level)
    if before:
        shares &= ~share(before)
    for side in sides:
        shares &= side[:, None] != side[None, :]
    return np.argwhere(np.triu(shares, 1))


def compare(sets: list[np.ndarray], counts: np.ndarray, sides: list[np.ndarray], threshold: float, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted number of links of each set, the least position each is linked with (itself too), and links by bin of similarity.

    Sets of one side of ``sides``, a column for each way of dividing them, are not compared; of the others those of ``pairs``, or all.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if pairs is None:
        apart = np.triu(np.ones((m, m), bool), 1)
        for side in sides:
            apart &= side[:, None] != side[None, :]
        pairs = np.argwhere(apart)
    one, other = pairs[:, 0], pairs[:, 1]
    fits = np.minimum(sizes[one], sizes[other]) >= threshold * np.maximum(sizes[one], sizes[other]) - 1e-4  # sizes alone rule the rest out
    one, other = one[fits], other[fits]
    if len(one) * 16 < m * m:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(one.tolist(), other.tolist())], np.float64)
    else:  # one matrix product is cheaper
        both = _dense(sets)[one, other].astype(np.float64)
    either = sizes[one] + sizes[other] - both
    ok = both >= threshold * either - 1e-4
    one, other, share = one[ok], other[ok], both[ok] / either[ok]
    bins = np.clip(((share - threshold) / (1 - threshold) * BINS).astype(np.int64), 0, BINS)
    links = np.zeros(m, np.int64)
    np.add.at(links, one, counts[other])
    np.add.at(links, other, counts[one])
    root, now = np.arange(m), None
    while now is None or (now != root).any():  # least label among neighbours, then of the label
        now = root
        root = now.copy()
        np.minimum.at(root, one, now[other])
        np.minimum.at(root, other, now[one])
        root = root[root]
    return links, root, np.bincount(bins, minlength=BINS + 1)


def _dense(sets: list[np.ndarray]) -> np.ndarray:
    """The size of each intersection of two sets."""
    m = len(sets)
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # a shingle of one set alone is in no intersection
    rank = np.full(len(values), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    column = rank[inverse]
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), np.float32)
    step = max(1, (1 << 24) // m)
    for low in range(0, len(shared), step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((m, min(step, len(shared) - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    return both


def verify(rows: DataFrame, threshold: float, width: int = WIDTH, block: int = BLOCK, *, level: int = DEEPEST, before: int = 0, hash_key: int = 0) -> DataFrame:
    """``(node, n_links, root, bin)`` for each text of each candidate group, in parts to be added up.

    ``rows``: grp, members, sub, node, copies, text; texts of one ``sub`` have been compared before,
    rows whose text has another digest than ``node`` go. Groups of SMALL texts at most are compared in
    full, of others the pairs that share a node of ``level`` and none of ``before``, the level looked at last. Groups of more than ``block`` texts are
    dealt into blocks, and each pair of blocks is compared by itself. Rows without node count links
    by bin of similarity.
    """
    rows = rows.withColumn("parts", F.ceil(F.col("members") / block).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("large", F.col("members") > SMALL)
    names = ["grp", "sub", "node", "copies", "parts", "mine", "large"]

    def to_sets(batches):
        for batch in batches:
            for part in portions(batch, 7):
                values, at = sets_of(*utf8(part.column(7)), width, hash_key)
                blobs = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                same = pa.array([hashlib.blake2b(x, digest_size=16).digest() == d for x, d in zip(blobs, part.column(2).to_pylist())], pa.bool_())
                large = part.column(6).to_numpy(zero_copy_only=False)
                marks = [x.tobytes() if big else b"" for x, big in zip(labels(values, at)[:, :, : (before or level) * MINIMUM_BYTES], large)] if large.any() else [b""] * len(large)
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())], [*names, "shingles", "labels"]).filter(same)

    schema = "grp binary, sub binary, node binary, copies long, parts int, mine int, large boolean, shingles binary, labels binary"
    rows = rows.select(*names, "text").mapInArrow(to_sets, schema)
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("grp", "sub", "node", "copies", "mine", "shingles", "labels", others)
    rows = rows.select("grp", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "sub", "node", "copies", "shingles", "labels")
    rows = rows.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "node")

    def judged(key, nodes, copies, mine, subs, blobs, marks):
        number = {s: i for i, s in enumerate(dict.fromkeys(subs))}
        sides = [np.array([number[s] for s in subs])] + ([np.array(mine)] if key[1] != key[2] else [])
        pairs = meeting(np.frombuffer(b"".join(marks), np.uint8).reshape(len(nodes), TREES, -1), sides, level, before) if marks[0] else None
        links, root, bins = compare([np.frombuffer(b, U64) for b in blobs], np.array(copies, np.int64), sides, threshold, pairs)
        live = np.flatnonzero(bins).tolist()
        return nodes + [None] * len(live), links.tolist() + bins[live].tolist(), [nodes[r] for r in root.tolist()] + [None] * len(live), [None] * len(nodes) + live

    types = [pa.binary(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches):
        key, held = None, [[] for _ in range(6)]
        out: list[list] = [[] for _ in range(4)]
        for batch in batches:
            grp, low, high, *rest = (c.to_pylist() for c in batch.columns)
            mine, sub, node, copies, blob, mark = rest
            for i in range(len(grp)):
                own = (grp[i], low[i], high[i])
                if key != own:
                    if key is not None:
                        for x, y in zip(out, judged(key, *held)):
                            x.extend(y)
                    key, held = own, [[] for _ in range(6)]
                if not held[0] or held[0][-1] != node[i]:  # rows with equal doc_id and text are one here
                    for x, y in zip(held, (node[i], copies[i], mine[i], sub[i], blob[i], mark[i])):
                        x.append(y)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["node", "n_links", "root", "bin"])
                out = [[] for _ in range(4)]
        if key is not None:
            for x, y in zip(out, judged(key, *held)):
                x.extend(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["node", "n_links", "root", "bin"])

    return rows.mapInArrow(run, "node binary, n_links long, root binary, bin int")


def text_classes(docs: DataFrame, rows: DataFrame, threshold: float, recall: float, width: int, key: int = 0) -> DataFrame:
    """``(node, doc, copies, links, class_id, head)`` of every distinct shingle set of ``rows`` (``docs`` digested).

    ``doc``: its least doc_id; ``head``: whether it stands for its class.
    """
    known = rows.filter("size > 0 and doc_id is not null")
    texts = known.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    texts = saved(texts, "texts")
    edges = saved(tries(texts), "edges")
    deep = {r["level"]: r["count"] for r in edges.groupBy("level").count().collect()}  # a row a level
    few = sum(deep.values()) <= FEW_EDGES * texts.count()
    links: dict[int, int] = {}
    checked, groups, met, before = [], None, None, 0
    waiting = 0  # rows of levels that have not been looked at
    for level in range(DEEPEST, SHORTEST - 1, -1):
        if not waiting and level < DEEPEST and reached(links, level + 1, threshold) >= recall:
            break
        waiting += deep.get(level, 0)
        # the deepest level gives the estimate; then levels that would not be the last go together with the next one
        if not waiting or (checked and level > SHORTEST and reached(links, level, threshold) < recall):
            continue
        waiting = 0
        near = edges.filter(F.col("level") >= level)
        if met is not None:  # the groups of the level before stand for its edges
            near = near.filter(F.col("level") < before).select("a", "b", "tree").unionByName(met.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(0).alias("tree")))
        met = components(near) if few else saved(components_of_some_first(near, F.col("tree") < FIRST_TREES), "groups")
        found = met.select("node", "root", F.col("node").alias("sub")) if groups is None else met.join(groups, "node", "left").select("node", "root", F.coalesce("sub", "node").alias("sub"))
        sizes = found.groupBy("root").agg(F.count("*").alias("members"), F.min("sub").alias("low"), F.max("sub").alias("high"))
        members = spread(found, sizes.filter("low < high").select("root", "members"), ["root"], "node").select("node", F.col("root").alias("grp"), "members", "sub")
        members = members.join(texts.select("node", "doc", "copies"), "node")
        chosen = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members, "doc")
        part = saved(verify(chosen, threshold, width, level=level, before=before, hash_key=key), "links")
        checked.append(part)
        for r in part.filter("node is null").groupBy("bin").agg(F.sum("n_links").alias("n")).collect():  # a row a bin
            links[r["bin"]] = links.get(r["bin"], 0) + r["n"]
        before = level
        # small groups have been compared in full
        groups = spread(found, sizes.select("root", "members"), ["root"], "node").select("node", F.when(F.col("members") <= SMALL, F.col("root")).otherwise(F.col("sub")).alias("sub"))
    if not checked:
        return texts.select("node", "doc", "copies", F.lit(0).cast("long").alias("links"), F.col("doc").alias("class_id"), F.lit(True).alias("head"))
    pairs = checked[0]
    for part in checked[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.filter("node is not null")
    counted = pairs.groupBy("node").agg(F.sum("n_links").alias("links"))
    classes = components(pairs.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = classes.join(texts.select("node", "doc"), "node")
    heads = linked.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first"))
    linked = spread(linked.select("node", "root"), heads, ["root"], "node").select("node", F.col("first.doc").alias("class_id"), (F.col("first.node") == F.col("node")).alias("head"))
    out = texts.select("node", "doc", "copies").join(counted, "node", "left").join(linked, "node", "left")
    return out.select("node", "doc", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("head", F.lit(True)).alias("head"))


def join(docs: DataFrame, threshold: float = SIMILARITY, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """``(doc_id, class_id, n_links, copy_of)`` of every row; ``copy_of`` stands for its equal sets."""
    key = new_key()
    rows = saved(digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, key=key), "signatures")
    texts = text_classes(docs, rows, threshold, recall, width, key)
    rows = rows.select("doc_id", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("node"))
    per_text = texts.select("node", "doc", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(per_text, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("doc", "doc_id").alias("copy_of"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """Of each class the row with the least doc_id, once; all columns. Rows alone in a class stay.

    A row without doc_id or words is in no class and stays. Where rows share a doc_id, each text is
    judged by itself: of several rows with one doc_id and one shingle set, one stays, the first by
    a hash of all columns.
    """
    key = new_key()
    rows = saved(digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, key=key), "signatures")
    texts = saved(text_classes(docs, rows, threshold, recall, width, key), "classes")
    known = rows.filter("size > 0 and doc_id is not null").select("doc_id", F.col("digest").alias("node"))
    stays = known.join(texts.filter("head").select("node", F.col("doc").alias("doc_id")), ["node", "doc_id"]).distinct()
    per_id = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    repeated = saved(per_id.filter("n > 1").select("doc_id"), "repeated")
    single = per_id.filter("n = 1").join(stays.select("doc_id").distinct().withColumn("head", F.lit(True)), "doc_id", "left")
    single = single.filter("head or size = 0").select("doc_id")
    own = F.col("_key")
    names = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any names
    plain = docs.toDF(*names).withColumn("_key", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    text = names[docs.columns.index("text")]
    lone = plain.filter(own.isNull()).unionByName(plain.join(single.withColumnRenamed("doc_id", "_key"), "_key", "left_semi").select(plain.columns))
    several = plain.join(repeated.withColumnRenamed("doc_id", "_key"), "_key", "left_semi")
    several = digest(several.select("_key", F.struct(*names).alias("_row"), F.col(text).alias("text")), width, False, key)
    blank = several.filter("size = 0").select("_row.*", "_key")
    chosen = several.filter("size > 0").join(stays.select(F.col("doc_id").alias("_key"), F.col("node").alias("digest")), ["_key", "digest"], "left_semi")
    chosen = chosen.groupBy("_key", "digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*", "_key")
    out = lone.select(*names).unionByName(blank.select(*names)).unionByName(chosen.select(*names))
    return out.toDF(*docs.columns)
