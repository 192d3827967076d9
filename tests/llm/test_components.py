"""Connected components against union-find."""

import random

from tidemark.llm import lsh_forest
from tidemark.llm.components import components


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    edges += [(7, 7), (9, 8), (8, 9), (9, 8), (None, 3), (4, None)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chains_in_any_order_settle(spark):
    rng = random.Random(2)
    n = 3000
    mixed = rng.sample(range(20_000, 20_000 + n), n)
    edges = [(i + 1, i) for i in range(n - 1)]
    edges += [(10_000 + (i + 1) % n, 10_000 + (i + 2) % n) for i in range(n - 1)]  # the least id at the far end
    edges += [(mixed[i], mixed[i + k]) for k in (1, 2, 3) for i in range(n - k)]
    lone = rng.sample(range(30_000, 30_000 + n), n)
    edges += list(zip(lone, lone[1:]))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: x // 10_000 * 10_000 for k in range(4) for x in range(k * 10_000, k * 10_000 + n)}


def test_a_round_is_one_write_that_counts_its_own_changes(spark, monkeypatch):
    """No job of its own asks whether a round has changed anything."""
    edges = spark.createDataFrame([(1, i) for i in range(2, 30)], "a long, b long")
    asked = []
    plain = type(edges).isEmpty
    monkeypatch.setattr(type(edges), "isEmpty", lambda self: asked.append(1) or plain(self))
    got = components(edges)
    assert not asked and got.columns == ["node", "root"]
    assert {tuple(r) for r in got.collect()} == {(i, 1) for i in range(1, 30)}


def test_few_edges_are_settled_at_once_with_the_same_classes(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(25)]
    texts = [" ".join(t) for t in base] + [" ".join(t[:k] + ["x"] + t[k + 1 :]) for t in base for k in (0, 59)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls = []
    plain = lsh_forest.components_of_some_first
    monkeypatch.setattr(lsh_forest, "components_of_some_first", lambda *a: calls.append(1) or plain(*a))
    out = []
    for few in (0, 100):
        monkeypatch.setattr(lsh_forest, "FEW_EDGES", few)
        calls.clear()
        out.append(sorted(tuple(r) for r in lsh_forest.join(docs).select("doc_id", "class_id", "n_links").collect()))
        assert bool(calls) == (few == 0)
    assert out[0] == out[1] and len({c for _, c, _ in out[0]}) == 25


def joined(spark, since):
    """Rows out of inner joins of all executions beyond ``since``, and the last execution's number."""
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for k in [runs.apply(i).executionId() for i in range(runs.size())]:
        last = max(last, k)
        if k > since:
            values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if "Join" in node.name() and "Inner" in node.desc():
                    ids = [m.accumulatorId() for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
                    rows += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return rows, last


def test_a_group_tied_many_times_costs_its_edges_once_not_once_a_round(spark):
    rng = random.Random(5)
    for n in (400, 1600):
        nodes = rng.sample(range(10**6), n)
        edges = {(hub, x) for hub in rng.sample(nodes, 16) for x in rng.sample(nodes, n // 2)} | set(zip(nodes, nodes[1:]))
        table = spark.createDataFrame(list(edges), "a long, b long")
        _, since = joined(spark, -1)
        got = components(table)
        rows, _ = joined(spark, since)
        assert {tuple(r) for r in got.collect()} == {(x, min(nodes)) for x in nodes}
        assert 0 < rows < 3 * len(edges)
