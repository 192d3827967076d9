"""Top-k over cells against a scan, and how much of the rows it reads."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import vector
from tidemark.operators.cells import CellIndex

DAY = datetime.date(2024, 1, 1)
SCHEMA = "vec_id long, patient_id long, session_date date, embedding array<double>"
ASKED = "query_id long, patient_id long, date_from date, date_to date, query array<double>"


def clustered(n, seed=3, size=8, groups=12):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    return [(i, int(i % 3 == 0), DAY + datetime.timedelta(days=r.randrange(400)), [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "score", "rank").collect())


def test_equals_a_scan_and_reads_few_cells(spark):
    data = clustered(3000)
    v = spark.createDataFrame(data, SCHEMA)
    asked = [(i, p, None if i % 2 else d - datetime.timedelta(days=30), None if i % 3 else d + datetime.timedelta(days=200), x) for i, p, d, x in data[::100]]
    q = spark.createDataFrame(asked, ASKED)
    index = CellIndex.build(v, ["patient_id"], k=24)
    found = index.top_k(q)
    assert rows_of(found.hits) == rows_of(vector.top_k_batch(v, q))
    assert index.cells.agg(F.sum("n")).first()[0] == 3000
    read = found.visits.agg(F.sum("n")).first()[0]
    scan = v.join(q, "patient_id").count()
    assert read < scan / 4, (read, scan)


def test_vectors_without_structure_are_read_whole(spark):
    r = random.Random(9)
    data = [(i, 1, DAY + datetime.timedelta(days=i % 90), [r.gauss(0, 1) for _ in range(24)]) for i in range(400)]
    v = spark.createDataFrame(data, SCHEMA)
    q = spark.createDataFrame([(i, 1, None, None, x) for i, _, _, x in data[::40]], ASKED)
    assert rows_of(CellIndex.build(v, ["patient_id"], k=6).top_k(q, 7).hits) == rows_of(vector.top_k_batch(v, q, 7))


def test_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    odd = [
        (1, 1, DAY, one), (1, 1, DAY, one), (2, 1, DAY, [2.0, 0.0, 0.0]), (3, 1, DAY, [0.0, 0.0, 0.0]), (4, 1, DAY, None), (5, 1, DAY, [1.0, None, 0.0]), (6, 1, DAY, []),
        (7, 1, DAY, [1.0, 1.0]), (8, 1, None, [0.0, 1.0, 0.0]), (9, None, DAY, one), (10, 1, DAY, [float("nan"), 0.0, 0.0]), (11, 1, DAY, [float("inf"), 0.0, 0.0]), (12, 1, DAY, [-1.0, 0.0, 0.0]),
    ]
    v = spark.createDataFrame(odd, SCHEMA)
    asked = [(1, 1, None, None, one), (2, 1, DAY, DAY, one), (3, 1, DAY, None, [0.0, 0.0, 0.0]), (4, 1, None, DAY, None), (5, None, None, None, one), (6, 2, None, None, one), (7, 1, DAY, None, [1.0, 1.0])]
    got = CellIndex.build(v, ["patient_id"], k=4).top_k(spark.createDataFrame(asked, ASKED), 20).hits.collect()
    of = lambda i: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i]
    scored = [(1, 1.0), (1, 1.0), (2, 1.0)]
    assert of(1) == [*scored, (8, 0.0), (12, -1.0), (3, None), (4, None), (5, None), (6, None), (7, None), (10, None), (11, None)]
    assert of(2) == [*scored, (12, -1.0), (3, None), (4, None), (5, None), (6, None), (7, None), (10, None), (11, None)]
    assert len(of(3)) == 12 - 1 and {s for _, s in of(3)} == {None} and [i for i, _ in of(3)] == sorted(i for i, _ in of(3))
    assert {s for _, s in of(4)} == {None} and of(5) == of(6) == []
    assert of(7)[0] == (7, 1.0) and {s for _, s in of(7)[1:]} == {None}
    few = [[(r["vec_id"], r["score"]) for r in CellIndex.build(rows, ["patient_id"], k=4).top_k(spark.createDataFrame(asked, ASKED), 2).hits.orderBy("query_id", "rank").collect()] for rows in (v, v.limit(0))]
    assert few[0][:2] == [(1, 1.0), (1, 1.0)] and few[1] == []
