"""Stored interval indexes against brute force."""

import random

import pytest
from tidelocus.operators import intervals, stored


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Intervals of all lengths, repeats, empty ones, nulls, and a place with a third of them."""
    rng = random.Random(3)
    rows = [("c1", s, s + rng.choice([0, 5, 900, 20_000, 3_000_000]), i) for i, s in enumerate(rng.choices(range(1, 100_000), k=300))]
    rows += [("c2", 7, 9, i) for i in range(150)] + [("c1", 9, 3, -1), (None, 1, 2, -2), ("c1", None, 2, -3), ("c1", 1, None, -4)]
    path = str(tmp_path_factory.mktemp("index") / "it's an index")
    stored.store_index(spark.createDataFrame(rows, "chrom string, r_first long, r_last long, `a name` int"), path, buckets=7)
    return path, [r for r in rows if r[3] >= 0]


def test_overlap_and_stab(spark, index):
    path, rows = index
    own = stored.open_index(spark, path)
    assert (own.intervals, own.longest) == (450, max(r[2] - r[1] + 1 for r in rows))
    rng = random.Random(4)
    asks = [("c1", s, s + rng.choice([0, 100, 50_000]), i) for i, s in enumerate(rng.choices(range(120_000), k=60))] + [("c2", 8, 8, 100), ("c3", 1, 9, 101), (None, 1, 9, 102), ("c1", None, 4, 103), ("c1", 9, 4, 104)]
    left = spark.createDataFrame(asks, "chrom string, first long, last long, k int")
    want = sorted((k, r[3]) for c, a, b, k in asks for r in rows if k < 102 and c == r[0] and a <= r[2] and b >= r[1])
    assert sorted((r["k"], r["a name"]) for r in stored.indexed_overlap(left, own).collect()) == want
    want = sorted((k, r[3]) for c, a, _, k in asks for r in rows if k not in (102, 103) and c == r[0] and r[1] <= a <= r[2])
    points = left.select("chrom", left["first"].alias("pos"), "k")
    assert sorted((r["k"], r["a name"]) for r in stored.indexed_stab(points, own).collect()) == want
    depth = {(r["chrom"], r["pos"]): r["n"] for r in stored.indexed_depth(points, own).collect()}
    assert depth["c2", 8] == 150
    own.close()
    assert not spark.catalog.tableExists(own.table)
    # a closed index can be opened again
    again = stored.open_index(spark, path)
    assert again.rows.count() > 450
    again.close()


def test_one_exchange(spark, index):
    """The index is read by its buckets: only what asks is shuffled; without one both sides are."""
    path, _ = index
    own = stored.open_index(spark, path)
    left = spark.range(1000).selectExpr("concat('c', id % 3) as chrom", "id as first", "id + 3 as last")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        found = plan(stored.indexed_overlap(left, own))
        assert found.count("Exchange hashpartitioning") == 1
        plain = intervals.overlap_join(left, own.rows.drop("__level", "__bin"), longest=5)
        assert plan(plain).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        own.close()


def test_empty(spark, tmp_path):
    path = str(tmp_path / "empty")
    stored.store_index(spark.createDataFrame([], "chrom string, r_first long, r_last long"), path, buckets=2)
    own = stored.open_index(spark, path)
    left = spark.createDataFrame([("c1", 1, 2)], "chrom string, first long, last long")
    assert (own.intervals, own.longest, own.used) == (0, 0, 0)
    assert stored.indexed_overlap(left, own).collect() == []
    own.close()
