"""Deep bins are split by what a task can hold, not by what makes a bin deep."""

import random

from tidelocus.operators import intervals

LEFT, RIGHT = "chrom string, first long, last long, i int", "chrom string, r_first long, r_last long, j int"


def _rows(n, seed):
    rng = random.Random(seed)
    return [("c", a, a + rng.choice((0, 3, 40)), i) for i, a in enumerate(rng.choices(range(1, 60), k=n))]


def test_a_deep_bin_is_one_sweep(spark, monkeypatch):
    """With parts of ``deep`` rows each row was copied, and a task's function called, once for each part of the other side."""
    make = intervals._sweep

    def whole(*args):
        sweep = make(*args)

        def run(l, r):
            if l.num_rows < 300 or r.num_rows < 200:
                raise ValueError("a part of a bin")
            return sweep(l, r)

        return run

    monkeypatch.setattr(intervals, "_sweep", whole)
    left, right = _rows(300, 1), _rows(200, 2)
    got = intervals.deep_overlap_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), width=1024, deep=8)
    want = sorted((i, j) for _, a, b, i in left for _, x, y, j in right if x <= b and y >= a)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_parts(spark):
    """Bins of several parts give the same pairs."""
    left, right = _rows(150, 3), _rows(90, 4)
    got = intervals.deep_overlap_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), width=64, deep=5, pieces=25, part=20)
    want = sorted((i, j) for _, a, b, i in left for _, x, y, j in right if x <= b and y >= a)
    assert sorted((r.i, r.j) for r in got.collect()) == want
