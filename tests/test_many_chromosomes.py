"""Streams over very many chromosomes: their states are shared, so that they don't cost a call each."""

import json

import pandas as pd
import pytest

from tidelocus.streaming import streams


class State:
    """What a group's function sees of its state."""

    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _frame(rows):
    return pd.DataFrame(rows, columns=["chrom", "pos", "l", "r", "m", "low", "high"])


def test_one_call_for_many_chromosomes():
    run, state = streams._evicting(2), State()
    first = _frame([(f"c{k}", 5 + k, 1, 1, 0, 5 + k, 5 + k) for k in range(300)])
    assert sum(len(x) for x in run((0,), iter([first]), state)) == 0  # the furthest starts are the positions
    names, reached = json.loads(state.get[0])
    assert len(names) == 300 and reached == [5 + k for k in range(300)]
    second = _frame([(f"c{k}", None, 0, 0, 0, 9000, 9000) for k in range(299, -1, -2)])
    third = _frame([("c1", 9000, 0, 2, 1, 9000, 9001)])
    out = pd.concat(run((0,), iter([second, third]), state))
    want = sorted([(f"c{k}", 5 + k, 1, 1, 0) for k in range(1, 300, 2)] + [("c1", 9000, 0, 2, 1)])
    assert sorted(out.itertuples(index=False, name=None)) == want
    with pytest.raises(ValueError, match="start 8 on chromosome c3"):
        list(run((0,), iter([_frame([("c0", 6, 1, 0, 0, 6, 6), ("c3", 8, 1, 0, 0, 8, 8)])]), state))
