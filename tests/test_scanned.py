"""The ordered scan counts a batch at once: many chromosomes don't make as many batches."""

import numpy as np
import pyarrow as pa

from tidelocus.operators import reads


def test_many_chromosomes_leave_together():
    rows = [(f"c{k}", s, s + 3 * (s % 2), s % 3 == 0, s % 3 != 0, k % 2 == 0) for k in range(500) for s in (4, 4, 7, 8)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=list("abcdef")) for part in (rows[:1001], rows[1001:])]
    out = list(reads._scanned(iter(batches), {"c7": np.array([5, 11])}))
    assert len(out) <= 4
    got = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    want = {}
    for c, _, p, l, r, m in rows:
        n = want.setdefault((c, p), [0, 0, 0])
        n[0], n[1], n[2] = n[0] + l, n[1] + r, n[2] + m
    # a position may leave once only
    assert got == sorted((c, p, *n, c == "c7" and 5 <= p < 11) for (c, p), n in want.items())
