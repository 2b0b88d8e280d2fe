"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidelocus.llm import queries, variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_part = {}
    for w in counts:
        for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_part.setdefault(part, []).append(w)
    links = {w: set() for w in counts}
    for group in by_part.values():
        for a in group:
            links[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(links[w]), counts.get(form[w])))
    return out


def rows_of(seed, letters="abé"):
    """Words of few letters, so that many are near, and chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(500)] + ["abcdefghij" * 30, "abcdefghij" * 30 + "k"]
    texts = [" ".join(rng.choices(words, [1 / (1 + k) for k in range(len(words))], k=300)) for _ in range(60)]
    texts += ["abcdefghij" * 30 + " " + "abcdefghij" * 30 + "k"] * 5 + ["chained " * 700, "chainel " * 130, "chainll " * 25, "chaxnll " * 5]
    return [*enumerate(texts), (None, "plainly " * 40 + "plainli " * 6), (7, None), (8, ""), (8, "ÀÖ×÷ÿ Straße 12x34 AéßĀbcdefgh " * 6), (9, "plainly")]


@pytest.mark.parametrize(("hot", "rows", "merged", "compared"), [(20_000, 30_000, 2_000_000, 8_000_000), (7, 50, 100, 100)])
def test_variants(spark, monkeypatch, hot, rows, merged, compared):
    """Also with groups in many blocks and everything in small pieces."""
    for name, value in {"HOT": hot, "ROWS": rows, "MERGED": merged, "COMPARED": compared}.items():
        monkeypatch.setattr(variants, name, value)
    table = rows_of(5)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in table], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(table)
    assert {tuple(r) for r in variants.group_variants(docs).collect()} == want
    assert any(f and r != f for _, f, r, *_ in want) and len(want) > 200
    assert ("chaxnll", "chainll", "chained", 5, 1, 25) in want


def test_full_tables(spark, monkeypatch):
    """A task whose table of words is full hands its counts on."""
    monkeypatch.setattr(variants.bpe, "MAX_WORDS", 20)
    table = rows_of(6)
    monkeypatch.setattr("tidelocus.llm.textbytes.SLICE_BYTES", 2000)
    got = list(variants._count(iter(pa_batches(table)), 199))
    counts = Counter()
    for batch in got:
        counts.update(dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)) if len(set(batch.column("word").to_pylist())) == batch.num_rows else {})
    assert {w: n for w, n in counts.items() if n >= 5} == {w: n for w, _, _, n, _, _ in brute(table)} and len(got) > 2


def pa_batches(table):
    import pyarrow as pa

    for k in range(0, len(table), 10):
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in table[k : k + 10]], pa.int64()), pa.array([t for _, t in table[k : k + 10]], pa.string())], names=["doc_id", "text"])


def test_odd_tables(spark):
    assert variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.group_variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).collect() == []


def test_query(spark):
    where = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op12_spelling(spark, where).collect()} == brute(rows)
