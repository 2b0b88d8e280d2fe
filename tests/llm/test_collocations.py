"""Phrases against counting all of them in plain Python."""

import random
import re
from collections import Counter

import pytest

from tidelocus.llm import collocations, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=30, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    good = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {}
    for p, a in good.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                inside[q] = max(inside.get(q, 0), a)
    out = []
    for lang in n:
        own = []
        for p, a in good.items():
            if p[0] == lang and 100 * inside.get(p, -1) < 80 * a:
                score, k = min((2_000_000 * a // (f[p[: k + 1]] + f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
                own.append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(own)[:first], 1)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["the", "of", "The", "é", "x\x01", "x", "x-y", "a" * 300, "\x00", "zß", *("".join(rng.choices("abc", k=3)) for _ in range(20))]
    prose = lambda n: "".join(rng.choices(words, [1 / (1 + k) for k in range(len(words))])[0] + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x0b "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "", "und"]), prose(rng.randint(1, 400))) for _ in range(150)]
    rows += [("en", "one copied text, that many have and hold")] * 31 + [("fr", "one copied text")] * 29 + [("en", None), (None, None), ("de", "")]
    return rows


@pytest.mark.parametrize(("shard", "hashes", "bits", "parts"), [(4_000_000, 2_000_000, 27, 1), (500, 300, 10, 7)])
def test_collocations(spark, monkeypatch, shard, hashes, bits, parts):
    """Also with many shards, a full filter, and ranges that cut prefixes."""
    for name, value in {"SHARD": shard, "HASHES": hashes, "FILTER_BITS": bits}.items():
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr("tidelocus.llm.textbytes.SLICE_BYTES", 3000 if parts > 1 else 1 << 20)
    rows = rows_of(2)
    docs = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows) and len(got) > 90
    few = sorted(tuple(r) for r in collocations.collocations(docs, first=5).collect())
    assert few == brute(rows, first=5)


def test_odd_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("a", "b c d")], "lang string, text string")).collect() == []


def test_query(spark):
    where = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in queries.op11_collocations(spark, where).collect()) == brute(rows)
