"""Operators against golden values and brute force.

Golden inputs and expected results are fixed values: results have to equal them.
"""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelocus import schemas
from tidelocus.functions import kmers, permutation
from tidelocus.operators import clusters, coverage, evidence, factors, intervals, peaks, ranks, reads, repeats, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def some_intervals(n, top, longest, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(1, top)
        out.append((rng.choice(["c1", "c2"]), a, a + rng.randint(0, longest)))
    return out


def test_contains(spark):
    regions = spark.createDataFrame([("chr1", 100, 110)], "chrom string, first long, last long")
    points = spark.createDataFrame([("chr1", x) for x in (99, 100, 101, 110, 111)] + [("chr2", 100), (None, 100), ("chr1", None)], "chrom string, pos long")
    found = {(r.chrom, r.pos): r.inside for r in intervals.contained(points, regions).collect()}
    assert [found["chr1", x] for x in (99, 100, 101, 110, 111)] == [False, True, True, True, False]
    assert not found["chr2", 100] and not found[None, 100] and not found["chr1", None]


def test_merge(spark):
    given = [("chr1", 100, 110), ("chr1", 120, 130), ("chr1", 125, 128), ("chr1", 140, 150), ("chr2", 120, 130), ("chr2", 130, 135), ("chr2", 136, 140)]
    df = spark.createDataFrame(given, "chrom string, first long, last long")
    for chunk in (7, 1 << 20):
        assert rows(intervals.merge(df, chunk=chunk)) == [("chr1", 100, 110), ("chr1", 120, 130), ("chr1", 140, 150), ("chr2", 120, 135), ("chr2", 136, 140)]
    assert intervals.merge(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [4, 64])
def test_overlap_and_stab_equal_brute_force(spark, width):
    a, b = some_intervals(150, 400, 60, 1), some_intervals(150, 400, 300, 2)
    left, right = spark.createDataFrame(a, "chrom string, first long, last long"), spark.createDataFrame(b, "chrom string, r_first long, r_last long")
    want = sorted((c, x, y, p, q) for c, x, y in a for d, p, q in b if c == d and x <= q and y >= p)
    assert rows(intervals.overlap_join(left, right, width=width).select("chrom", "first", "last", "r_first", "r_last")) == want
    points = spark.createDataFrame([("c1", x) for x in range(0, 500, 3)], "chrom string, pos long")
    found = rows(intervals.stab(points, right.toDF("chrom", "first", "last"), width=width).select("pos", "first", "last"))
    assert found == sorted((x, p, q) for x in range(0, 500, 3) for d, p, q in b if d == "c1" and p <= x <= q)
    assert intervals.stabbed(points, right.toDF("chrom", "first", "last"), width=width).count() == len({x for x, _, _ in found})


def test_overlap_ends_off_any_boundary(spark):
    left = spark.createDataFrame([("c", 3, 7)], "chrom string, first long, last long")
    right = spark.createDataFrame([("c", 1, 2), ("c", 5, 6)], "chrom string, r_first long, r_last long")
    assert rows(intervals.overlap_join(left, right).select("r_first", "r_last")) == [(5, 6)]


def test_longest_and_enclosing(spark):
    df = spark.createDataFrame([("c", 1, 3), ("c", 2, 5), ("c", 2, 7)], "chrom string, first long, last long")
    assert rows(intervals.longest_by_start(df)) == [("c", 1, 3, []), ("c", 2, 7, [5])]
    parents = {(r.first, r.last): (r.parent_first, r.parent_last) for r in intervals.enclosing(df).collect()}
    assert parents == {(1, 3): (None, None), (2, 5): (2, 7), (2, 7): (None, None)}


def test_tiles_cover_the_last_base(spark):
    chroms = spark.createDataFrame([(0, "a", 11), (1, "b", 0)], "chrom_id int, chrom string, length long")
    assert rows(intervals.tile(chroms, 5)) == [("a", 1, 5), ("a", 6, 10), ("a", 11, 11)]


def test_rank_and_select(spark):
    xs = [2, 3, 7, 9, 11]
    members = spark.createDataFrame([("k", x) for x in xs + xs], "k string, x long")
    probes = spark.createDataFrame([("k", x) for x in range(14)], "k string, x long")
    for chunk in (4, 1000):
        assert [r.rank for r in ranks.rank(members, probes, "k", "x", chunk).orderBy("x").collect()] == [0, 0, 0, 1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 5]
    wanted = spark.createDataFrame([("k", i) for i in range(7)], "k string, i long")
    assert [r.x for r in ranks.select(members, wanted, "k", "x").orderBy("i").collect()] == xs
    assert rows(ranks.sizes(members, "k", "x")) == [("k", 5, 12)]
    odd = [0, 7, 15, 31, 49, 63, 64, 81, 127, 128, 173, 254, 255, 256, 257]
    numbered = rows(ranks.numbered(spark.createDataFrame([("k", x) for x in odd], "k string, x long"), "k", "x"))
    assert [i for _, _, i in numbered] == list(range(15))


def test_kmers(spark):
    df = spark.createDataFrame([("TCTG",), ("GATCGGT",), ("WIBBLE",), ("",), (None,)], "s string")
    assert [r.k for r in df.select(kmers.pack(F.col("s")).alias("k")).collect()] == [0xDE, 0x236B, None, 0, None]
    one = spark.createDataFrame([("ACTGTAGTCCTAGCTACT" * 3 + "nACG-tt",)], "s string")
    got = one.select(kmers.windows(F.col("s"), 11).alias("w"), kmers.reverse_complement(F.lit("ACTGTAGTCCT")).alias("rc")).first()
    assert [w.at for w in got.w] == list(range(44)) and got.rc == "AGGACTACAGT"
    shown = one.select(F.explode(kmers.windows(F.col("s"), 11)).alias("w")).select(kmers.render(F.col("w.kmer"), 11).alias("t")).collect()
    assert shown[0].t == "ACTGTAGTCCT" and shown[7].t == "TCCTAGCTACT"
    vector = one.limit(1).select(F.lit(1).alias("id"), F.lit("AAC").alias("s"))
    assert kmers.frequency_vectors(vector, "id", "s", 1).first().vector == [2, 1, 1, 2]
    assert one.select(kmers.hamming(F.lit(0b1100), F.lit(0b0110)).alias("d")).first().d == 2


def test_permutation(spark):
    for n, seed in ((25, 19), (2500, 19), (1, 3)):
        assert sorted(r.value for r in permutation.permutation(spark, n, seed).collect()) == list(range(n))
    keys = permutation.keys(5)
    back = spark.range(50).select("id", permutation.decode(permutation.encode(F.col("id") + 1000, 32, keys), 32, keys).alias("x"))
    assert all(r.x == r.id + 1000 for r in back.collect())


def _read(qname, flag, chrom, pos, mapq, cigar, mate=("c1", 500), seq="ACGTACGTACGT"):
    return qname, flag, 0, chrom, pos, pos + 9, mapq, [{"op": o, "len": n} for o, n in cigar], 0, mate[0], mate[1], 100, seq, "F" * len(seq)


def test_clips(spark):
    from tidelocus import schemas

    data = [
        _read("a", 0x40, "c1", 100, 13, [("S", 3), ("M", 9)]), _read("b", 0, "c1", 100, None, [("H", 2), ("S", 3), ("M", 9)]), _read("c", 0, "c1", 91, 60, [("M", 12), ("S", 4)]),
        _read("d", 0x400, "c1", 100, 60, [("S", 3), ("M", 9)]), _read("e", 0x100, "c1", 100, 60, [("S", 3), ("M", 9)]), _read("f", 0x4, "c1", 100, 60, [("S", 3), ("M", 9)]),
        _read("g", 0, "c1", 100, 12, [("S", 3), ("M", 9)]), _read("h", 0x800, "c1", 100, 30, [("S", 3), ("M", 2), ("S", 4)], (None, None)), _read("i", 0, "c1", 200, 30, [("S", 2), ("M", 4)], seq="ACGTAC"),
    ]
    df = spark.createDataFrame(data, schemas.ALIGNMENTS)
    regions = spark.createDataFrame([("c1", 400, 600)], schemas.REGIONS)
    events = reads.clip_events(df, regions)
    assert rows(reads.pileup(events)) == [("c1", 103, 3, 1, 3)]
    names = {r.id for r in reads.clip_reads(events).collect()}
    assert "a~c1~100~c1~500~L~1" in names and not any(n.startswith("i~") for n in names) and any(n.startswith("h~c1~100~*~0~L") for n in names)
    assert df.where(reads.in_region_scan()).count() == 7


def test_peaks_against_brute_force(spark):
    rng = random.Random(4)
    data, pos = [], 0
    for _ in range(200):
        pos += rng.choice([1, 50, 100, 101, 400])
        data.append(("c1", pos, rng.randint(0, 3), rng.randint(0, 3), 0))
    from tidelocus import schemas

    islands, last = [], None
    for r in data:
        if last is None or r[1] - last > 100:
            islands.append([])
        islands[-1].append(r)
        last = r[1]

    def sd(pairs):
        n = sum(w for _, w in pairs)
        if not n:
            return -1.0
        m = sum(x * w for x, w in pairs) / n
        return math.sqrt(sum(w * (x - m) ** 2 for x, w in pairs) / n)

    want = []
    for g in islands:
        top = max(x[2] + x[3] for x in g)
        at = next((x[1] for x in g if x[2] + x[3] == top), 0) if top else 0
        sds = (0.0, 0.0, 0.0) if len(g) == 1 else (sd([(x[1], x[2]) for x in g]), sd([(x[1], x[3]) for x in g]), sd([(x[1], x[2] + x[3]) for x in g]))
        want.append((at, top, *(round(s, 6) for s in sds)))
    for chunk in (300, 1 << 20):
        got = [(r.pos, r.max_both, round(r.left_sd, 6), round(r.right_sd, 6), round(r.both_sd, 6)) for r in peaks.call_peaks(spark.createDataFrame(data, schemas.CLIPS), chunk=chunk).collect()]
        assert sorted(got) == sorted(want)


def test_flanks_stay_on_the_chromosome(spark):
    df = spark.createDataFrame([("c", 10, 1.0), ("c", 500, float("nan")), ("c", 900, None), ("c", 950, -1.0)], "chrom string, pos long, both_sd double")
    got = rows(evidence.flanks(df).select("locus", "side", "w_first", "w_last"))
    assert ("c:10", "L", 1, 10) in got and ("c:10", "R", 11, 163) in got and ("c:500", "L", 350, 500) in got and ("c:950", "R", 951, 1100) in got


def test_stats(spark):
    df = spark.createDataFrame([("a", float(x), i) for i, x in enumerate([5, 1, 4, 2, 3, 9, 9, 9, 9, 9, 7])] + [("b", 2.0, 0)], "k string, x double, index long")
    assert rows(stats.remedian(df, ["k"], "x")) == [("a", 9.0), ("b", 2.0)]
    got = {r.k: (r.m, r.s) for r in stats.moments(df, ["k"], "x").select("k", stats.mean().alias("m"), stats.deviation().alias("s")).collect()}
    assert got["b"] == (2.0, 0.0)
    empty = df.limit(0).groupBy().agg(F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("sx"), F.lit(0.0).alias("sx2"))
    assert empty.select(stats.deviation().alias("s")).first().s == -1.0
    assert rows(factors.levels(df, "k", "index")) == [("a", 0), ("b", 1)]
    assert rows(factors.from_pairs(spark, [("x", 2), ("y", 0)])) == [("", 1), ("x", 2), ("y", 0)]


def test_repeats(spark):
    from tidelocus import schemas

    genome = spark.createDataFrame([("c2", "ACGTACGTAAGG", 1), ("c1", "TTACGTACGTcc", 0)], "name string, seq string, order long")
    reps = spark.createDataFrame([(0, "c1", 3, 6, "+", "Alu1", "SINE"), (1, "c2", 1, 4, "-", "Alu2", "SINE"), (2, "c2", 9, 12, "+", "L1", "LINE"), (3, "c9", 1, 2, "+", "Alu1", "SINE")], schemas.REPEATS)
    assert rows(repeats.prepare_repeats(reps, genome, 2, size=5)) == [("c1:3-6~2~SINE~Alu1", "TTACGTAC"), ("c2:9-12~2~LINE~L1", "GTAAGG")]
    assert repeats.prepare_repeats(reps, genome, 0, "LINE", size=5).count() == 1


def test_coverage_and_clusters(spark):
    chroms = spark.createDataFrame([(0, "a", 3000), (1, "b", 2000)], "chrom_id int, chrom string, length long")
    loci = coverage.sample_loci(chroms, 100, 500, 3)
    assert loci.count() == 100 and loci.where("first < 1 or last > 3000 or last - first <> 500").count() == 0
    assert rows(loci) == rows(coverage.sample_loci(chroms, 100, 500, 3))
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [1.0, 0.0])], "id int, v array<double>")
    assert [r.cluster for r in clusters.assign(v, [[0.0, 0.0], [5.0, 5.0]], "v").orderBy("id").collect()] == [0, 1, 0]
    out = coverage.summarise_coverage(spark.createDataFrame([], "chrom string, first long, last long, n long, cov long, n_ins long, sum_ins long, sum2_ins long, read_length long"), "x").first()
    assert out.cov is None and out.insert_size_sd == -1.0


def test_range_join_levels(spark):
    """Ranges from one position to a whole chromosome, against all pairs; a bound on the length gives the same."""
    rng = random.Random(3)
    left = [("c", a, a + rng.choice((0, 5, 3000))) for a in rng.sample(range(1, 200_000), 60)]
    right = [("c", a, a + rng.choice((0, 10, 900, 40_000, 3_000_000))) for a in rng.sample(range(1, 200_000), 60)]
    l, r = spark.createDataFrame(left, "chrom string, first long, last long"), spark.createDataFrame(right, "chrom string, r_first long, r_last long")
    want = sorted((*x, *y[1:]) for x in left for y in right if x[1] <= y[2] and x[2] >= y[1])
    for longest in (None, 4_000_000):
        got = intervals.overlap_join(l, r, width=16, longest=longest).select("chrom", "first", "last", "r_first", "r_last").collect()
        assert sorted(tuple(x) for x in got) == want
    assert intervals.overlap_join(l.limit(0), r).count() == 0 and intervals.overlap_join(l, r.limit(0)).count() == 0


def test_enclosing_nested(spark):
    rng = random.Random(4)
    rows = sorted({("c", a, a + rng.choice((0, 3, 50, 400, 5000))) for a in rng.choices(range(1, 3000), k=150)})
    df = spark.createDataFrame(rows, "chrom string, first long, last long")
    got = {(r.first, r.last): (r.parent_first, r.parent_last) for r in intervals.enclosing(df, width=16).collect()}
    for _, a, b in rows:
        outer = [(x, -y) for _, x, y in rows if x <= a and y >= b and (x, y) != (a, b)]
        assert got[a, b] == ((max(outer)[0], -max(outer)[1]) if outer else (None, None))


def test_unknown_chromosomes_fail(spark):
    peaks_ = spark.createDataFrame([("c9", 5, 1, 0.0, 0.0, 0.0)], schemas.PEAKS)
    chroms = spark.createDataFrame([(0, "c1", 100)], schemas.CHROMOSOMES)
    with pytest.raises(Exception, match="unknown chromosome: c9"):
        evidence.on_known(peaks_, chroms).collect()


def test_long_kmers(spark):
    seq = "TGCA" * 8
    row = spark.sql(f"select '{seq}' s").select(kmers.pack(F.col("s")).alias("k"), kmers.render(kmers.pack(F.col("s")), 32).alias("t"), kmers.pack(F.lit("A" * 33)).alias("none")).first()
    value = sum("ACGT".index(c) << 2 * (31 - i) for i, c in enumerate(seq))
    assert row.k % (1 << 64) == value and row.t == seq and row.none is None


def test_previous_at_least():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 64, 333):
        values, groups = rng.integers(0, 40, n), np.sort(rng.integers(0, 6, n))
        asked = np.flatnonzero(rng.random(n) < 0.7)
        least = rng.integers(0, 45, len(asked))
        want = [max((j for j in range(i) if groups[j] == groups[i] and values[j] >= x), default=-1) for i, x in zip(asked.tolist(), least.tolist(), strict=True)]
        assert intervals.previous_at_least(values, groups, asked, least).tolist() == want


def test_enclosing_long_and_in_small_batches(spark):
    """An interval over everything, nested chains and several chromosomes, a few rows a batch."""
    rng = random.Random(14)
    rows = {(c, a, a + rng.choice((0, 7, 90, 2000, 60_000))) for c in "ab" for a in rng.choices(range(1, 4000), k=120)} | {("a", 1, 2_000_000_000)} | {("b", 50 + i, 5000 - i) for i in range(60)}
    df = spark.createDataFrame(sorted(rows) * 2, "chrom string, first long, last long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.chrom, r.first, r.last): (r.parent_first, r.parent_last) for r in intervals.enclosing(df, width=8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for c, a, b in rows:
        outer = [(x, -y) for d, x, y in rows if d == c and x <= a and y >= b and (x, y) != (a, b)]
        assert got[c, a, b] == ((max(outer)[0], -max(outer)[1]) if outer else (None, None))


def test_deep_overlap(spark):
    """A bin with most of the rows is split on both sides; pairs are those of all with all."""
    rng = random.Random(15)
    left = [("c", a, a + rng.choice((0, 3, 40)), i) for i, a in enumerate(rng.choices(range(1, 60), k=150) + rng.choices(range(1, 9000), k=60))] + [("c", None, 5, 900), ("d", 9, 3, 901), (None, 1, 2, 902)]
    right = [("c", a, a + rng.choice((0, 2, 30, 700)), i) for i, a in enumerate(rng.choices(range(1, 60), k=90) + rng.choices(range(1, 9000), k=60))] + [("e", 1, 5, 900)]
    l = spark.createDataFrame(left, "chrom string, first long, last long, i int")
    r = spark.createDataFrame(right, "chrom string, r_first long, r_last long, j int")
    want = sorted((i, j) for c, a, b, i in left for e, x, y, j in right if c == e and a is not None and x <= b and y >= a)
    for deep, pieces in ((10, 25), (40, 4_000_000), (10**6, 5)):
        got = intervals.deep_overlap_join(l, r, width=64, deep=deep, pieces=pieces)
        assert got.columns == intervals.overlap_join(l, r, width=64).columns and sorted((x.i, x.j) for x in got.collect()) == want
    assert intervals.deep_overlap_join(l.limit(0), r, deep=1).count() == 0


def test_sorted_pileup(spark):
    rng = random.Random(16)
    starts = sorted((rng.choice("ab"), rng.choice(range(1, 300))) for _ in range(400))
    rows = [(c, a, a + rng.choice((0, 4, 60)), rng.choice("LR"), rng.random() < 0.5) for c, a in starts] + [("z", 5, None, "L", None)]
    schema = "chrom string, pos long, clip_pos long, side string, mate_in_rep boolean"
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, reads.pileup(whole).collect()))
    # contiguous parts, as a sorted file has; and one part
    for parts in (1, 6):
        split = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), schema)
        got = reads.sorted_pileup(split)
        assert got.columns == reads.pileup(whole).columns and sorted(map(tuple, got.collect())) == want
    assert reads.sorted_pileup(whole.limit(0)).count() == 0
    for bad in ([("a", 9, 9, "L", False), ("a", 8, 8, "L", False)], [("a", 9, 9, "L", False), ("b", 1, 1, "L", False), ("a", 9, 9, "L", False)]):
        with pytest.raises(Exception, match="aren't sorted"):
            reads.sorted_pileup(spark.createDataFrame(spark.sparkContext.parallelize(bad, 1), schema))


def test_shuffled(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "event_id")
    got = {r.event_id: r.place for r in permutation.shuffled(df, "event_id", 5, 16).collect()}
    assert sorted(got.values()) == list(range(1000)) and got == {r.event_id: r.place for r in permutation.shuffled(df.repartition(3), "event_id", 5).collect()}
    assert got != {r.event_id: r.place for r in permutation.shuffled(df, "event_id", 6).collect()} and [got[i] for i in range(0, 30, 3)] != sorted(got[i] for i in range(0, 30, 3))


def test_kmeans_fit(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(m, 0.1, (30, 3)) for m in (0, 5, 9)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    centres = clusters.seeds(df, "id", "v", 3, 2)
    assert len(centres) == 3 and all(c in x.tolist() for c in centres) and centres == clusters.seeds(df.repartition(5), "id", "v", 3, 2)
    out, told = clusters.fit(df, "id", "v", 3, 2)
    own = np.array(centres)
    for _ in range(50):
        near = ((x[:, None] - own) ** 2).sum(2).argmin(1)
        own = np.array([x[near == c].mean(0) if (near == c).any() else own[c] for c in range(3)])
    assert [r.cluster for r in out.orderBy("id").collect()] == near.tolist() and len(told) < 50


def test_islands_over_chunks(spark):
    """Long rows reach over several chunks, some rows have no end or end before they begin; islands are named by their begins."""
    rng = random.Random(11)
    data = [(k, s, rng.choice([s, s + 3, s + 40, s + 260, None, s - 2])) for k in ("a", "b") for s in rng.choices(range(-300, 2000), k=120)]
    data += [("a", None, 4), (None, 3, 4), *data[:80], *data[:40]]
    for gap in (0, 7):
        want, reach, now = [], {}, {}
        for k, s, e in sorted((r for r in data if r[0] and r[1] is not None), key=lambda r: r[:2]):
            if k not in reach or s > reach[k] + gap:
                now[k] = s
            reach[k] = max(reach.get(k, s), s, s if e is None else e)
            want.append((k, s, now[k]))
        df = spark.createDataFrame(data, "chrom string, first long, last long")
        for chunk in (16, 100, 1 << 20):
            got = intervals.with_islands(df, "chrom", "first", "last", gap, chunk)
            assert got.columns == ["chrom", "first", "last", "island"]
            assert sorted((r["chrom"], r["first"], r["island"]) for r in got.collect()) == sorted(want)
