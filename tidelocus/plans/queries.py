"""Queries that run every operator over the driver's tables, and the same results as SQL.

The tables hold no alignments, so ``alignments`` derives them from orders and line items: a chromosome for
each supplier, ship days as positions, order days as mate positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers, permutation
from ..operators import clusters, coverage, evidence, factors, intervals, peaks, ranks, reads, repeats, stats
from ..scratch import written

NEAR = 300
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return (F.datediff(F.col(c), F.lit("1995-01-01").cast("date")) + 1).cast("long")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignment records (``schemas.ALIGNMENTS`` without bases)."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    mate = F.col("l_partkey") % 100
    side = F.when(F.col("l_returnflag") == "N", "0").otherwise(F.when(F.col("l_returnflag") == "R", "L").otherwise("R"))
    ops = F.when(side == "L", F.concat(F.col("l_linenumber"), F.lit("S20M"))).when(side == "R", F.concat(F.lit("20M"), F.col("l_linenumber"), F.lit("S"))).otherwise(F.lit("20M"))
    flag = F.when(F.col("l_linestatus") == "O", 0).otherwise(0x40) + F.when(F.col("l_partkey") % 13 == 0, 0x400).when(F.col("l_partkey") % 11 == 0, 0x100).when(F.col("l_partkey") % 17 == 0, 0x4).otherwise(0)
    return items.select(
        F.col("l_orderkey").cast("string").alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("chr"), "l_suppkey").alias("chrom"), _day("l_shipdate").alias("pos"), (_day("l_shipdate") + 19).alias("end_pos"),
        F.col("l_quantity").cast("int").alias("mapq"), reads.parse_cigar(ops).alias("cigar"), F.concat(F.lit("chr"), mate, F.when(mate >= 95, "_alt").otherwise("")).alias("mate_chrom"), _day("o_orderdate").alias("mate_pos"),
        (_day("l_shipdate") - _day("o_orderdate")).cast("int").alias("tlen"), F.lit(None).cast("string").alias("seq"), F.lit(None).cast("string").alias("qual"),
    )


_ALN = """
aln as (
  select cast(l_orderkey as varchar) as qname,
    case when l_linestatus = 'O' then 0 else 64 end + case when l_partkey % 13 = 0 then 1024 when l_partkey % 11 = 0 then 256 when l_partkey % 17 = 0 then 4 else 0 end as flag,
    'chr' || l_suppkey as chrom, datediff('day', date '1995-01-01', cast(l_shipdate as date)) + 1 as pos, datediff('day', date '1995-01-01', cast(l_shipdate as date)) + 20 as end_pos,
    cast(l_quantity as int) as mapq, case l_returnflag when 'R' then 'L' when 'A' then 'R' end as side, l_linenumber as clip,
    'chr' || (l_partkey % 100) || case when l_partkey % 100 >= 95 then '_alt' else '' end as mate_chrom,
    datediff('day', date '1995-01-01', cast(o_orderdate as date)) + 1 as mate_pos,
    datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as tlen
  from lineitem join orders on l_orderkey = o_orderkey
), good as (select * from aln where (flag & 1284) = 0 and (mapq is null or mapq > 12))"""

_REGIONS = """
regions as (
  select 'chr' || (o_custkey % 100) as chrom, datediff('day', date '1995-01-01', cast(o_orderdate as date)) + 1 as first,
    datediff('day', date '1995-01-01', cast(o_orderdate as date)) + 1 + o_custkey % 9 as last, o_orderpriority as label
  from orders
)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as labelled intervals of 1 to 9 days."""
    o = table(spark, sf_dir, "orders")
    first = _day("o_orderdate")
    return o.select(F.concat(F.lit("chr"), F.col("o_custkey") % 100).alias("chrom"), first.alias("first"), (first + F.col("o_custkey") % 9).alias("last"), F.col("o_orderpriority").alias("label"))


_MERGED = _REGIONS + """, flagged as (
  select chrom, first, last, case when first <= max(last) over (partition by chrom order by first, last rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from regions
), numbered as (select *, sum(new) over (partition by chrom order by first, last rows unbounded preceding) as island from flagged),
merged as (select chrom, min(first) as first, max(last) as last from numbered group by chrom, island)"""

_PILE = _ALN + """, pile as (
  select chrom, case side when 'L' then pos + clip else pos + 20 end as p, count(*) filter (side = 'L') as left_count, count(*) filter (side = 'R') as right_count
  from good where side is not null group by all having count(*) >= 2
)"""

_PEAKS = _PILE + """, gaps as (select *, case when p - lag(p) over (partition by chrom order by p) <= 100 then 0 else 1 end as new from pile),
isl as (select *, left_count + right_count as both_count, sum(new) over (partition by chrom order by p rows unbounded preceding) as island from gaps),
rel as (select *, p - min(p) over (partition by chrom, island) as d from isl),
sums as (
  select chrom, island, count(*) as n, arg_max(p, both_count * 100000 - p) as pos, max(both_count) as max_both,
    sum(left_count) as lw, sum(left_count * d) as lx, sum(left_count * d * d) as lxx, sum(right_count) as rw, sum(right_count * d) as rx, sum(right_count * d * d) as rxx,
    sum(both_count) as bw, sum(both_count * d) as bx, sum(both_count * d * d) as bxx
  from rel group by chrom, island
), peaks as (
  select chrom, cast(pos as bigint) as pos, cast(max_both as bigint) as max_both,
    case when n = 1 then 0.0 when lw = 0 then -1.0 else sqrt(cast(lxx * lw - lx * lx as double)) / lw end as left_sd,
    case when n = 1 then 0.0 when rw = 0 then -1.0 else sqrt(cast(rxx * rw - rx * rx as double)) / rw end as right_sd,
    case when n = 1 then 0.0 else sqrt(cast(bxx * bw - bx * bx as double)) / bw end as both_sd
  from sums
)"""


def _pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.pileup(reads.clip_events(alignments(spark, sf_dir)))


@query(f"with {_PILE} select chrom, cast(p as bigint) as pos, left_count, right_count, 0::bigint as mate_in_rep from pile")
def clip_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good reads' soft clips by position, with at least two."""
    return _pile(spark, sf_dir)


@query(f"""with {_ALN}, {_MERGED}, ev as (
  select chrom, case side when 'L' then pos + clip else pos + 20 end as p, side,
    exists (select 1 from merged m where m.chrom = g.chrom and g.mate_pos between m.first and m.last) as inside
  from good g where side is not null
) select chrom, cast(p as bigint) as pos, count(*) filter (side = 'L') as left_count, count(*) filter (side = 'R') as right_count, count(*) filter (inside) as mate_in_rep
from ev group by all having count(*) >= 2""")
def clip_pileup_in_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile-up with mates flagged by merged regions."""
    return reads.pileup(reads.clip_events(alignments(spark, sf_dir), regions(spark, sf_dir)))


@query(f"with {_PEAKS} select chrom, pos, max_both, round(left_sd, 6) as left_sd, round(right_sd, 6) as right_sd, round(both_sd, 6) as both_sd from peaks")
def peak_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of the pile-up."""
    found = peaks.call_peaks(_pile(spark, sf_dir))
    return found.select("chrom", "pos", "max_both", *[F.round(c, 6).alias(c) for c in ("left_sd", "right_sd", "both_sd")])


@query(f"""with {_PEAKS}, win as (
  select chrom, chrom || ':' || pos as locus, 'L' as side, greatest(pos - (150 + cast(trunc(3 * both_sd) as bigint)), 1) as a, pos as b from peaks
  union all select chrom, chrom || ':' || pos, 'R', pos + 1, pos + 150 + cast(trunc(3 * both_sd) as bigint) from peaks
), met as (
  select locus, g.mate_chrom, g.mate_pos, win.side from good g join win on g.chrom = win.chrom and g.pos <= b and g.end_pos >= a
  where not contains(g.mate_chrom, '_') and not (g.chrom = g.mate_chrom and abs(g.pos - g.mate_pos) < {NEAR})
), enough as (select locus from met group by locus having count(*) >= 2)
select locus, mate_chrom, cast(mate_pos as bigint) as mate_pos, count(*) filter (side = 'L') as left_count, count(*) filter (side = 'R') as right_count, 0::bigint as mate_in_rep
from met semi join enough using (locus) group by all""")
def discordant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs around the peaks by the mate's place."""
    return evidence.discordant_pairs(written(peaks.call_peaks(_pile(spark, sf_dir)), "peaks"), alignments(spark, sf_dir), NEAR, bin_width=128)


_COVERAGE = _ALN + """, loci as (
  select distinct 'chr' || (o_custkey % 100) as chrom, datediff('day', date '1995-01-01', cast(o_orderdate as date)) + 1 as first, datediff('day', date '1995-01-01', cast(o_orderdate as date)) + 31 as last
  from orders
), per as (
  select l.chrom, l.first, l.last, count(*) as n,
    count(*) filter ((flag & 1284) = 0 and (l.first + l.last) // 2 between a.pos and a.end_pos) as cov,
    count(tlen) filter ((flag & 1284) = 0 and a.chrom = a.mate_chrom and abs(tlen) < 2000) as n_ins,
    coalesce(sum(abs(tlen)) filter ((flag & 1284) = 0 and a.chrom = a.mate_chrom and abs(tlen) < 2000), 0) as sum_ins,
    coalesce(sum(tlen * tlen) filter ((flag & 1284) = 0 and a.chrom = a.mate_chrom and abs(tlen) < 2000), 0) as sum2_ins
  from loci l join aln a on a.chrom = l.chrom and a.pos <= l.last and a.end_pos >= l.first group by all having count(*) >= 10
)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    loci = o.select(F.concat(F.lit("chr"), F.col("o_custkey") % 100).alias("chrom"), _day("o_orderdate").alias("first"), (_day("o_orderdate") + 30).alias("last"))
    return coverage.locus_coverage(loci, alignments(spark, sf_dir), bin_width=128)


@query(f"with {_COVERAGE} select chrom, cast(first as bigint) as first, cast(last as bigint) as last, n, cov, n_ins, cast(sum_ins as bigint) as sum_ins, cast(sum2_ins as bigint) as sum2_ins, 0::bigint as read_length from per")
def locus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads over fixed loci."""
    return _coverage(spark, sf_dir)


@query(f"""with {_COVERAGE} select 'aln' as bam, round(avg(cov) filter (n_ins > 0), 9) as cov, 0::bigint as read_length, case when sum(n_ins) > 0 then round(sum(sum_ins) / sum(n_ins), 9) end as insert_size_mean,
case when sum(n_ins) > 0 then round(sqrt(cast(sum(sum2_ins) * sum(n_ins) - sum(sum_ins) * sum(sum_ins) as double)) / sum(n_ins), 9) else -1.0 end as insert_size_sd from per""")
def coverage_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary row of fixed loci."""
    out = coverage.summarise_coverage(_coverage(spark, sf_dir), "aln")
    return out.select("bam", "read_length", *[F.round(c, 9).alias(c) for c in ("cov", "insert_size_mean", "insert_size_sd")])


@query(f"""with {_ALN} select count(*) filter ((flag & 1284) = 0 and mapq > 12) as good, count(*) filter ((flag & 1284) = 0) as countable,
count(*) filter ((flag & 1028) = 0 and mapq >= 12) as in_region_scan, count(*) filter ((flag & 1028) = 0) as mapped, count(*) filter (not contains(mate_chrom, '_')) as mate_on_main,
count(*) filter (not (chrom = mate_chrom and abs(pos - mate_pos) < {NEAR})) as discordant from aln""")
def read_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reads each filter keeps."""
    each = {"good": reads.good_quality(), "countable": reads.countable(), "in_region_scan": reads.in_region_scan(), "mapped": reads.mapped(), "mate_on_main": reads.mate_on_main(), "discordant": reads.discordant(NEAR)}
    return alignments(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in each.items()])


@query("""with t as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as id, l_linenumber as s, cast(l_quantity as int) as m, l_partkey % 4 as d, l_suppkey % 5 as i, l_partkey as pos from lineitem),
ops as (
  select id, pos, 0 as i, 'H' as op, s as len, 0 as r, 0 as q from t union all select id, pos, 1, 'S', s, 0, s from t
  union all select id, pos, 2, 'M', m, m, m from t union all select id, pos, 3, 'D', d, d, 0 from t
  union all select id, pos, 4, 'I', i, 0, i from t union all select id, pos, 5, '=', m, m, m from t union all select id, pos, 6, 'N', s, s, 0 from t union all select id, pos, 7, 'S', d, 0, d from t
) select i, op, cast(sum(p) as bigint) as sum_p, cast(sum(qq) as bigint) as sum_q, cast(sum(len) as bigint) as sum_len, count(*) as n from (
  select i, op, len, pos + coalesce(sum(r) over w, 0) as p, coalesce(sum(q) over w, 0) as qq from ops window w as (partition by id order by i rows between unbounded preceding and 1 preceding)
) group by i, op""")
def cigar_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGAR strings of eight operations, walked and summed by operation."""
    t = table(spark, sf_dir, "lineitem")
    m = F.col("l_quantity").cast("int")
    text = F.concat("l_linenumber", F.lit("H"), "l_linenumber", F.lit("S"), m, F.lit("M"), F.col("l_partkey") % 4, F.lit("D"), F.col("l_suppkey") % 5, F.lit("I"), m, F.lit("="), "l_linenumber", F.lit("N"), F.col("l_partkey") % 4, F.lit("S"))
    ops = reads.cigar_operations(t.select(F.col("l_partkey").alias("pos"), reads.parse_cigar(text).alias("cigar")))
    return ops.groupBy("i", "op").agg(F.sum("p").alias("sum_p"), F.sum("q").alias("sum_q"), F.sum("len").cast("long").alias("sum_len"), F.count(F.lit(1)).alias("n"))


@query(f"with {_MERGED} select chrom, cast(first as bigint) as first, cast(last as bigint) as last from merged")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged intervals."""
    return intervals.merge(regions(spark, sf_dir), chunk=512)


@query(f"with {_MERGED} select chrom, cast(first as bigint) as first, cast(last as bigint) as last from merged where chrom = 'chr7'")
def region_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged intervals of one chromosome."""
    return intervals.subset(intervals.merge(regions(spark, sf_dir)), "chr7")


@query(f"""with {_ALN}, {_MERGED} select inside, count(*) as n, cast(sum(pos) as bigint) as sum_pos from (
  select a.pos, exists (select 1 from merged m where m.chrom = a.chrom and a.pos between m.first and m.last) as inside from aln a) group by inside""")
def region_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which read starts lie in a merged region."""
    found = intervals.contained(alignments(spark, sf_dir).select("chrom", "pos"), regions(spark, sf_dir), width=64)
    return found.groupBy("inside").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query(f"with {_ALN}, {_REGIONS} select a.qname, a.chrom, cast(a.pos as bigint) as pos, cast(r.first as bigint) as first, cast(r.last as bigint) as last from aln a join regions r on a.chrom = r.chrom and a.pos between r.first and r.last")
def stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intervals that hold each read's start."""
    points = alignments(spark, sf_dir).select("qname", "chrom", "pos")
    return intervals.stab(points, regions(spark, sf_dir).select("chrom", "first", "last"), width=64).select("qname", "chrom", "pos", "first", "last")


@query(f"with {_ALN}, {_REGIONS} select a.qname, a.chrom, cast(a.pos as bigint) as pos, cast(a.end_pos as bigint) as end_pos, cast(r.first as bigint) as r_first, cast(r.last as bigint) as r_last from aln a join regions r on a.chrom = r.chrom and a.pos <= r.last and a.end_pos >= r.first")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intervals that meet each read."""
    own = regions(spark, sf_dir).select("chrom", F.col("first").alias("r_first"), F.col("last").alias("r_last"))
    return intervals.overlap_join(alignments(spark, sf_dir).select("qname", "chrom", "pos", "end_pos"), own, "chrom", ("pos", "end_pos"), width=64)


@query(f"with {_ALN}, {_REGIONS} select qname, chrom, cast(pos as bigint) as pos from aln a where exists (select 1 from regions r where a.chrom = r.chrom and a.pos between r.first and r.last)")
def stabbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose start lies in an interval."""
    return intervals.stabbed(alignments(spark, sf_dir).select("qname", "chrom", "pos"), regions(spark, sf_dir), width=64).select("qname", "chrom", "pos")


@query(f"""with {_ALN}, {_REGIONS}, lab as (select distinct chrom, first, last, label from regions)
select a.qname, a.chrom, cast(a.pos as bigint) as pos, cast(r.first as bigint) as first, cast(r.last as bigint) as last, r.label from aln a join lab r on a.chrom = r.chrom and a.pos between r.first and r.last""")
def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the intervals that hold each read's start."""
    return intervals.annotate(alignments(spark, sf_dir).select("qname", "chrom", "pos"), regions(spark, sf_dir), width=64)


@query(f"with {_REGIONS} select chrom, cast(first as bigint) as first, cast(last as bigint) as last, array_to_string(list_sort(list(distinct label)), ',') as features from regions group by chrom, first, last")
def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted distinct labels of each interval."""
    return intervals.annotations(regions(spark, sf_dir)).withColumn("features", F.array_join("features", ","))


@query(f"""with {_REGIONS}, d as (select distinct chrom, first, last from regions), m as (select chrom, first, max(last) as last from d group by chrom, first)
select m.chrom, cast(m.first as bigint) as first, cast(m.last as bigint) as last, coalesce(string_agg(d.last, ',' order by d.last), '') as smaller
from m left join d on m.chrom = d.chrom and m.first = d.first and d.last < m.last group by m.chrom, m.first, m.last""")
def longest_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest interval of each start and the shorter ones."""
    return intervals.longest_by_start(regions(spark, sf_dir)).withColumn("smaller", F.array_join(F.col("smaller").cast("array<string>"), ","))


@query(f"""with {_REGIONS}, d as (select distinct chrom, first, last from regions)
select a.chrom, cast(a.first as bigint) as first, cast(a.last as bigint) as last, cast(arg_max(b.first, b.first * 100000 - b.last) as bigint) as parent_first, cast(arg_max(b.last, b.first * 100000 - b.last) as bigint) as parent_last
from d a left join d b on a.chrom = b.chrom and b.first <= a.first and b.last >= a.last and (b.first <> a.first or b.last <> a.last) group by all""")
def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest interval that encloses each."""
    return intervals.enclosing(regions(spark, sf_dir), width=4)


_CHROMS = "chroms as (select n_nationkey as chrom_id, 'chr' || n_nationkey || case when n_nationkey % 8 = 7 then '_alt' else '' end as chrom, cast(n_nationkey * 7 % 25 + 1 as bigint) * 400000 as length from nation)"


def chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a reference dictionary, whose size doesn't grow with the data."""
    key = F.col("n_nationkey")
    name = F.concat(F.lit("chr"), key, F.when(key % 8 == 7, "_alt").otherwise(""))
    return table(spark, sf_dir, "nation").select(key.alias("chrom_id"), name.alias("chrom"), ((key * 7 % 25 + 1).cast("long") * 400000).alias("length"))


@query(f"with {_CHROMS} select chrom, first, least(first + 999999, length) as last from (select chrom, length, unnest(generate_series(1, length, 1000000)) as first from chroms where length >= 4194304 and not contains(chrom, '_'))")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main chromosomes in tiles of a million."""
    return intervals.tile(reads.main_chromosomes(chromosomes(spark, sf_dir)), 1_000_000)


@query(f"with {_CHROMS} select chrom || ':1-' || length as region, '[1, ' || length || ']' as span, chrom, 1::bigint as first, length as last from chroms")
def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chromosomes as region strings, parsed again."""
    shown = intervals.whole(chromosomes(spark, sf_dir)).select(intervals.region_text().alias("region"), intervals.interval_text().alias("span"))
    return shown.withColumn("r", intervals.parse_region(F.col("region"))).select("region", "span", "r.*")


@query(f"""with {_CHROMS}, main as (select * from chroms where length >= 4194304 and not contains(chrom, '_')),
off as (select *, coalesce(sum(length) over (order by chrom_id rows between unbounded preceding and 1 preceding), 0) as start from main),
s as (select o_orderkey * 7919 % (select sum(length) from main) as j from orders)
select chrom, cast(j - start + 1 as bigint) as first, cast(j - start + 501 as bigint) as last from s join off on start <= j and j + 500 < start + length""")
def placed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genome offsets as loci inside chromosomes."""
    main = reads.main_chromosomes(chromosomes(spark, sf_dir))
    total = main.agg(F.sum("length").alias("total"))
    samples = table(spark, sf_dir, "orders").join(F.broadcast(total)).select((F.col("o_orderkey") * 7919 % F.col("total")).alias("at"))
    return coverage.place_samples(samples, main)


@query(f"""with {_CHROMS}, main as (select *, length - 500 as n from chroms where length >= 4194304 and not contains(chrom, '_')),
off as (select *, coalesce(sum(n) over (order by chrom_id rows between unbounded preceding and 1 preceding), 0) as start from main),
s as (select cast(('0x' || substr(md5('7:' || i), 1, 15)) as bigint) % (select sum(n) from main) as j from range(3000) t(i))
select chrom, cast(j - start + 1 as bigint) as first, cast(j - start + 501 as bigint) as last from s join off on start <= j and j < start + n""")
def sampled_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random loci, the same for a seed."""
    return coverage.sample_loci(reads.main_chromosomes(chromosomes(spark, sf_dir)), 3000, seed=7)


@query(f"with {_CHROMS} select l_orderkey, l_linenumber, l_partkey, coalesce(chrom, '') as chrom, coalesce(length, 0) as length from lineitem left join chroms on l_suppkey % 30 = chrom_id")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and lengths of reference numbers, some unknown."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 30).alias("chrom_id"))
    return reads.named(items, chromosomes(spark, sf_dir)).drop("chrom_id")


_MEMBERS = "mem as (select distinct user_id % 7 as k, event_id * 37 % 10007 as x from events)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("k"), (F.col("event_id") * 37 % 10007).alias("x"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("k"), (F.col("c_custkey") * 11 % 10100).alias("x"))


@query(f"with {_MEMBERS}, pr as (select c_custkey % 7 as k, c_custkey * 11 % 10100 as x from customer) select pr.k, pr.x, (select count(*) from mem where mem.k = pr.k and mem.x < pr.x) as rank from pr")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members lie below each probe."""
    return ranks.rank(_members(spark, sf_dir), _probes(spark, sf_dir), "k", "x", 1000)


@query(f"with {_MEMBERS}, pr as (select c_custkey % 7 as k, c_custkey * 11 % 10100 as a, c_custkey * 11 % 10100 + 50 as b from customer) select k, a, b, (select count(*) from mem where mem.k = pr.k and mem.x < a) as rank_first, (select count(*) from mem where mem.k = pr.k and mem.x < b) as rank_last from pr")
def rank_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of both ends of ranges."""
    probes = _probes(spark, sf_dir).select("k", F.col("x").alias("a"), (F.col("x") + 50).alias("b"))
    return ranks.rank_pair(_members(spark, sf_dir), probes, "k", "a", "b")


@query(f"with {_MEMBERS}, num as (select k, x, row_number() over (partition by k order by x) - 1 as i from mem) select k, i, x from num semi join (select distinct c_custkey % 7 as k, c_custkey as i from customer) w using (k, i)")
def select_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by number."""
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("k"), F.col("c_custkey").alias("i")).distinct()
    return ranks.select(_members(spark, sf_dir), wanted, "k", "x")


@query(f"with {_MEMBERS} select k, count(*) as count, max(x) + 1 as size from mem group by k")
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinality and extent of each set."""
    return ranks.sizes(_members(spark, sf_dir), "k", "x")


@query(f"with {_MEMBERS}, w as (select k, x // 32 as word, cast(sum(1::bigint << cast(x % 32 as int)) as bigint) as bits from mem group by all) select k, word, bits, cast(coalesce(sum(bit_count(bits)) over (partition by k order by word rows between unbounded preceding and 1 preceding), 0) as bigint) as before from w")
def bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a bitmap with running counts."""
    return ranks.bitmap(_members(spark, sf_dir), "k", "x")


@query(f"with {_MEMBERS} select k, x, lag(x) over (partition by k order by x) as previous, lead(x) over (partition by k order by x) as next from mem")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with those before and after."""
    return ranks.neighbours(_members(spark, sf_dir), "k", "x")


@query(f"with {_REGIONS} select distinct chrom, cast(x as bigint) as x from (select chrom, first as x from regions union all select chrom, last from regions union all select chrom, 0 from regions)")
def end_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ends of intervals, and 0."""
    return ranks.domain(regions(spark, sf_dir))


@query(f"with {_MEMBERS}, pr as (select c_custkey % 7 as k, c_custkey * 11 % 10100 as x from customer) select pr.k, pr.x, 2 * (select count(*) from mem where mem.k = pr.k and mem.x < pr.x) - case when exists (select 1 from mem where mem.k = pr.k and mem.x = pr.x) then 0 else 1 end as place from pr")
def compressed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes in compressed coordinates."""
    return ranks.compressed(_members(spark, sf_dir), _probes(spark, sf_dir), "k", "x")


@query(f"with {_MEMBERS}, pr as (select c_custkey % 7 as k, c_custkey * 11 % 10100 as x from customer) select distinct pr.k, pr.x as probe, (select max(x) from mem where mem.k = pr.k and mem.x <= pr.x) as x from pr where pr.x >= (select min(x) from mem where mem.k = pr.k)")
def expanded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed coordinates back as members."""
    own = _members(spark, sf_dir)
    places = ranks.compressed(own, _probes(spark, sf_dir), "k", "x").distinct().withColumnRenamed("x", "probe")
    return ranks.expanded(own, places, "k", "x").select("k", "probe", "x")


_K = 4
_WINDOWS = f"""c as (select doc_id, upper(unnest(string_split(text, ''))) as c, unnest(generate_series(1, length(text))) as i from documents where length(text) >= {_K}),
l as (select doc_id, i - 1 as place, {' || '.join(f"lead(c, {j}) over (partition by doc_id order by i)" for j in range(_K))} as t from c),
w as (select doc_id, place, t from l where length(t) = {_K} and regexp_full_match(t, '[ACGTU]+')
), d as (select *, translate(t, 'ACGTU', '01233') as q from w),
km as (select doc_id, place, t, {' + '.join(f'cast(q[{i + 1}] as bigint) * {4 ** (_K - 1 - i)}' for i in range(_K))} as kmer from d)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"with {_WINDOWS} select doc_id, cast(place as int) as place, kmer from km")
def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four bases in texts (mostly interrupted)."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(kmers.windows(F.col("text"), _K)).alias("w")).select("doc_id", F.col("w.at").alias("place"), "w.kmer")


@query(f"""with {_WINDOWS}, rc as (select *, reverse(translate(t, 'ACGTU', 'TGCAA')) as r from km),
both_ as (select doc_id, kmer from km union all select doc_id, {' + '.join(f"cast(translate(r, 'ACGT', '0123')[{i + 1}] as bigint) * {4 ** (_K - 1 - i)}" for i in range(_K))} from rc)
select doc_id, kmer, count(*) as n from both_ group by all""")
def kmer_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of windows on both strands."""
    return kmers.frequencies(_docs(spark, sf_dir), "doc_id", "text", _K)


@query(f"""with {_WINDOWS}, u as (select distinct kmer, replace(t, 'U', 'T') as text from km)
select a.kmer as x, b.kmer as y, a.text as bases, reverse(translate(a.text, 'ACGT', 'TGCA')) as complement, reverse(a.text) as backwards, cast(hamming(a.text, b.text) as int) as distance
from u a, u b""")
def kmer_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendering, complement and distance of the k-mers that occur."""
    own = _docs(spark, sf_dir).select(F.explode(kmers.windows(F.col("text"), _K)).alias("w")).select(F.col("w.kmer").alias("x")).distinct()
    # at most 4^4 of them, whatever the documents
    everyone = own.agg(F.array_sort(F.collect_set("x")).alias("all"))
    pairs = everyone.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    rc = kmers.render(kmers.reverse_complement_packed(F.col("x"), _K), _K)
    return pairs.select("x", "y", kmers.render(F.col("x"), _K).alias("bases"), rc.alias("complement"), kmers.render(kmers.reverse(F.col("x"), _K), _K).alias("backwards"), kmers.hamming(F.col("x"), F.col("y")).alias("distance"))


@query(f"""with {_WINDOWS}, rc as (select *, reverse(translate(t, 'ACGTU', 'TGCAA')) as r from km),
both_ as (select doc_id, kmer from km union all select doc_id, {' + '.join(f"cast(translate(r, 'ACGT', '0123')[{i + 1}] as bigint) * {4 ** (_K - 1 - i)}" for i in range(_K))} from rc),
n as (select doc_id, kmer, count(*) as n from both_ group by all), every_ as (select doc_id, i from (select distinct doc_id from n), range({4**_K}) t(i))
select doc_id, string_agg(coalesce(n, 0), ',' order by i) as vector from every_ left join n using (doc_id) where n.kmer = i or n.kmer is null group by doc_id""".replace("left join n using (doc_id) where n.kmer = i or n.kmer is null", "left join n on n.doc_id = every_.doc_id and n.kmer = i").replace("select doc_id, string_agg", "select every_.doc_id, string_agg").replace("group by doc_id", "group by every_.doc_id"))
def kmer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors of counts of windows on both strands."""
    found = kmers.frequency_vectors(_docs(spark, sf_dir), "doc_id", "text", _K)
    return found.select("doc_id", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"))


@query("select doc_id, md5(text) as digest from (select *, row_number() over (partition by substr(sha256(text), 1, 16) order by doc_id) as r from documents) where r = 1")
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content."""
    return repeats.first_by_content(_docs(spark, sf_dir), "text", "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_SPANS = "sp as (select doc_id, doc_id * 7919 % length(text) + 1 as a, least(doc_id * 7919 % length(text) + 20, length(text)) as b, length(text) as n, text from documents where length(text) > 0)"


@query(f"with {_SPANS} select doc_id, greatest(1, a - 30) as st, least(n, b + 30) as en, substr(text, greatest(1, a - 30), least(n, b + 30) - greatest(1, a - 30) + 1) as slice from sp")
def padded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded spans cut from texts."""
    rows = _docs(spark, sf_dir).where("length(text) > 0").withColumn("n", F.length("text").cast("long"))
    begin = F.col("doc_id") * 7919 % F.col("n")
    rows = rows.withColumns({"a": begin + 1, "b": F.least(begin + 20, F.col("n"))})
    st, en = repeats.padded(F.col("a"), F.col("b"), F.col("n"), 30)
    return rows.withColumns({"st": st, "en": en}).select("doc_id", "st", "en", repeats.cut(F.col("text"), F.col("st"), F.col("en")).alias("slice"))


@query("""with g as (select 'ch' || doc_id as name, text as seq, doc_id from documents),
r as (select l_orderkey * 10 + l_linenumber as key, 'ch' || l_partkey as chrom, l_orderkey * 7919 % length(text) + 1 as a, least(l_orderkey * 7919 % length(text) + 5, length(text)) as b, l_shipmode as label, l_flag as class from (select *, case when l_quantity < 25 then 'SINE' else 'LINE' end as l_flag, case when l_tax < 0.04 then 'Alu' else 'L1' end as l_shipmode from lineitem join documents on doc_id = l_partkey and length(text) > 0)),
o as (select distinct chrom, a, b, label, class from r), j as (select o.*, g.doc_id, g.seq, length(g.seq) as n, substr(g.seq, a, b - a + 1) as own from o join g on g.name = o.chrom where class = 'SINE' and regexp_matches(label, '^A')),
f as (select *, row_number() over (partition by own order by doc_id, a, b, label) as k from j)
select chrom || ':' || a || '-' || b || '~10~' || class || '~' || label as name, substr(seq, greatest(1, a - 10), least(n, b + 10) - greatest(1, a - 10) + 1) as seq from f where k = 1""")
def prepared_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat elements cut from anywhere in a genome of texts, distinct by content, padded."""
    docs = _docs(spark, sf_dir).where("length(text) > 0")
    genome = docs.select(F.concat(F.lit("ch"), "doc_id").alias("name"), F.col("text").alias("seq"), F.col("doc_id").alias("order"))
    items = table(spark, sf_dir, "lineitem").join(docs.select(F.col("doc_id").alias("l_partkey"), F.length("text").cast("long").alias("n")), "l_partkey")
    begin = F.col("l_orderkey") * 7919 % F.col("n") + 1
    label, kind = F.when(F.col("l_tax") < 0.04, "Alu").otherwise("L1"), F.when(F.col("l_quantity") < 25, "SINE").otherwise("LINE")
    rows = items.select(F.concat(F.lit("ch"), "l_partkey").alias("chrom"), begin.alias("begin"), F.least(begin + 4, F.col("n")).alias("end"), F.lit("+").alias("strand"), label.alias("label"), kind.alias("class")).distinct()
    # numbered by begin, end, label and class within the genome's order
    number = F.col("begin") * 4 + F.when(F.col("label") == "Alu", 0).otherwise(2) + F.when(F.col("class") == "LINE", 0).otherwise(1)
    rows = rows.withColumn("row_no", F.substring("chrom", 3, 10).cast("long") * 1_000_000 + number)
    return repeats.prepare_repeats(rows, genome, 10, "SINE", "^A", size=64)


@query("select distinct p_type as class from part")
def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct classes."""
    return repeats.classes(table(spark, sf_dir, "part").select(F.col("p_type").alias("class")))


@query("select p_brand as label, count(*) as n from part where regexp_matches(p_brand, '[13]$') group by all")
def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of labels that match an expression."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.lit("x").alias("class"))
    return repeats.label_counts(repeats.select_repeats(rows, "x", "[13]$"))


@query("select l_returnflag, count(*) as n, round(avg(l_linenumber), 9) as mean, round(var_pop(l_linenumber), 9) as variance, round(stddev_pop(l_linenumber), 9) as deviation from lineitem group by all")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments merged from parts."""
    parts = stats.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], "l_linenumber")
    whole = stats.merge_moments(parts, ["l_returnflag"])
    return whole.select("l_returnflag", "n", F.round(stats.mean(), 9).alias("mean"), F.round(stats.variance(), 9).alias("variance"), F.round(stats.deviation(), 9).alias("deviation"))


@query("""select l_suppkey, cast(sum(l_linenumber) as bigint) as n, round(sum(l_linenumber * l_partkey) / sum(l_linenumber), 6) as mean,
round(sqrt(cast(sum(l_linenumber * l_partkey * l_partkey) * sum(l_linenumber) - sum(l_linenumber * l_partkey) * sum(l_linenumber * l_partkey) as double)) / sum(l_linenumber), 6) as deviation from lineitem group by all""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means and deviations, from sums of distances from a centre."""
    sums = stats.moments(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", "l_linenumber", centre=500)
    return sums.select("l_suppkey", "n", F.round(stats.mean() + 500, 6).alias("mean"), F.round(stats.deviation(), 6).alias("deviation"))


def _remedian_sql() -> str:
    levels = ["l0 as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i, value as x from events)"]
    for k in range(1, 9):
        levels.append(f"l{k} as (select user_id, i // 5 as i, list_sort(list(x))[3] as x from l{k - 1} group by user_id, i // 5 having count(*) = 5)")
    tops = " union all ".join(f"select user_id, {k} as k, list_sort(list(x)) as v from l{k} group by user_id" for k in range(9))
    return f"with {', '.join(levels)} select user_id, round(v[len(v) // 2 + 1], 9) as median from ({tops}) qualify k = max(k) over (partition by user_id)"


@query(_remedian_sql())
def remedian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of medians of fives of each user's values in event order."""
    rows = stats.indexed(table(spark, sf_dir, "events"), ["user_id"], "event_id", 4096)
    return stats.remedian(rows, ["user_id"], "value").select("user_id", F.round("median", 9).alias("median"))


@query("with f as (select event_type, min(event_id) as first from events group by all), l as (select event_type, row_number() over (order by first) - 1 as code from f) select event_type, code, count(*) as n from events join l using (event_type) group by all")
def factor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types numbered by first appearance."""
    return factors.encode(table(spark, sf_dir, "events"), "event_type", "event_id").groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n"))


#: More than the ids of events, and close below a power of four.
_DOMAIN = 16_500_000


def _permutation_sql(n: int, seed: int) -> str:
    bits = permutation.half_bits(n)
    mask = (1 << bits) - 1
    steps = ["s as (select event_id as i, event_id as v from events)"]

    def rounds(source: str, target: str) -> list[str]:
        out = [f"{target}0 as (select i, v, v >> {bits} as l, v & {mask} as r from {source})"]
        for k in range(permutation.ROUNDS):
            out.append(f"{target}{k + 1} as (select i, v, r as l, xor(l, cast(('0x' || substr(md5('{k}:{seed}:' || r), 1, 8)) as bigint) % {1 << bits}) as r from {target}{k})")
        return [*out, f"{target}e as (select i, v, (l << {bits}) | r as w from {target}{permutation.ROUNDS})"]

    steps += rounds("s", "a")
    last = "a"
    for j in range(12):
        steps.append(f"x{j} as (select i, w as v, w from {last}e)")
        name = f"b{j}_"
        steps += rounds(f"x{j}", name)[:-1]
        steps.append(f"{name}e as (select i, v, case when v < {n} then v else (l << {bits}) | r end as w from {name}{permutation.ROUNDS})")
        last = name
    return f"with {', '.join(steps)} select i, w as value from {last}e"


@query(_permutation_sql(_DOMAIN, 19).replace("select i, w as value from", "select i as event_id, w as place from"))
def feistel_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's place in a permutation of a domain that holds their ids."""
    return table(spark, sf_dir, "events").select("event_id", permutation.permuted(F.col("event_id"), _DOMAIN, 19).alias("place"))


@query("with o as (" + _permutation_sql(_DOMAIN, 19) + f") select i as event_id, value as place from o where value < {_DOMAIN // 100}")
def shuffled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a hundredth of the events without replacement: those that the permutation puts first."""
    return permutation.shuffled_sample(table(spark, sf_dir, "events").select("event_id"), "event_id", _DOMAIN, _DOMAIN // 100, 19)


@query("select event_id, user_id, row_number() over (order by cast('0x' || substr(md5('19:' || event_id), 1, 15) as bigint), event_id) - 1 as place from events")
def shuffled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in a seeded random order."""
    return permutation.shuffled(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 19)


@query(f"with {_ALN}, {_REGIONS} select a.qname, a.chrom, cast(a.pos as bigint) as pos, cast(a.end_pos as bigint) as end_pos, cast(r.first as bigint) as first, cast(r.last as bigint) as last, r.label from aln a join regions r on a.chrom = r.chrom and a.pos <= r.last and a.end_pos >= r.first")
def deep_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of alignments and regions, bins of more than 64 rows split and swept."""
    own = regions(spark, sf_dir).withColumnsRenamed({"first": "r_first", "last": "r_last"})
    out = intervals.deep_overlap_join(alignments(spark, sf_dir).select("qname", "chrom", "pos", "end_pos"), own, left_range=("pos", "end_pos"), deep=64)
    return out.select("qname", "chrom", "pos", "end_pos", F.col("r_first").alias("first"), F.col("r_last").alias("last"), "label")


_CENTRES = 8


def _centres(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < _CENTRES).orderBy("vec_id").select("embedding").collect()
    return [list(r["embedding"]) for r in rows]


_ASSIGN = f"""c as (select vec_id as cluster, embedding as c from embeddings where vec_id < {_CENTRES}),
d as (select vec_id, cluster, sqrt(list_sum(list_transform(list_zip(embedding, c), lambda p: (cast(p[1] as double) - p[2]) * (cast(p[1] as double) - p[2])))) as distance from embeddings, c),
a as (select vec_id, arg_min(cluster, distance) as cluster, min(distance) as distance from d group by vec_id)"""


@query(f"with {_ASSIGN} select vec_id, cast(cluster as int) as cluster, round(distance, 6) as distance from a")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at their nearest of eight centroids."""
    out = clusters.assign(table(spark, sf_dir, "embeddings"), _centres(spark, sf_dir), "embedding")
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"with {_ASSIGN} select cast(cluster as int) as cluster, cast(dim - 1 as int) as dim, round(avg(x), 6) as mean from (select cluster, generate_subscripts(embedding, 1) as dim, cast(unnest(embedding) as double) as x from a join embeddings using (vec_id)) group by all")
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New centroids after one assignment."""
    out = clusters.assign(table(spark, sf_dir, "embeddings"), _centres(spark, sf_dir), "embedding")
    return clusters.centroids(out, "embedding").select("cluster", "dim", F.round("mean", 6).alias("mean"))


@query("select label, vec_id, cast(dim - 1 as int) as dim, round(avg(x) over (partition by label, dim order by vec_id rows unbounded preceding), 6) as mean from (select label, vec_id, generate_subscripts(embedding, 1) as dim, cast(unnest(embedding) as double) as x from embeddings)")
def running_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each label's vectors so far."""
    out = clusters.running_centroid(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "vec_id", "dim", F.round("mean", 6).alias("mean"))


@query(f"""with {_ASSIGN}, m as (select cluster, generate_subscripts(embedding, 1) as dim, cast(unnest(embedding) as double) as x from a join embeddings using (vec_id)),
c2 as (select cluster, list(x order by dim) as c from (select cluster, dim, avg(x) as x from m group by all) group by cluster),
c3 as (select cluster, coalesce(c2.c, list_transform(c.c, lambda q: cast(q as double))) as c from c left join c2 using (cluster)),
d2 as (select vec_id, sqrt(list_sum(list_transform(list_zip(embedding, c), lambda p: (cast(p[1] as double) - p[2]) * (cast(p[1] as double) - p[2])))) as distance from embeddings, c3),
a2 as (select vec_id, min(distance) as distance from d2 group by vec_id)
select 0 as round, count(*) as n, round(avg(distance), 6) as mean, round(stddev_pop(distance), 6) as deviation from a
union all select 1, count(*), round(avg(distance), 6), round(stddev_pop(distance), 6) from a2""")
def kmeans_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the distances in two rounds from given centroids."""
    _, told = clusters.iterate(table(spark, sf_dir, "embeddings"), _centres(spark, sf_dir), "embedding", 2)
    rows = [(i, t["n"], t["mean"], t["deviation"]) for i, t in enumerate(told)]
    return spark.createDataFrame(rows, "round int, n long, mean double, deviation double").select("round", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _fit_sql(k: int, seed: int, rounds: int) -> str:
    far = "sqrt(list_sum(list_transform(list_zip(embedding, c), lambda p: (cast(p[1] as double) - p[2]) * (cast(p[1] as double) - p[2]))))"
    steps = [f"c0 as (select row_number() over (order by md5('{seed}:' || vec_id), vec_id) - 1 as cluster, list_transform(embedding, lambda x: cast(x as double)) as c from embeddings qualify cluster < {k})"]
    for i in range(rounds + 1):
        steps.append(f"a{i} as (select vec_id, arg_min(cluster, distance) as cluster, min(distance) as distance from (select vec_id, cluster, {far} as distance from embeddings, c{i}) group by vec_id)")
        steps.append(f"m{i} as (select cluster, dim, avg(x) as x from (select cluster, generate_subscripts(embedding, 1) as dim, cast(unnest(embedding) as double) as x from a{i} join embeddings using (vec_id)) group by all)")
        steps.append(f"c{i + 1} as (select cluster, coalesce(n.c, c{i}.c) as c from c{i} left join (select cluster, list(x order by dim) as c from m{i} group by cluster) n using (cluster))")
    return f"with {', '.join(steps)} select vec_id, cast(cluster as int) as cluster, round(distance, 6) as distance from a{rounds}"


@query(_fit_sql(10, 7, 4))
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in ten clusters after four rounds from drawn rows."""
    out, _ = clusters.fit(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, 7, 4)
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))
