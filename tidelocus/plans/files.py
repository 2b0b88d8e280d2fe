"""Queries that write each text format, read it again, and run the streams; their SQL is that of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import evidence, peaks, reads, stored
from ..scratch import folder, written
from ..sources import binary, ordered, sinks, text
from ..streaming import streams
from .queries import _ALN, _CHROMS, _MERGED, _PEAKS, _PILE, _REGIONS, NEAR, ORACLES, QUERIES, alignments, chromosomes, query, regions, table


def _pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.pileup(reads.clip_events(alignments(spark, sf_dir)))


def _bed(spark: SparkSession, sf_dir: str, compression: str) -> str:
    """The regions as BED lines, after a comment."""
    path = folder(spark, "bed")
    own = regions(spark, sf_dir)
    lines = own.select(F.concat_ws("\t", "chrom", (F.col("first") - 1).cast("string"), F.col("last").cast("string"), "label").alias("value"))
    spark.createDataFrame([("# a comment",), ("track name=x",)], "value string").unionByName(lines).write.text(path, compression=compression)
    return path


@query(f"with {_REGIONS} select chrom, cast(first as bigint) as first, cast(last as bigint) as last, label as name from regions")
def bed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BED file's rows, 1-based and closed."""
    return text.read_bed(spark, _bed(spark, sf_dir, "none"))


@query(f"with {_MERGED} select chrom, cast(first as bigint) as first, cast(last as bigint) as last from merged")
def bed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged regions of a compressed BED file."""
    return text.read_regions(spark, _bed(spark, sf_dir, "gzip"))


_LETTERS = "select 'd' || doc_id as name, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') as seq from documents"


@query(f"select * from ({_LETTERS}) where seq <> ''")
def fasta_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of texts as FASTA, in wrapped lines, read again."""
    path = folder(spark, "fasta")
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("seq"))
    sinks.write_fasta(own.where("seq <> ''"), path, "gzip")
    return text.read_fasta(spark, path).select("name", "seq")


@query(f"""select name, piece, piece * 700 + 1 as start, length(seq) as length, substr(seq, cast(piece * 700 + 1 as bigint), 700) as seq from (select *, unnest(range(cast(ceil(length(seq) / 700.0) as bigint))) as piece from ({_LETTERS}) where seq <> '')""")
def fasta_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of texts as FASTA, read again by ranges of bytes in pieces of 700."""
    path = folder(spark, "fasta")
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("seq"))
    sinks.write_fasta(own.where("seq <> ''"), path)
    return text.read_fasta_pieces(spark, path, 700).select("name", "piece", "start", "length", "seq")


@query(f"select name as id, seq, seq as qual from ({_LETTERS}) where seq <> ''")
def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of texts as FASTQ, read again."""
    binary.register(spark)
    path = folder(spark, "fastq")
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("seq"))
    sinks.write_fastq(own.where("seq <> ''").withColumn("qual", F.col("seq")), path)
    return spark.read.format("fastq").load(path)


_ELEMENTS = """select l_partkey, l_suppkey, l_linenumber, case l_returnflag when 'N' then 14 when 'R' then 16 else 15 end as n, case when l_linestatus = 'O' then '+' else 'C' end as strand from lineitem"""


def _repeatmasker(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "repeatmasker")
    t = table(spark, sf_dir, "lineitem")
    strand = F.when(F.col("l_linestatus") == "O", "+").otherwise("C")
    cells = ["463", "1.3", "0.6", "1.7", F.concat(F.lit("chr"), "l_suppkey"), F.col("l_partkey").cast("string"), (F.col("l_partkey") + F.col("l_linenumber")).cast("string"), "(9)", strand, F.concat(F.lit("Alu"), "l_linenumber"), "SINE/Alu", "1", "2", "(3)"]
    line = F.concat_ws("  ", *[F.lit(c) if isinstance(c, str) else c for c in cells], F.when(F.col("l_returnflag") == "N", None).when(F.col("l_returnflag") == "R", "7  *").otherwise("7"))
    head = spark.createDataFrame([("   SW   perc perc perc  query",), ("score   div. del. ins.  sequence",), ("",)], "value string")
    head.unionByName(t.select(F.concat(F.lit("  "), line).alias("value"))).write.text(path)
    return path


@query(f"select 'chr' || l_suppkey as chrom, l_partkey as begin, l_partkey + l_linenumber as \"end\", case strand when 'C' then '-' else '+' end as strand, 'Alu' || l_linenumber as label, 'SINE/Alu' as class from ({_ELEMENTS}) where n = 15")
def repeatmasker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of RepeatMasker tables with the right number of fields."""
    return text.read_repeatmasker(spark, _repeatmasker(spark, sf_dir)).drop("row_no")


@query(f"select n, count(*) as rows from ({_ELEMENTS}) where n <> 15 group by n")
def repeatmasker_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rows, by their number of fields."""
    bad = text.bad_rows(spark, _repeatmasker(spark, sf_dir))
    return bad.groupBy(F.size(F.split(F.trim("value"), r"\s+")).alias("n")).agg(F.count(F.lit(1)).alias("rows"))


@query(ORACLES["clip_pileup"])
def clips_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile-up as a table with a header, read again."""
    path = folder(spark, "clips")
    sinks.write_tsv(_pile(spark, sf_dir), path)
    return text.read_clips(spark, path)


@query(f"with {_PILE} select chrom, count(*) as n, sum(p)::bigint as sum_pos from pile group by chrom")
def untyped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as untyped rows, in four files with a header each."""
    path = folder(spark, "untyped")
    sinks.write_tsv(_pile(spark, sf_dir).repartition(4), path)
    rows = text.read_rows(spark, path).select(F.col("fields")[0].alias("chrom"), F.col("fields")[1].cast("long").alias("pos"))
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query(f"""with {_PILE}, n as (select row_number() over (order by chrom, p) as number, concat_ws(chr(9), chrom, p, left_count, right_count, 0) as value from pile)
select number, value from n union all select 0, concat_ws(chr(9), 'chrom', 'pos', 'left_count', 'right_count', 'mate_in_rep')""")
def ordered_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of clips written in order under one header, and its lines read again in order of the parts."""
    path = folder(spark, "ordered")
    ordered.write_sorted_tsv(_pile(spark, sf_dir), ["chrom", "pos"], path)
    return ordered.read_ordered(spark, path)


@query(ORACLES["clip_pileup"])
def sorted_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile-up of alignments stored in order of chromosome and start, without a shuffle of their events."""
    stored = written(alignments(spark, sf_dir).orderBy("chrom", "pos"), "sorted-alignments")
    return reads.sorted_pileup(reads.clip_events(stored))


@query(f"with {_PEAKS} select chrom, pos, max_both from peaks")
def peaks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks called from a table of clips and written as one, read again (without deviations, which it rounds)."""
    clips, out = folder(spark, "clips"), folder(spark, "peaks")
    sinks.write_tsv(_pile(spark, sf_dir), clips)
    sinks.write_tsv(peaks.call_peaks(text.read_clips(spark, clips)), out)
    return text.read_peaks(spark, out).select("chrom", "pos", "max_both")


@query(ORACLES["discordant_pairs"])
def discordant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs as a table without a header, read again."""
    path = folder(spark, "disc")
    found = evidence.discordant_pairs(written(peaks.call_peaks(_pile(spark, sf_dir)), "peaks"), alignments(spark, sf_dir), NEAR, bin_width=128)
    sinks.write_tsv(found, path, header=False)
    return spark.read.csv(path, schema=schemas.DISCORDANT, sep="\t")


@query(f"with {_ALN} select 'aln' as bam, cast(null as double) as cov, count(*) as read_length, avg(mapq) as insert_size_mean, -1.0::double as insert_size_sd from aln")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row as JSON, read again."""
    path = folder(spark, "json")
    row = alignments(spark, sf_dir).agg(F.lit("aln").alias("bam"), F.lit(float("nan")).alias("cov"), F.count(F.lit(1)).alias("read_length"), F.avg("mapq").alias("insert_size_mean"), F.lit(-1.0).alias("insert_size_sd"))
    sinks.write_json(row, path)
    return spark.read.schema(schemas.INFO).json(path)


def _streamed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of a finished stream (all input there is), from its Parquet sink."""
    out = folder(spark, name)
    q = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query(f"""with {_CHROMS}, {_ALN.replace("'chr' || l_suppkey", "'chr' || (l_suppkey % 25)")}, pile as (
  select chrom, case side when 'L' then pos + clip else pos + 20 end as p, count(*) filter (side = 'L') as left_count, count(*) filter (side = 'R') as right_count
  from good where side is not null and chrom in (select chrom from chroms) group by all having count(*) >= 2
) select chrom, cast(p as bigint) as pos, left_count, right_count, 0::bigint as mate_in_rep from pile""")
def streamed_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile-up of a stream of clip events over all chromosomes, which an event beyond them closes."""
    aln = alignments(spark, sf_dir).withColumn("chrom", F.concat(F.lit("chr"), F.substring("chrom", 4, 20).cast("long") % 25))
    events = reads.clip_events(aln).select("chrom", "clip_pos", "side", "mate_in_rep")
    end = spark.sql("select 'end' chrom, 10000000L clip_pos, 'L' side, false mate_in_rep")
    path = folder(spark, "events")
    events.unionByName(end).write.parquet(path)
    chroms = chromosomes(spark, sf_dir).unionByName(spark.sql("select 1000 chrom_id, 'end' chrom, 20000000L length"))
    stream = spark.readStream.schema(events.schema).parquet(path)
    return _streamed(spark, streams.streaming_pileup(stream, chroms), "pile")


@query(ORACLES["clip_pileup"])
def stateful_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile-up of a stream that is stopped halfway and goes on from its state; the second part closes all chromosomes."""
    columns = ["chrom", "pos", "clip_pos", "side", "mate_in_rep"]
    events = written(reads.clip_events(alignments(spark, sf_dir)).select(columns), "events")
    chroms = events.select("chrom").distinct().withColumn("length", F.lit(1 << 40))
    path, out, state = (folder(spark, x) for x in ("ordered-events", "ordered-pile", "ordered-state"))
    half = F.col("pos") < 1000
    for part in (events.where(half), events.where(~half).unionByName(streams.closing(chroms, events))):
        part.write.mode("append").parquet(path)
        stream = streams.ordered_pileup(spark.readStream.schema(events.schema).parquet(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schemas.CLIPS).parquet(out)


@query(f"""with {_ALN}, {_REGIONS}, points as (select distinct chrom, pos from aln) select 'stab' as kind, chrom, cast(pos as bigint) as first, cast(pos as bigint) as last, count(*) as n from points p join regions r using (chrom) where p.pos between r.first and r.last group by all
union all select 'overlap', a.chrom, cast(a.pos as bigint), cast(a.end_pos as bigint), count(*) from aln a join regions r on a.chrom = r.chrom and a.pos <= r.last and a.end_pos >= r.first group by all""")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval index that is written once, opened by its path, and used for places and for ranges."""
    path = folder(spark, "index")
    own = regions(spark, sf_dir).select("chrom", F.col("first").alias("r_first"), F.col("last").alias("r_last"))
    stored.store_index(own, path, width=64, buckets=16)
    index = stored.open_index(spark, path)
    aln = alignments(spark, sf_dir).select("chrom", "pos", "end_pos")
    stabs = stored.indexed_depth(aln, index).select(F.lit("stab").alias("kind"), "chrom", F.col("pos").alias("first"), F.col("pos").alias("last"), "n")
    meets = stored.indexed_overlap(aln, index, ("pos", "end_pos")).groupBy("chrom", F.col("pos").alias("first"), F.col("end_pos").alias("last")).agg(F.count(F.lit(1)).alias("n"))
    return stabs.unionByName(meets.select(F.lit("overlap").alias("kind"), "chrom", "first", "last", "n"))


@query("""with t as (select user_id, date_trunc('second', ts) as t from events), g as (select *, case when t <= lag(t) over (partition by user_id order by t) + interval 10 minutes then 0 else 1 end as new from t),
s as (select *, sum(new) over (partition by user_id order by t rows unbounded preceding) as island from g)
select user_id, epoch(min(t))::bigint as first, epoch(max(t))::bigint + 600 as last_plus_gap, count(*) as n from s group by user_id, island""")
def streamed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream of events, which an event long after closes."""
    own = table(spark, sf_dir, "events").select("user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    path = folder(spark, "events")
    own.unionByName(spark.sql("select -1L user_id, timestamp'2100-01-01 00:00:00' t")).write.parquet(path)
    stream = spark.readStream.schema(own.schema).parquet(path)
    found = _streamed(spark, streams.streaming_islands(stream, "user_id", "t", "10 minutes", "0 seconds"), "sessions")
    return found.where("user_id >= 0").select("user_id", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last_plus_gap").alias("last_plus_gap"), "n")


