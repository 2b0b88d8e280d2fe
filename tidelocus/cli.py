"""Command line: clips, peaks, disc, info and prepare-repeats over files."""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import coverage, evidence, peaks, reads, repeats
from .sources import binary, sinks, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelocus")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("clips", help="soft clips of a BAM file as FASTQ and a table of positions")
    p.add_argument("bam"), p.add_argument("fastq"), p.add_argument("table")
    p.add_argument("-R", "--regions", help="BED file of repeats")
    p = commands.add_parser("peaks", help="peaks of a table of positions")
    p.add_argument("clips"), p.add_argument("peaks")
    p = commands.add_parser("disc", help="discordant pairs around peaks")
    p.add_argument("bam"), p.add_argument("peaks"), p.add_argument("output")
    p = commands.add_parser("info", help="sampled coverage and insert sizes")
    p.add_argument("bam"), p.add_argument("output"), p.add_argument("--seed", type=int, default=0)
    p = commands.add_parser("prepare-repeats", help="distinct padded repeat sequences")
    p.add_argument("repeats"), p.add_argument("genome"), p.add_argument("output")
    p.add_argument("-C", "--repeat-class", help="_LIST_ lists the classes"), p.add_argument("--repeat-match"), p.add_argument("-W", "--window", type=int, default=repeats.WINDOW)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Carry out one command."""
    binary.register(spark)
    bam = lambda: spark.read.format("bam").load(args.bam)
    header = lambda: spark.read.format("bam").option("mode", "header").load(args.bam)
    if args.command == "clips":
        main = reads.main_chromosomes(header()).select("chrom")
        regions = text.read_regions(spark, args.regions) if args.regions else None
        events = reads.clip_events(bam().join(main, "chrom", "left_semi"), regions)
        sinks.write_fastq(reads.clip_reads(events), args.fastq)
        sinks.write_tsv(reads.pileup(events), args.table)
    elif args.command == "peaks":
        sinks.write_tsv(peaks.call_peaks(text.read_clips(spark, args.clips)), args.peaks)
    elif args.command == "disc":
        sinks.write_tsv(evidence.discordant_pairs(text.read_peaks(spark, args.peaks), bam(), chromosomes=header()), args.output, header=False)
    elif args.command == "info":
        loci = coverage.sample_loci(reads.main_chromosomes(header()), seed=args.seed)
        out = coverage.summarise_coverage(coverage.locus_coverage(loci, bam()), args.bam)
        sinks.write_json(out, args.output)
        print(sinks.json_lines(out).first()["value"])
    elif args.repeat_class == "_LIST_":
        for row in repeats.classes(text.read_repeatmasker(spark, args.repeats)).orderBy("class").collect():
            print(row["class"])
    else:
        rows = text.read_repeatmasker(spark, args.repeats)
        found = repeats.prepare_repeats(rows, text.read_fasta_pieces(spark, args.genome), args.window, args.repeat_class, args.repeat_match)
        kept = Observation()  # counted while the sequences are written
        sinks.write_fasta(found.observe(kept, F.count(F.lit(1)).alias("n")), args.output)
        scanned = repeats.label_counts(repeats.select_repeats(rows, args.repeat_class, args.repeat_match)).orderBy("label").collect()
        for row in scanned:
            print(f"{row['label']}\t{row['n']}")
        print(f"{kept.get['n']} unique sequences out of {sum(r['n'] for r in scanned)} scanned; {text.bad_rows(spark, args.repeats).count()} rows left out")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(args)
    run(SparkSession.builder.appName("tidelocus").getOrCreate(), args)


if __name__ == "__main__":
    main()
