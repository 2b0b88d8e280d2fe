"""File formats, sinks and streams on files made here."""

import gzip
import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidelocus import cli, schemas
from tidelocus.sources import binary, ordered, sinks, text
from tidelocus.streaming import streams


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, cigar, mate, seq, qual, tlen=0):
    codes = [binary.BASES.index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    ops = b"".join(struct.pack("<I", n << 4 | binary.CIGAR_OPS.index(o)) for o, n in cigar)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), mate[0], mate[1] - 1, tlen) + name.encode() + b"\0" + ops + packed + (bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq))
    return struct.pack("<i", len(body)) + body


def bam(path, records, chroms=(("c1", 5_000_000), ("c2_x", 10))):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(chroms)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in chroms)
    data = head + b"".join(records)
    path.write_bytes(b"".join(block(data[i : i + 100]) for i in range(0, len(data), 100)) + block(b""))


def test_bam_and_commands(spark, tmp_path):
    own = [record(f"r{i}", 0x40, 0, 100, 60, [("S", 3), ("M", 9)], (0, 900), "ACGTACGTACGT", "F" * 12, 120) for i in range(3)]
    own.append(record("u", 4, -1, 0, 255, [], (-1, 0), "ACG", None))
    bam(tmp_path / "x.bam", own)
    binary.register(spark)
    got = spark.read.format("bam").load(str(tmp_path / "x.bam")).collect()
    assert [r.qname for r in got] == ["r0", "r1", "r2", "u"]
    assert (got[0].chrom, got[0].pos, got[0].end_pos, got[0].mate_pos, got[0].seq, got[0].qual, got[0].tlen) == ("c1", 100, 108, 900, "ACGTACGTACGT", "F" * 12, 120)
    assert (got[3].chrom, got[3].pos, got[3].mapq, got[3].qual) == (None, None, None, None)
    header = spark.read.format("bam").option("mode", "header").load(str(tmp_path / "x.bam"))
    assert sorted(tuple(r) for r in header.collect()) == [(0, "c1", 5_000_000), (1, "c2_x", 10)]
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    run("clips", tmp_path / "x.bam", tmp_path / "fq", tmp_path / "clips")
    assert [tuple(r) for r in text.read_clips(spark, str(tmp_path / "clips")).collect()] == [("c1", 103, 3, 0, 0)]
    fastq = spark.read.format("fastq").load(str(tmp_path / "fq"))
    assert {(r.id, r.seq, r.qual) for r in fastq.collect()} == {(f"r{i}~c1~100~c1~900~L~1", "ACG", "FFF") for i in range(3)}
    run("peaks", tmp_path / "clips", tmp_path / "peaks")
    assert text.read_peaks(spark, str(tmp_path / "peaks")).first().max_both == 3
    run("disc", tmp_path / "x.bam", tmp_path / "peaks", tmp_path / "disc")
    run("info", tmp_path / "x.bam", tmp_path / "info")
    assert list(json.loads(spark.read.text(str(tmp_path / "info")).first().value)) == ["bam", "cov", "read_length", "insert_size_mean", "insert_size_sd"]


def packed_in(path, data, cuts):
    """A BAM file whose blocks end at these places of ``data``."""
    edges = [0, *sorted(set(cuts) - {0, len(data)}), len(data)]
    path.write_bytes(b"".join(block(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)) + block(b""))


def header_of(chroms):
    return b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(chroms)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in chroms)


def test_chunk_ends_at_the_next_block(spark, tmp_path):
    """A block for each chromosome, an empty block between; chunks end where the next block begins."""
    chroms = [("c1", 1000), ("c2", 1000)]
    made = [b"".join(record(f"r{c}{i}", 0, c, 10 + i, 60, [("M", 4)], (-1, 0), "ACGT", "FFFF") for i in range(5)) for c in (0, 1)]
    for gap in (b"", block(b"")):
        parts = [block(header_of(chroms)), block(made[0]) + gap, block(made[1]), block(b"")]
        (tmp_path / "x.bam").write_bytes(b"".join(parts))
        at = [sum(map(len, parts[:i])) << 16 for i in range(4)]
        places = [(c, 10 + i, 13 + i) for c in (0, 1) for i in range(5)]
        index(tmp_path / "x.bam.bai", [places[0], places[5]], [(at[1], at[2]), (at[2], at[3])], 2)
        binary.register(spark)
        got = spark.read.format("bam").load(str(tmp_path / "x.bam"))
        assert sorted(r.qname for r in got.collect()) == sorted(f"r{c}{i}" for c in (0, 1) for i in range(5)) and got.count() == 10
        assert got.where("chrom = 'c1'").count() == got.where("chrom = 'c2'").count() == 5


def test_ranges_without_index(spark, tmp_path):
    """Blocks that end between records, inside them, anywhere; every record once, however the file is split."""
    rng = random.Random(11)
    chroms = [("c1", 100_000), ("c2", 5_000)]
    made = []
    for i in range(700):
        n = rng.choice([1, 9, 30, 31, 700 if i % 50 == 0 else 20])
        ref = rng.choice([-1, 0, 0, 1])
        seq = "".join(rng.choices("ACGT", k=n))
        made.append(record(f"q{i}", 0 if ref >= 0 else 4, ref, rng.randint(1, 4000) if ref >= 0 else 0, 40, [("M", n)], (-1, 0), seq, None if i % 3 else "".join(rng.choices("!5F", k=n))))
    head, data = header_of(chroms), b"".join(made)
    ends = [len(head) + sum(map(len, made[:i])) for i in range(len(made) + 1)]
    whole = head + data
    shapes = {"between": ends[::9], "inside": [e + 7 for e in ends[::11]], "anywhere": rng.sample(range(len(whole)), 150), "small": [*range(0, len(whole), 97)]}
    binary.register(spark)
    for name, cuts in shapes.items():
        packed_in(tmp_path / f"{name}.bam", whole, [c for c in cuts if c < len(whole)])
        for span in (60, 700, 5000, 1 << 20):
            got = spark.read.format("bam").option("span", span).load(str(tmp_path / f"{name}.bam"))
            assert sorted(r.qname for r in got.select("qname").collect()) == sorted(f"q{i}" for i in range(700)), (name, span)
            if span == 700:
                assert got.rdd.getNumPartitions() > 10
    got = spark.read.format("bam").option("span", 900).load(f"file://{tmp_path}")
    assert got.count() == 4 * 700


def bin_of(begin, end):
    """The smallest bin that holds a range (0-based, half-open)."""
    for base, bits in reversed(binary.BINS):
        if begin >> bits == (end - 1) >> bits:
            return base + (begin >> bits)


def index(path, places, spans, chroms):
    """A ``.bai`` file for records at (ref, pos, end) that lie between these virtual offsets."""
    out = b"BAI\1" + struct.pack("<i", chroms)
    for ref in range(chroms):
        bins, windows = {}, {}
        for (r, a, b), (begin, end) in zip(places, spans, strict=True):
            if r == ref:
                bins.setdefault(bin_of(a - 1, b), []).append((begin, end))
                for w in range((a - 1) >> 14, ((b - 1) >> 14) + 1):
                    windows[w] = min(begin, windows.get(w, begin))
        out += struct.pack("<i", len(bins) + 1) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *c) for c in v) for k, v in bins.items()) + struct.pack("<IiQQQQ", binary.NO_RECORDS, 2, 0, 0, 0, 0)
        held = [windows.get(w, 0) for w in range(max(windows, default=-1) + 1)]
        out += struct.pack("<i", len(held)) + struct.pack(f"<{len(held)}Q", *held)
    path.write_bytes(out)


def test_region_scan_by_index(spark, tmp_path, monkeypatch):
    """Regions against all records; only chunks that a region meets are read; small spans change nothing."""
    chroms = (("c1", 5_000_000), ("c2", 900_000), ("c3", 10))
    rng = random.Random(2)
    places = sorted((rng.choice((0, 0, 1)), rng.randint(1, 800_000), rng.choice((5, 9, 40_000))) for _ in range(300))
    own = [record(f"r{i}", 0, r, a, 60, [("M", 4), ("N", n), ("M", 5)], (r, 1), "ACGTACGTA", "F" * 9) for i, (r, a, n) in enumerate(places)]
    own.append(record("u", 4, -1, 0, 255, [], (-1, 0), "ACG", None))
    bam(tmp_path / "x.bam", own, chroms)
    blocks = binary.Blocks(str(tmp_path / "x.bam"))
    binary.read_header(blocks)
    offsets = [blocks.tell()]
    for r in own:
        blocks.read(len(r))
        offsets.append(blocks.tell())
    ends = [(r, a, a + n + 8) for r, a, n in places]
    index(tmp_path / "x.bam.bai", ends, list(zip(offsets, offsets[1:-1], strict=False)), 3)
    binary.register(spark)
    scan = spark.read.format("bam").load(str(tmp_path / "x.bam"))
    for size in (1 << 25, 1):
        monkeypatch.setattr(binary, "SPAN_BYTES", size)
        assert sorted(r.qname for r in scan.collect()) == sorted([*(f"r{i}" for i in range(300)), "u"])
        for chrom, lo, hi in (("c1", 100_000, 200_000), ("c2", 1, 16_384), ("c1", 790_000, 900_000), ("c3", 1, 9), ("c1", 5, 4)):
            got = scan.where((F.col("chrom") == chrom) & (F.col("pos") <= hi) & (F.col("end_pos") >= lo)).collect()
            assert sorted(r.qname for r in got) == sorted(f"r{i}" for i, (r, a, b) in enumerate(ends) if chroms[r][0] == chrom and a <= hi and b >= lo)
    bins, windows = binary.read_index(str(tmp_path / "x.bam.bai"))[0]
    monkeypatch.undo()
    part, whole = (sum(e - b for b, e in binary.region_spans(bins, windows, *r)) for r in ((100_000, 110_000), (None, None)))
    assert 0 < part < whole / 2


def test_text_formats(spark, tmp_path, capsys):
    (tmp_path / "a.bed.gz").write_bytes(gzip.compress(b"c1\t99\t110\tx\n") + gzip.compress(b"c1\t109\t120\ty\nc2\t0\t5\tz\n"))
    assert sorted(tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed.gz")).collect()) == [("c1", 100, 110, "x"), ("c1", 110, 120, "y"), ("c2", 1, 5, "z")]
    assert sorted(tuple(r) for r in text.read_regions(spark, str(tmp_path / "a.bed.gz")).collect()) == [("c1", 100, 120), ("c2", 1, 5)]
    rows = ["  463 1.3 0.6 1.7 c1 3 6 (9) + AluY SINE/Alu 1 2 (3) 1", "1 2 3 4 c1 1 2 (3) C L1 LINE (1) 2 3 2", "1 2 3 4 c1 1 2 (3) C L1 LINE (1) 2 3 2 *", "1 2 3"]
    (tmp_path / "r.out").write_text("   SW  perc perc\nscore  div. del.\n\n" + "\n".join(rows) + "\n")
    assert [tuple(r)[1:] for r in text.read_repeatmasker(spark, str(tmp_path / "r.out")).collect()] == [("c1", 3, 6, "+", "AluY", "SINE/Alu"), ("c1", 1, 2, "-", "L1", "LINE")]
    assert text.bad_rows(spark, str(tmp_path / "r.out")).count() == 2
    (tmp_path / "g.fa").write_text(">c1 some > words\nACGT\nAC\n>c2\nGG\n")
    assert [(r.name, r.seq) for r in text.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("order").collect()] == [("c1", "ACGTAC"), ("c2", "GG")]
    (tmp_path / "t.tsv").write_text("a b\n1 2\n3  4\n")
    assert [(r.row, r.fields) for r in text.read_rows(spark, str(tmp_path / "t.tsv")).collect()] == [(0, ["1", "2"]), (1, ["3", "4"])]
    (tmp_path / "parts").mkdir()
    for k in range(4):
        (tmp_path / "parts" / f"p{k}.tsv").write_text(f"a \"b\nx{k}  \"1\ny{k}\t2,3\n")
    got = text.read_rows(spark, str(tmp_path / "parts")).orderBy("row").collect()
    assert sorted(r.fields for r in got) == sorted([f"x{k}", '"1'] if i else [f"y{k}", "2,3"] for k in range(4) for i in (0, 1))
    run = cli.parser().parse_args(["prepare-repeats", str(tmp_path / "r.out"), str(tmp_path / "g.fa"), str(tmp_path / "out.fa"), "-W", "1"])
    capsys.readouterr()
    cli.run(spark, run)
    assert capsys.readouterr().out == "AluY\t1\nL1\t1\n2 unique sequences out of 2 scanned; 2 rows left out\n"
    assert sorted(r.seq for r in text.read_fasta(spark, str(tmp_path / "out.fa")).collect()) == ["ACG", "CGTAC"]


def test_json_and_fasta_lines(spark, tmp_path):
    df = spark.createDataFrame([("x", float("nan"), 1)], "bam string, cov double, n long")
    assert json.loads(sinks.json_lines(df).first().value) == {"bam": "x", "cov": None, "n": 1}
    sinks.write_fasta(spark.createDataFrame([("a", "ACGTACGT")], schemas.SEQUENCES), str(tmp_path / "f"), line=4, single=True)
    assert spark.read.text(str(tmp_path / "f"), wholetext=True).first().value == ">a\nACGT\nACGT\n"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("c1", 5, "L"), ("c1", 5, "R"), ("c1", 9, "L"), ("c1", 20, "L"), ("c1", 20, "L"), ("c1", 40, "L"), ("c2", 3, "R"), ("c2", 3, "R"), ("c2", 50, "L"), ("c2", 90, "L")]
    for i in range(0, 10, 2):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"chrom": c, "clip_pos": p, "side": s, "mate_in_rep": False}) for c, p, s in lines[i : i + 2]))
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))  # files stream by their times
    stream = spark.readStream.schema("chrom string, clip_pos long, side string, mate_in_rep boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    chroms = spark.createDataFrame([(0, "c1", 100), (1, "c2", 200)], schemas.CHROMOSOMES)
    q = streams.streaming_pileup(stream, chroms).writeStream.format("memory").queryName("pile").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.chrom, r.pos, r.left_count, r.right_count) for r in spark.table("pile").collect()) == [("c1", 5, 1, 1), ("c1", 20, 2, 0), ("c2", 3, 0, 2)]
    timed = stream.select("chrom", F.timestamp_seconds("clip_pos").alias("t"))
    q = streams.streaming_islands(timed, "chrom", "t", "10 seconds", "0 seconds").writeStream.format("memory").queryName("isl").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {(r.chrom, r.first.timestamp(), r.n) for r in spark.table("isl").collect()}
    assert ("c1", 5.0, 3) in found and ("c1", 20.0, 2) in found


def test_fasta_pieces(spark, tmp_path, monkeypatch):
    """Records across range borders, empty ones, blanks, and letters before a header; the same as pieces of whole sequences."""
    rng = random.Random(5)
    records = [("a", "ACGT" * 900), ("b", ""), ("c", "".join(rng.choices("ACGTN", k=1400))), ("d", "A"), *((f"e{i}", "".join(rng.choices("acgt", k=rng.choice([1, 70, 699, 700, 701])))) for i in range(30))]
    lines = ["ACGT", ""]
    for name, seq in records:
        lines += [f">{name} more > words", *(seq[i : i + 60] + (" " if i % 7 else "") for i in range(0, len(seq), 60))]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "1.fa").write_text("\n".join(lines) + "\n")
    (tmp_path / "g" / "2.fa.gz").write_bytes(gzip.compress(b">z\nAC\nGT\n"))
    monkeypatch.setattr(text, "FRAGMENT", 130)
    want = sorted((n, p, 100 * p + 1, len(s), s[100 * p : 100 * p + 100]) for n, s in [*records, ("z", "ACGT")] for p in range(max(1, -(-len(s) // 100))))
    for span in ("333", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", span)
        try:
            got = text.read_fasta_pieces(spark, str(tmp_path / "g"), 100)
            assert sorted((r.name, r.piece, r.start, r.length, r.seq) for r in got.collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = {r.name: r.order for r in got.collect()}
    assert [n for n, _ in records] + ["z"] == sorted(order, key=order.get)


def test_ordered_text(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randint(1, 10_000), rng.choice([None, 0.5])) for _ in range(500)]
    df = spark.createDataFrame(rows, "chrom string, pos long, left_sd double").repartition(5)
    want = ["chrom\tpos\tleft_sd", *(f"{c}\t{p}\t{'' if d is None else '0.50'}" for c, p, d in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None)))]
    for compression, parts in (("none", 6), ("gzip", 3)):
        path = str(tmp_path / "out")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            ordered.write_sorted_tsv(df, ["chrom", "pos", "left_sd"], path, compression=compression)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        names = sorted(os.listdir(path))
        assert len(names) == parts and all(n.startswith("part-") for n in names)
        lines = [x for n in names for x in (gzip.open if n.endswith(".gz") else open)(f"{path}/{n}", "rt").read().splitlines()]
        assert lines == want
        assert [r.value for r in ordered.read_ordered(spark, path).orderBy("number").collect()] == want
    ordered.write_sorted_tsv(df.limit(0), ["chrom"], str(tmp_path / "none"))
    assert [r.value for r in ordered.read_ordered(spark, str(tmp_path / "none")).collect()] == want[:1]
    bad = df.withColumn("chrom", F.raise_error(F.lit("stop")).cast("string"))
    try:
        ordered.write_sorted_tsv(bad, ["pos"], str(tmp_path / "bad"))
        raise AssertionError("no error")
    except Exception as e:  # noqa: BLE001
        assert "stop" in str(e) and not list((tmp_path / "bad").glob("part*"))


def test_ordered_pileup(spark, tmp_path):
    """Positions leave once the start has passed them, what stays goes on to the next batch, and a start that goes back ends the query."""
    batches = [
        [("c1", 1, 5, "L"), ("c1", 3, 30, "R"), ("c1", 4, 5, "R"), ("c2", 9, 9, "L")],
        [("c1", 4, 30, "R"), ("c2", 9, 9, "L"), ("c2", 9, None, "L"), (None, 1, 1, "L")],
        [("c1", 31, 31, "L"), ("c2", 102, None, None)],
    ]
    (tmp_path / "in").mkdir()
    schema = "chrom string, pos long, clip_pos long, side string, mate_in_rep boolean"

    def add(i, rows):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"chrom": c, "pos": s, "clip_pos": p, "side": d, "mate_in_rep": d == "R" or None}) for c, s, p, d in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))  # files stream by their times

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = streams.ordered_pileup(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(schemas.CLIPS).parquet(str(tmp_path / "out")).collect())

    add(0, batches[0])
    assert go() == []  # the furthest start is 4
    add(1, batches[1])
    add(2, batches[2])
    assert go() == [("c1", 5, 1, 1, 1), ("c1", 30, 0, 2, 2), ("c2", 9, 2, 0, 0)]
    add(3, [("c1", 30, 40, "L")])
    with pytest.raises(Exception, match="aren't sorted"):
        go()


def test_ordered_pileup_closing(spark):
    events = spark.createDataFrame([("c1", 1, 5, "L", False)], "chrom string, pos long, clip_pos long, side string, mate_in_rep boolean")
    chroms = spark.createDataFrame([(0, "c1", 100)], schemas.CHROMOSOMES)
    assert [tuple(r) for r in streams.closing(chroms, events).collect()] == [("c1", 102, None, None, None)]
