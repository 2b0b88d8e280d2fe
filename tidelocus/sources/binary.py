"""Python data sources for BAM and FASTQ.

Paths are plain ones that executors can open, or addresses (``scheme://...``) of a file system that Arrow knows; a folder stands for its files.

BAM files are blocks of gzip members.  Where an index (``.bai``) lies beside the file, its chunks are dealt into partitions of about
``SPAN_BYTES``, and filters on ``chrom`` and on bounds of ``pos`` and ``end_pos`` choose the chunks whose bins a region meets.
Without an index, and for the records without a place at the end, partitions are ranges of about as many bytes (option ``span``): a task finds the
first block in its range, and in its contents the first record, which a chain of records after it has to prove.  A record belongs to
the range in which its first block begins.  Records stream through in Arrow batches, decoded a batch at once.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .. import schemas

BATCH, SPAN_BYTES = 2048, 32 << 20
#: Fixed values of the format: CIGAR operations and base codes.
CIGAR_OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Fixed values of the format: the first bytes of a block, a block's header as is usual, and a record's size and first fields.
MAGIC, HEADER, RECORD = b"\x1f\x8b\x08\x04", 18, "<iiiBBHHHiiii"
#: Blocks that prove a block's begin, and records that prove a record's.
LINKS, CHAIN = 4, 12


def open_file(path: str):
    """A file to read, wherever it lies."""
    if "://" in path:
        system, place = fs.FileSystem.from_uri(path)
        return system.open_input_file(place)
    return open(path, "rb")


def size_of(path: str) -> int | None:
    """The file's size; None where there is none."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    return info.size if info.type == fs.FileType.File else None


def files_of(path: str, ending: str = "") -> list[str]:
    """The path, or the files with this ending in a folder, in order of names."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n[0] not in "._" and n.endswith(ending)]


def block_size(head: bytes) -> int:
    """The size of the block that begins with these bytes (a whole header), or 0 where none begins."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    end, at = 12 + struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


def first_block(file, at: int, size: int) -> int:
    """Where the first block from ``at`` on begins, proven by the blocks after it; ``size``, the file's, where there is none."""
    file.seek(at)
    window = file.read(6 << 16)  # a block has 2 ** 16 bytes at most
    place = window.find(MAGIC)
    while place >= 0:
        here, links = place, 0
        while links < LINKS and (step := block_size(window[here : here + HEADER])):
            here, links = here + step, links + 1
            if at + here == size or here + HEADER > len(window):
                break
        if links and (links == LINKS or at + here == size or here + HEADER > len(window)):
            return at + place
        place = window.find(MAGIC, place + 1)
    return size


class Blocks:
    """The uncompressed stream of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, at: int = 0):
        self.file = open_file(path)
        self.file.seek(at >> 16)
        self.data, self.place, self.block = b"", 0, at >> 16
        self._more()
        self.place = at & 0xFFFF

    def _more(self) -> bool:
        self.block = self.file.tell()
        head = self.file.read(12)
        if len(head) < 12:
            self.data, self.place = b"", 0
            return False
        extra = self.file.read(struct.unpack("<H", head[10:12])[0])
        size = block_size(head + extra)
        if not size:
            raise ValueError(f"no block at byte {self.block}")
        body = self.file.read(size - 12 - len(extra))
        self.data, self.place = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte: behind a used-up block it is the begin of the next one that holds any."""
        while self.place >= len(self.data) and self._more():
            pass
        return self.block << 16 | self.place

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.place >= len(self.data) and not self._more():
                break
            part = self.data[self.place : self.place + n - len(out)]
            self.place += len(part)
            out += part
        return out


def first_record(path: str, block: int, chroms: list[tuple[str, int]]) -> int | None:
    """The virtual offset of the first record that begins in this block or after it; None where there is none.

    A place counts where it and ``CHAIN`` records after it, or all up to the file's end, have possible sizes, chromosomes, places and names.
    """
    blocks = Blocks(path, block << 16)
    lengths = np.array([n for _, n in chroms] + [0], np.int64)
    data, bounds, ended = bytearray(), [], False  # bounds: (first byte in data, block)

    def more() -> None:
        nonlocal ended
        while blocks.place >= len(blocks.data) and not ended:
            ended = not blocks._more()
        if not ended:
            bounds.append((len(data), blocks.block))
            data.extend(blocks.data)
            blocks.place = len(blocks.data)

    def chained(at: int) -> bool | None:
        """Whether records follow each other from here; None: more bytes are needed."""
        for _ in range(CHAIN):
            if at == len(data) and ended:
                return True
            if at + 36 > len(data):
                return False if ended else None
            size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack_from(RECORD, data, at)
            if not (-1 <= ref < len(chroms) and -1 <= mate < len(chroms) and -1 <= pos <= lengths[ref] and -1 <= mate_pos <= lengths[mate] and n_name > 0 and n_seq >= 0):
                return False
            if size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
                return False
            if at + 36 + n_name > len(data):
                return False if ended else None
            name = data[at + 36 : at + 36 + n_name]
            if name[-1] or not all(0x21 <= c <= 0x7E for c in name[:-1]):
                return False
            at += 4 + size
        return True

    at = 0
    more()
    while True:
        found = chained(at)
        while found is None:
            more()
            found = chained(at)
        if at >= len(data):
            if ended:
                return None
            more()
            continue
        if found:
            base, own = max(x for x in bounds if x[0] <= at)
            return own << 16 | at - base
        at += 1


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the reference sequences."""
    magic, n = struct.unpack("<4si", blocks.read(8))
    if magic != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(n)
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


#: Fixed values of the format: the fields at the head of a record, the levels of an index's bins (first number, bits of a position left out), its
#: windows' bits, and the bin that holds no records.
HEAD = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
BINS, WINDOW_BITS, NO_RECORDS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)), 14, 37450
MOVES = np.array([op in "MDN=X" for op in CIGAR_OPS] + [False] * 7)
_TWO = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)


def _text(data: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    """Strings of these sizes from their bytes."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), found)


def decode_records(records: list[bytes], names: list[str], shape: pa.Schema) -> pa.RecordBatch:
    """Records as a batch of ``schemas.ALIGNMENTS``."""
    n = len(records)
    h = np.frombuffer(b"".join(r[:32] for r in records), HEAD)
    number = {c: h[c].astype(np.int64) for c in HEAD.names}
    ops_at = 32 + number["n_name"]
    seq_at = ops_at + 4 * number["n_ops"]
    packed = (number["n_seq"] + 1) // 2
    parts = [(r[32 : a - 1], r[a:b], r[b : b + k], r[b + k : b + k + m]) for r, a, b, k, m in zip(records, ops_at.tolist(), seq_at.tolist(), packed.tolist(), h["n_seq"].tolist(), strict=True)]
    joined = [np.frombuffer(b"".join(p[i] for p in parts), np.uint8) for i in range(4)]
    qname = _text(joined[0], number["n_name"] - 1, np.array([p[0] == b"*" for p in parts], bool))
    ops = joined[1].view("<u4").astype(np.int64)
    of = np.repeat(np.arange(n), number["n_ops"])
    span = np.bincount(of, np.where(MOVES[ops & 15], ops >> 4, 0), n).astype(np.int64)
    codes = pa.DictionaryArray.from_arrays(pa.array((ops & 15).astype(np.int8)), pa.array(list(CIGAR_OPS))).cast(pa.string())
    cigar = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number["n_ops"])), pa.int32()), pa.StructArray.from_arrays([codes, pa.array(ops >> 4, pa.int32())], ["op", "len"]))
    # two bases a byte; the last half byte of an odd number is none
    keep = np.ones(2 * len(joined[2]), bool)
    odd = number["n_seq"] % 2 == 1
    keep[2 * np.cumsum(packed)[odd] - 1] = False
    none = number["n_seq"] == 0
    seq = _text(_TWO[joined[2]].ravel()[keep], number["n_seq"], none)
    first = np.append(joined[3], 0)[np.cumsum(number["n_seq"]) - number["n_seq"]]
    qual = _text(np.where(joined[3] == 0xFF, 33, joined[3] + 33).astype(np.uint8), number["n_seq"], none | (first == 0xFF))
    # number -1 is no chromosome
    chrom = lambda i: pa.array(np.array([*names, None], object)[i], pa.string())
    where = lambda x, null: pa.array(x, mask=null)
    pos, mate_pos = number["pos"] + 1, number["mate_pos"] + 1
    columns = [
        qname, pa.array(number["flag"]), where(number["ref"], number["ref"] < 0), chrom(number["ref"]), where(pos, pos < 1), where(pos + np.maximum(span, 1) - 1, pos < 1), where(number["mapq"], number["mapq"] == 255), cigar,
        where(number["mate_ref"], number["mate_ref"] < 0), chrom(number["mate_ref"]), where(mate_pos, mate_pos < 1), pa.array(number["tlen"]), seq, qual,
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """For each reference of a ``.bai`` file its bins' chunks (virtual offsets between which records lie) and the first offset of each window."""
    with open_file(path) as f:
        data = f.read()
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        many = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(many):
            number, n = struct.unpack_from("<Ii", data, at)
            at += 8
            if number != NO_RECORDS:
                bins[number] = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(n)]
            at += 16 * n
        windows = struct.unpack_from("<i", data, at)[0]
        out.append((bins, list(struct.unpack_from(f"<{windows}Q", data, at + 4))))
        at += 4 + 8 * windows
    return out


def region_spans(bins: dict[int, list[tuple[int, int]]], windows: list[int], first: int | None = None, last: int | None = None) -> list[tuple[int, int]]:
    """Spans of virtual offsets, none twice, that hold all records which meet positions first to last (None: to the end)."""
    low, high = max((first or 1) - 1, 0), (last - 1 if last is not None else (1 << 29) - 1)
    if high < low:
        return []
    wanted = [c for number, chunks in bins.items() for c in chunks if any(base + (low >> bits) <= number <= base + (high >> bits) for base, bits in BINS if base <= number < base + (1 << 29 - bits))]
    least = windows[min(low >> WINDOW_BITS, len(windows) - 1)] if windows else 0
    out: list[tuple[int, int]] = []
    for begin, end in sorted(c for c in wanted if c[1] > least):
        if out and begin <= out[-1][1]:
            begin = max(begin, out[-1][1])
            if (begin >> 16) - (out[-1][0] >> 16) < SPAN_BYTES:
                out[-1] = out[-1][0], max(end, out[-1][1])
                continue
        if begin < end:
            out.append((begin, end))
    return out


class Span(InputPartition):
    """Records of a file between two virtual offsets; ``begin`` None: from the first that begins in a block from byte ``low`` on."""

    def __init__(self, path: str, begin: int | None, end: int | None, low: int = 0):
        self.path, self.begin, self.end, self.low = path, begin, end, low


def byte_spans(path: str, begin: int, step: int) -> list[Span]:
    """The rest of a file, from a virtual offset at which a record begins, in ranges of bytes."""
    size, low = size_of(path), begin >> 16
    edges = [*range(low, size, step)][1:]
    ends = [e << 16 for e in edges] + [None]
    return [Span(path, begin, ends[0])] + [Span(path, None, end, e) for e, end in zip(edges, ends[1:], strict=True)]


class BamReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.header_only = options.get("mode") == "header"
        self.step = int(options.get("span", SPAN_BYTES))
        self.chroms: set[str] | None = None
        self.first: int | None = None
        self.last: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chroms = {f.value} if self.chroms is None else self.chroms & {f.value}
            elif f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute in (("pos",), ("end_pos",)):
                # a record from the bound on, or up to it, meets the positions from there on, or up to there
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.first = max(self.first or 1, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    bound = f.value - isinstance(f, LessThan)
                    self.last = bound if self.last is None else min(self.last, bound)
            yield f  # Spark checks it again

    def partitions(self):
        if self.header_only:
            return [Span(p, None, None) for p in files_of(self.path, ".bam")[:1]]
        return [s for p in files_of(self.path, ".bam") for s in self._spans(p)]

    def _spans(self, path: str) -> list[Span]:
        blocks = Blocks(path)
        names, start = [n for n, _ in read_header(blocks)], blocks.tell()
        index = next((p for p in (f"{path}.bai", path.removesuffix(".bam") + ".bai") if size_of(p) is not None), None)
        if index is None:
            return byte_spans(path, start, self.step)
        held = list(zip(names, read_index(index), strict=True))
        spans = [Span(path, *s) for n, own in held if self.chroms is None or n in self.chroms for s in region_spans(*own, self.first, self.last)]
        if self.chroms is None and self.first is None and self.last is None:  # records without a place come last
            ends = [c[1] for _, (bins, _) in held for chunks in bins.values() for c in chunks]
            spans += byte_spans(path, max(ends, default=start), self.step)
        return spans

    def read(self, span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if span is None:  # no span meets the region
            return
        shape = to_arrow_schema(self.schema)
        header = read_header(Blocks(span.path))
        if self.header_only:
            rows = [(i, n, size) for i, (n, size) in enumerate(header)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
            return
        names, begin = [n for n, _ in header], span.begin
        if begin is None:
            size = size_of(span.path)
            block = first_block(open_file(span.path), span.low, size)
            begin = first_record(span.path, block, header) if block < size else None
            if begin is None or (span.end is not None and begin >= span.end):  # no record begins in this range
                return
        blocks = Blocks(span.path, begin)
        records: list[bytes] = []
        while span.end is None or blocks.tell() < span.end:
            size = blocks.read(4)
            if len(size) < 4:
                break
            records.append(blocks.read(struct.unpack("<i", size)[0]))
            if len(records) >= BATCH:
                yield decode_records(records, names, shape)
                records = []
        if records:
            yield decode_records(records, names, shape)


class BamSource(DataSource):
    """``format("bam")``: records, or with ``mode=header`` the reference dictionary."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return schemas.CHROMOSOMES if self.options.get("mode") == "header" else schemas.ALIGNMENTS

    def reader(self, schema):
        return BamReader(self.options, schema)


#: A batch of FASTQ records has up to so many characters, or is one record.
FASTQ_BYTES = 1 << 20


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [Span(p, None, None) for p in files_of(self.path)]

    def read(self, span) -> Iterator[pa.RecordBatch]:
        raw = open_file(span.path)
        names, columns, held = ["id", "seq", "qual"], ([], [], []), 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

        with io.TextIOWrapper(gzip.open(raw) if span.path.endswith(".gz") else raw) as f:
            while head := f.readline():
                seq, plus, qual = (f.readline().rstrip("\n") for _ in range(3))
                if head[0] != "@" or plus[:1] != "+":
                    raise ValueError("not a FASTQ record")
                for c, x in zip(columns, (head[1:].rstrip("\n").split(" ")[0], seq, qual), strict=True):
                    c.append(x)
                held += len(seq) + len(qual)
                if len(columns[0]) >= BATCH or held >= FASTQ_BYTES:
                    yield batch()
                    columns, held = ([], [], []), 0
        if columns[0]:
            yield batch()


class FastqSource(DataSource):
    """``format("fastq")``: records of four lines; each file is a partition."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return schemas.READS

    def reader(self, schema):
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    spark.dataSource.register(FastqSource)
