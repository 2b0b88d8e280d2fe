"""Coded blocks, checksums of joined parts, and files of ids against the tokenizers library."""

import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelocus.llm import crc, mixing, queries, token_files

from .test_llm import PATH


def test_blocks():
    rng = np.random.default_rng(3)
    for bits in (1, 4, 16, 20):
        blocks = [rng.integers(0, 2**bits, n) for n in (0, 1, 2, 63, 700, 64)]
        blocks += [np.full(mixing.BLOCK, 2**bits - 1), np.minimum(rng.zipf(1.4, 3000), 2**bits - 1), np.tile(rng.integers(0, 2**bits, 9), 300)]
        coded = mixing.encode_blocks(blocks, bits)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, mixing.decode_blocks(coded), strict=True))
        # blocks don't depend on what is coded beside them
        assert [mixing.encode_blocks([b], bits)[0] for b in blocks] == coded
        assert len(coded[6]) < 200 and (bits < 16 or len(coded[8]) < len(blocks[8]) / 2)
    assert mixing.encode_blocks([], 16) == [] == mixing.decode_blocks([])
    with pytest.raises(ValueError, match="vocabulary"):
        mixing.encode_blocks([np.array([16])], 4)
    bad = bytearray(mixing.encode_blocks([np.arange(500)], 16)[0])
    bad[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        mixing.decode_blocks([bytes(bad)])
    with pytest.raises(ValueError, match="blocks"):
        mixing.decode_blocks([b"short"])


def test_shift():
    rng = np.random.default_rng(4)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 5000, (50, 2))]
    got = crc.shift([zlib.crc32(a) for a, _ in parts], [len(b) for _, b in parts])
    assert [int(x) ^ zlib.crc32(b) for x, (_, b) in zip(got, parts, strict=True)] == [zlib.crc32(a + b) for a, b in parts]


def wanted(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("lanes", [1, 2048])
def test_files(spark, texts, tmp_path, monkeypatch, lanes):
    """Documents of many blocks and blocks of many documents, in shuffled order, in several files."""
    monkeypatch.setattr(token_files, "LANES", lanes)
    rows = [*texts, (1000, "one two # three " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy("text").repartition(3)
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, PATH, 2, files=3)
    assert spark.read.parquet(path).select("file").distinct().count() == 3
    want = wanted(rows)
    got = token_files.add_starts(token_files.read_ids(spark, path), spark, path).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in got) == [(i, at, ids) for i, at, _, _, ids in want]
    got = token_files.add_starts(token_files.checksums(spark, path), spark, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == [w[:4] for w in want]


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, file int, start long")
    token_files.write_ids(empty, str(tmp_path / "none"), PATH, 2)
    assert token_files.add_starts(token_files.checksums(spark, str(tmp_path / "none")), spark, str(tmp_path / "none")).collect() == []
    rows = [(None, "a", 9), (None, None, 9), (4, "b", 9), (4, "b", 9), (4, "cc", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int")
    token_files.write_ids(docs, str(tmp_path / "ties"), PATH, 2, files=2)
    got = token_files.add_starts(token_files.checksums(spark, str(tmp_path / "ties")), spark, str(tmp_path / "ties")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 4, 4, 4] and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()


def test_query(spark):
    where = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op13_token_files(spark, where).collect()
    assert sorted(map(tuple, got)) == [w[:4] for w in wanted(rows)]
