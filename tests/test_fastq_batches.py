"""FASTQ records leave the reader in batches of bounded size, however long they are."""

import pyarrow as pa

from tidelocus.sources import binary


def test_batches_are_bounded(tmp_path):
    path = tmp_path / "long.fastq"
    rows = [(f"r{k}", "ACGT" * (25_000 * (k % 3)) + "A", "F" * (100_000 * (k % 3)) + "F") for k in range(60)]
    path.write_text("".join(f"@{a} more\n{b}\n+\n{c}\n" for a, b, c in rows))
    reader = binary.FastqReader({"path": str(path)})
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    assert all(isinstance(b, pa.RecordBatch) and b.nbytes < 2 << 20 for b in batches) and len(batches) > 5
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
    path.write_text("")
    assert [b for s in reader.partitions() for b in reader.read(s)] == []
