"""A CIGAR is walked once, not once for each of its operations."""

from pyspark.sql import functions as F
from tidelocus.operators import reads


def test_one_walk(spark):
    df = spark.createDataFrame([(10, "2H3S4M5D6I7=8N9X1P2S"), (None, "3M"), (4, "")], "pos long, text string")
    ops = reads.cigar_operations(df.select("pos", reads.parse_cigar(F.col("text")).alias("cigar")))
    assert "slice(" not in ops._jdf.queryExecution().optimizedPlan().toString()
    places = [(10, 0, "H"), (10, 0, "S"), (10, 3, "M"), (14, 7, "D"), (19, 7, "I"), (19, 13, "="), (26, 20, "N"), (34, 20, "X"), (43, 29, "P"), (43, 29, "S")]
    assert [(r.i, r.p, r.q, r.op) for r in ops.collect()] == [(i, *x) for i, x in enumerate(places)]
    assert ops.columns == ["pos", "cigar", "i", "p", "q", "op", "len"]
