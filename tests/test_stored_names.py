"""An index lists its chromosomes, so that what asks for others is dropped before the shuffle."""

from tidelocus.operators import stored


def _index(spark, path, names):
    rows = spark.createDataFrame([(n, 1, 9) for n in names], "chrom string, r_first long, r_last long")
    stored.store_index(rows, path, buckets=3)
    return stored.open_index(spark, path)


def _shuffled(df):
    """Rows that the plan's shuffles wrote."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while todo:
        node = todo.pop()
        if "Exchange" in node.nodeName() and "Broadcast" not in node.nodeName():
            out += node.metrics().apply("shuffleRecordsWritten").value()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_unknown_chromosomes_are_not_shuffled(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k, names in enumerate((["c1", "c2"], ["c1"])):
            own = _index(spark, str(tmp_path / f"index{k}"), names)
            left = spark.range(1000).selectExpr("concat('c', id) as chrom", "5L as first", "6L as last")
            found = stored.indexed_overlap(left, own)
            assert sorted(r.chrom for r in found.collect()) == names
            assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # before and after adapting: one
            assert _shuffled(found) == len(names)
            own.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_chromosomes_are_not_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "NAMES", 2)
    own = _index(spark, str(tmp_path / "many"), ["a", "b", "c"])
    assert own.names is None
    left = spark.createDataFrame([("a", 3, 3), ("z", 3, 3)], "chrom string, first long, last long")
    assert [r.chrom for r in stored.indexed_overlap(left, own).collect()] == ["a"]
    own.close()
