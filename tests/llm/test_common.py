from scriptmill.llm import common


def test_scratch_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "scratch_root", lambda s: f"file://{tmp_path}")
    df = common.materialize(spark.range(5))
    assert df.count() == 5 and common.clear_scratch(spark)
    assert not list(tmp_path.glob("scratch-*")) and not common.clear_scratch(spark)


def test_tables_of_other_owners_are_released():
    released = []
    common.hold("a", lambda: released.append("a"))
    common.hold("a", lambda: released.append("a"))
    assert released == []
    common.hold("b")
    assert released == ["a"]
    common.hold("a")
    assert released == ["a"]


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    docs = common.short_batches(spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 1000000) as text"))
    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 60 and max(r.bytes for r in got) <= common.BATCH_BYTES + 2_000_000
