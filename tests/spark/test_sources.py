import json
import os
import time

import pytest
from pyspark.sql import functions as F

from scriptmill.sources import bundles
from scriptmill.sources import datasource as ds


@pytest.fixture
def folder(spark, tmp_path):
    ds.register(spark)
    root = tmp_path / "in"
    for i, (name, text) in enumerate([("a.js", "f(1)"), ("sub/b.js", "g('é')"), ("sub/c.js", "h(" + "1, " * 500 + "2)"), ("d.txt", "no"), ("_hidden/e.js", "no"), ("empty.js", "")]):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
        os.utime(root / name, (1_700_000_000 + i, 1_700_000_000 + i))
    return root


def test_reading_with_conditions(spark, folder):
    read = spark.read.format("scripts").option("path", str(folder))
    df = read.load()
    assert {r.path: r.source for r in df.collect()} == {"a.js": "f(1)", "sub/b.js": "g('é')", "sub/c.js": (folder / "sub/c.js").read_text(), "empty.js": ""}
    assert sorted(r.path for r in df.where("path like 'sub/%' and size > 100").collect()) == ["sub/c.js"]
    assert sorted(r.path for r in df.where("path in ('a.js', 'x') or source = ''").collect()) == ["a.js", "empty.js"]
    assert df.where(F.col("modified") > F.lit("2023-11-14 22:13:21").cast("timestamp")).count() + df.where(F.col("modified") <= F.lit("2023-11-14 22:13:21").cast("timestamp")).count() == 4
    assert df.count() == 4  # a frame gives the same whatever it was asked before
    some = lambda **o: sorted(r.path for r in spark.read.format("scripts").options(**o).load(str(folder)).collect())
    assert some(prefix="sub/", minSize=100) == ["sub/c.js"] and some(maxSize=7) == ["a.js", "empty.js", "sub/b.js"]
    at = df.where("path = 'sub/b.js'").head().modified.isoformat()
    assert some(modifiedAfter=at) == ["empty.js", "sub/c.js"] and some(modifiedBefore=at) == ["a.js"]
    pushed = lambda: spark.read.format("scripts").option("pushdown", "true").load(str(folder))
    assert sorted(r.path for r in pushed().where("path like 'sub/%' and size > 100 and source <> ''").collect()) == ["sub/c.js"]
    assert sorted(r.path for r in pushed().where("path in ('a.js', 'x') or source = ''").collect()) == ["a.js", "empty.js"]
    assert spark.read.format("scripts").option("path", str(folder)).option("bytesPerTask", 10).load().rdd.getNumPartitions() == 4
    assert spark.read.format("scripts").option("suffix", ".txt").load(f"file://{folder}").head().source == "no"
    assert spark.read.format("scripts").load(str(folder / "none")).count() == 0


def test_conditions_choose_files_before_any_is_opened(folder):
    reader = ds.PushedReader({"path": str(folder)})
    pushed = [ds.StringStartsWith(("path",), "sub/"), ds.Not(ds.EqualTo(("size",), 7)), ds.EqualTo(("source",), "x"), ds.EqualTo(("path",), None)]
    assert list(reader.pushFilters(pushed)) == pushed[2:]
    assert [[f.path for f in p.files] for p in reader.partitions()] == [["sub/c.js"]]
    assert [len(p.files) for p in ds.grouped([ds.File(str(i), 3000, 0) for i in range(10)], 13_000)] == [3, 3, 3, 1]


def test_a_stream_gives_each_file_once(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("scripts").option("path", str(folder)).option("filesPerBatch", 2).load()
        q = stream.select("path", "source").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(processingTime="100 milliseconds").start()
        try:
            until = time.time() + 60
            want = len(ds.Folder(str(folder)).files(".js"))
            while time.time() < until and (not (tmp_path / "out").exists() or not list((tmp_path / "out").glob("*.parquet")) or spark.read.schema("path string, source string").parquet(str(tmp_path / "out")).count() < want):
                time.sleep(0.3)
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.js", "empty.js", "sub/b.js", "sub/c.js"]
    (folder / "new.js").write_text("n()")
    assert run() == ["a.js", "empty.js", "new.js", "sub/b.js", "sub/c.js"]  # after a restart only the new one


def test_writing_is_committed_in_two_steps(spark, folder, tmp_path):
    out = tmp_path / "out"
    df = spark.createDataFrame([(f"x{i % 3}/s{i}.js", f"f({i})") for i in range(20)], "path string, source string").repartition(4)
    df.write.format("scripts").mode("append").option("path", str(out)).save()
    there = lambda: sorted(str(p.relative_to(out)) for p in out.rglob("*.js"))
    assert there() == sorted(r.path for r in df.collect()) and (out / "x1/s1.js").read_text() == "f(1)"
    assert len(json.loads((out / ds.COMMITTED).read_text())) == 20 and not list(out.glob("_staging*"))
    # A task that fails leaves nothing, and what was there stays.
    bad = df.withColumn("source", F.when(F.col("path") == "x2/s11.js", None).otherwise("new"))
    with pytest.raises(Exception, match="without path or source"):
        bad.write.format("scripts").mode("append").option("path", str(out)).save()
    with pytest.raises(Exception, match="two rows"):
        df.unionByName(df.limit(1)).write.format("scripts").mode("append").option("path", str(out)).save()
    with pytest.raises(Exception, match="no path below"):
        df.limit(1).withColumn("path", F.lit("../x.js")).write.format("scripts").mode("append").option("path", str(out)).save()
    assert there() == sorted(r.path for r in df.collect()) and (out / "x1/s1.js").read_text() == "f(1)" and not list(out.glob("_staging*"))
    df.limit(2).withColumn("source", F.lit("z")).write.format("scripts").mode("overwrite").option("path", str(out)).save()
    assert len(there()) == 2 and {(out / p).read_text() for p in there()} == {"z"}


def test_attempts_that_are_not_committed_are_not_moved(tmp_path):
    w = ds.ScriptWriter({"path": str(tmp_path)}, ["path", "source"], False)
    first, again = (w.write(iter([{"path": "a.js", "source": s}])) for s in ("first attempt", "second attempt"))
    w.commit([again, None])
    assert (tmp_path / "a.js").read_text() == "second attempt" and sorted(os.listdir(tmp_path)) == [ds.COMMITTED, "a.js"]
    assert first.staged != again.staged


def test_names_over_the_scripts_of_a_page(spark):
    rows = [("p", 0, "var a = 1; f(a, b); b = 2;"), ("p", 1, "let b; function f() { return c; }"), ("p", 2, "var b; not a script ("), ("p", 3, None), ("q", 0, "f(a)"), (None, 0, "z()"), (None, 1, "function z() {}")]
    got = bundles.bundled(spark.createDataFrame(rows, "site string, part int, js string").repartition(3), "site", "part", "js")
    assert got.columns == ["site", "part", "name", "declared_in", "uses"] and dict(got.dtypes)["declared_in"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("p", 0, "f", 1, 1), ("p", 0, "b", 1, 2), ("p", 1, "c", None, 1), ("q", 0, "f", None, 1), ("q", 0, "a", None, 1), (None, 0, "z", 1, 1)], key=repr)
    assert bundles.bundled(spark.createDataFrame([], "page_id int, ordinal int, source string")).count() == 0
    with pytest.raises(Exception, match="holds no text"):
        bundles.bundled(spark.createDataFrame([(1, 2, 3)], "page_id int, ordinal int, source int")).collect()
