import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptmill import __main__ as cli
from scriptmill.api import Deobfuscator
from scriptmill.kernel.fixpoint import Rule
from scriptmill.kernel.tree import Node, string
from scriptmill.operators.rewrite import rewrite_scripts, rewritten, statistics
from scriptmill.plans import analysis, catalogue
from scriptmill.sources import facts, scripts
from scriptmill.streaming import scripts as streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_equal_sql(spark, name):
    import duckdb

    got = catalogue.QUERIES[name](spark, SF)
    rows = sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=repr)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.execute(f"create view result as {catalogue.SQL[name]}")
    columns = [c[0] for c in con.execute("describe result").fetchall()]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(con.execute("select " + ", ".join(f'"{c}"' for c in sorted(columns)) + " from result").fetchall(), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rewriting_is_independent_of_partitions(spark):
    class Hush(Rule):  # pickled by value, as a rule from a notebook would be
        name = "Hush"
        interests = ("String",)

        def enter_expression(self, x: Node):
            return string("") if x.value else None

    rows = [(i, f"var a{i % 7} = {i}; f(a{i % 7}, 'x' + {i});") for i in range(60)] + [(99, None), (100, ""), (101, "var = 1")]
    df = spark.createDataFrame(rows, "id long, source string")
    one = {r.id: r.code for r in rewrite_scripts(df.coalesce(1)).collect()}
    many = {r.id: r.code for r in rewrite_scripts(df, parts=7).collect()}
    assert one == many and one[5] == 'f(5, "x" + 5);\n' and one[99] is None and one[101] == "var = 1"
    own = Deobfuscator.empty().add_transformer(Hush).transform(df.where("id = 1")).head()
    assert own.code == "var a1 = 1;\nf(a1, \"\" + 1);\n" and own.diagnostics.stats[0].modifications == 1
    stats = {r.name: r.modifications for r in statistics(rewrite_scripts(df)).collect()}
    assert stats["ConstantInlining"] == 120 and stats["VariableRenaming"] == 0
    with pytest.raises(ValueError):
        rewritten("source", "none")


def test_facts(spark):
    df = spark.createDataFrame([(1, "var a = 1, b = a; function f(p) { let c = p; c++; return window; } f(b); var a;"), (2, "not a script ("), (3, None)], "script_id long, source string")
    s = {(r.script_id, r.name): r for r in facts.symbols(df).collect()}
    assert set(s) == {(1, n) for n in "abfpc"}
    assert (s[1, "a"].n_redeclared, s[1, "a"].n_references, s[1, "c"].n_writes) == (1, 1, 1)
    refs = sorted((r.name, r.symbol_id is not None, r.is_write) for r in facts.references(df).collect())
    assert refs == [("a", True, False), ("b", True, False), ("c", True, True), ("f", True, False), ("p", True, False), ("window", False, False)]
    stats = {r.name: (r.refs, r.writes) for r in analysis.symbol_stats(facts.symbols(df), facts.references(df)).collect()}
    assert stats == {"a": (1, 0), "b": (1, 0), "f": (1, 0), "p": (1, 0), "c": (1, 1)}
    assert facts.scopes(df).count() == 2
    constants = analysis.inlinable_constants(facts.nodes(df), facts.symbols(df))
    assert constants.count() == 0  # a is declared twice
    fine = spark.createDataFrame([(1, "var a = 'x'; f(a); g(a); var b = 2; b = 3;")], "script_id long, source string")
    assert sorted((r.name, r.literal) for r in analysis.inlinable_constants(facts.nodes(fine), facts.symbols(fine)).collect()) == [("a", "x"), ("a", "x")]


def test_all_facts_from_one_pass(spark):
    df = spark.createDataFrame([("a", "var a = 1, b = a; function f(p) { let c = p; c++; return window; } f(b);"), ("b", "not a script ("), ("c", None), ("d", "")], "page string, js string")
    known = facts.every(df, "page", "js")
    for name in ("nodes", "symbols", "references", "scopes"):
        want = getattr(facts, name)(df, "page", "js")
        got = getattr(known, name)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert facts.every(df.limit(0), "page", "js").nodes.count() == 0


def test_sources_sinks_and_streams(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.js").write_text("f(1+1)\n// é")
    (tmp_path / "in" / "sub" / "b.js").write_text("g(2)")
    (tmp_path / "in" / "c.txt").write_text("no")
    files = scripts.from_files(spark, str(tmp_path / "in"))
    assert sorted(r.code for r in rewrite_scripts(files).collect()) == ["f(2);\n", "g(2);\n"]
    page = "<SCRIPT>a()</SCRIPT><script src='x'></script><script type='m'>\nb()\n</script >"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r.ordinal, r.source) for r in scripts.from_pages(pages).collect()] == [(0, "a()"), (1, "\nb()\n")]
    many = rewrite_scripts(scripts.from_texts(spark, ["if (a) b(); c('\\u2028');", "d(1 + 1);", ""]))
    scripts.to_files(many.repartition(2), str(tmp_path / "lines"), key="script_id")
    assert {r.script_id: r.source for r in scripts.from_lines(spark, str(tmp_path / "lines"), "long").collect()} == {r.script_id: r.code for r in many.collect()}
    scripts.to_table(rewrite_scripts(scripts.from_texts(spark, ["h(3*3)"])), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).head().code == "h(9);\n"
    spark.createDataFrame([(i, f"f({i} + 1)") for i in range(5)], "script_id long, source string").repartition(3).write.parquet(str(tmp_path / "stream"))
    stream = streams.read(spark, str(tmp_path / "stream"), "script_id long, source string", 1)
    for _ in range(2):  # the second run finds nothing new
        streams.rewrite_stream(stream, str(tmp_path / "rewritten"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.code for r in spark.read.parquet(str(tmp_path / "rewritten")).collect()) == [f"f({i + 1});\n" for i in range(5)]


def test_sql_surface(spark):
    facts.register(spark)
    assert spark.sql("select js_deobfuscate('f(1 + 2)', 'generic') as c").head().c == "f(3);\n"
    assert spark.sql("select count(*) as n from js_nodes('a + b')").head().n == 5
    assert spark.sql("select count(*) as n from js_references('a + b')").head().n == 2


def test_command_line(tmp_path, capsys, monkeypatch):
    (tmp_path / "a.js").write_text("f(1 + 1);")
    assert cli.main([str(tmp_path / "a.js"), "-o", str(tmp_path / "b.js"), "--diagnostics"]) == 0
    assert (tmp_path / "b.js").read_text() == "f(2);\n" and "ConstantFolding: 1 modifications" in capsys.readouterr().err
    monkeypatch.setattr(sys, "stdin", open(tmp_path / "a.js"))
    assert cli.main(["-", "--presets", "jsfuck,debundler", "--max-iterations", "3"]) == 0 and capsys.readouterr().out == "f(2);\n"
    assert cli.main([str(tmp_path / "none.js")]) == 1 and cli.main([str(tmp_path / "a.js"), "--presets", "x"]) == 1


def test_relations(spark):
    s = spark.createDataFrame([(1, 1, "X", None), (1, 2, "Return", None), (1, 3, "V", "var"), (1, 4, "V", "let"), (1, 5, "FunctionDeclaration", None), (2, 1, "X", None)], "list_id int, ordinal int, kind string, word string")
    assert sorted((r.list_id, r.ordinal) for r in analysis.reachable_statements(s).collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 1)]
    a = spark.createDataFrame([(1, [3, 1, 2], 14), (2, [1, 1], 7), (3, [], 0)], "array_id int, numbers array<bigint>, target bigint")
    assert {r.array_id: r.rotation for r in analysis.solve_rotation(a).collect()} == {1: 1, 2: None, 3: None}
    assert spark.range(1).select(analysis.table_hash(F.lit(93).cast("long"), F.lit(127).cast("long"), 2, (421, 619, 2, 199)).alias("v")).head().v == 22
