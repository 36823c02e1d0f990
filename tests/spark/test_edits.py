from pyspark.sql import functions as F

from scriptmill.plans import edits
from scriptmill.session import written
from scriptmill.sources import facts, spans


def setup(spark, sources):
    scripts = spark.createDataFrame(list(enumerate(sources)), "script_id int, source string")
    return scripts, written(facts.nodes(scripts)), written(spans.spans(scripts)), facts.symbols(scripts)


def test_spans_are_what_stands_in_the_source(spark):
    sources = ["var é = 1; f(é + 'ü', (2)) ;  if (a) { b(-c); } // end", "let {x, y: z} = o; g(x);", "not a script (", None, "for (const i of [1, , 2]) i++"]
    scripts, nodes, at, _ = setup(spark, sources)
    text = F.decode(F.substring(F.encode("source", "UTF-8"), F.col("first") + 1, F.col("last") - F.col("first")), "UTF-8")
    got = nodes.join(at, ["script_id", "node_id"]).join(scripts, "script_id").select("script_id", "kind", text.alias("t")).collect()
    seen = {(r.script_id, r.kind, r.t) for r in got}
    assert {(0, "VariableDeclaration", "var é = 1;"), (0, "Identifier", "é"), (0, "Binary", "é + 'ü'"), (0, "String", "'ü'"), (0, "Number", "1"), (0, "Unary", "-c"), (0, "Block", "{ b(-c); }"), (0, "If", "if (a) { b(-c); }"), (1, "Identifier", "x"), (1, "Identifier", "z"), (4, "Array", "[1, , 2]")} <= seen
    assert {r.script_id for r in got} == {0, 1, 4}


def test_edits(spark):
    sources = ["var é = 1;\n\n/* kept */ f(é); g(h(é), 2); last();", "a(b(c));", "unchanged ( yes", "x = {y}; var y; var {k = 1, m} = y;", "plain();"]
    scripts, nodes, at, symbols = setup(spark, sources)
    by_text = {}
    text = F.decode(F.substring(F.encode("source", "UTF-8"), F.col("first") + 1, F.col("last") - F.col("first")), "UTF-8")
    for r in nodes.join(at, ["script_id", "node_id"]).join(scripts, "script_id").select("script_id", "node_id", text.alias("t")).orderBy("node_id").collect():
        by_text.setdefault((r.script_id, r.t), r.node_id)
    rows = [
        (0, by_text[0, "f(é);"], 1, "before", ["one();", "two();"]),
        (0, by_text[0, "g(h(é), 2);"], 1, "replace", ["g2();", "g3();"]),
        (0, by_text[0, "h(é)"], 2, "remove", []),  # within what is replaced
        (0, by_text[0, "last();"], 3, "remove", []),
        (0, by_text[0, "last();"], 4, "replace", ["never"]),  # the first stands
        (0, by_text[0, "last();"], 5, "after", ["after();"]),
        (1, by_text[1, "c"], 1, "replace", ["d", "e"]),
        (1, by_text[1, "a(b(c));"], 2, "after", ["z();"]),
        (4, by_text[4, "plain();"], 1, "replace", []),
    ]
    table = spark.createDataFrame(rows, "script_id int, node_id int, number long, action string, texts array<string>")
    names = symbols.select("script_id", "symbol_id", F.concat(F.lit("new_"), "name").alias("name"))
    got = {r.script_id: r.source for r in edits.apply(scripts, table.unionByName(edits.renames(nodes, at, names)), nodes, at).collect()}
    assert got == {
        0: "var new_é = 1;\n\n/* kept */ one();\ntwo();\nf(new_é); g2();\ng3(); ;\nafter();",
        1: "a(b((d, e)));\nz();", 2: "unchanged ( yes", 3: "x = {y: new_y}; var new_y; var {k: new_k = 1, m: new_m} = new_y;", 4: ";",
    }
    assert {r.script_id: r.source for r in edits.apply(scripts, table.limit(0), nodes, at).collect()} == dict(enumerate(sources))


def test_many_edits_of_one_script(spark):
    n = 5000
    scripts, nodes, at, symbols = setup(spark, ["var name;" + "f(name);" * n])
    names = symbols.select("script_id", "symbol_id", F.lit("é").alias("name"))
    assert edits.apply(scripts, edits.renames(nodes, at, names), nodes, at).head().source == "var é;" + "f(é);" * n
