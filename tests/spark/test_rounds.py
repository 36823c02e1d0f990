"""Plans that work in rounds over facts: against the rewriter's own rules, and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from scriptmill.functions import js, values
from scriptmill.kernel.fixpoint import Rule, rewrite
from scriptmill.kernel.parser import parse
from scriptmill.kernel.presets import PRESETS
from scriptmill.kernel.tree import bare
from scriptmill.kernel.values import format_number
from scriptmill.plans import folding, jumping, liveness, machines, proxies, rotation
from scriptmill.session import BROADCAST_ROWS, counted, written
from scriptmill.sources import facts


def table(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "script_id long, source string")


def folded(spark, sources):
    nodes = written(facts.nodes(table(spark, sources)))
    found = folding.fold(nodes)
    out = {}
    for r in found.values.select("script_id", "node_id", values.text(F.col("value")).alias("t")).orderBy("script_id", "node_id").collect():
        out.setdefault(r.script_id, []).append(r.t)
    return out, found


def test_operators_fold_like_the_rewriter(spark):
    cases = {"1 + 2 * 3 - 4": "3", "(8 % 3 + 1) / 0": "3", "!0 && 2 > 1": "true", "'a' + 'b' + 'c'": "abc", "1 < 2 === true": "true", "~5": "-6", "-(-3)": "3", "'5' - 2": "3", "!!''": "false", "false && x": "false", "true || g(x)": "true", "void 0": "undefined", "2 ** 3 ** 2": "512", "null + 1": "1", "-1 >>> 0": "-1", "1e308 * 10 - 1e308 * 10 == 0": "false", "typeof 1": "number", "+' 12 '": "12", "5 / (3 - 3) * 2": None, "x + (1 + 2)": "3", "x + 1 + 2": None, "typeof (1)": None}
    got, found = folded(spark, [f"f({c});" for c in cases])
    # 5 / 0 isn't known, but its divisor is.
    want = {i: [w] for i, w in enumerate(cases.values()) if w is not None}
    want[list(cases).index("5 / (3 - 3) * 2")] = ["0"]
    assert got == want
    assert found.phases <= 4


def test_random_expressions_fold_like_the_rewriter(spark):
    rng = random.Random(5)

    def tree(depth):
        if depth == 0 or rng.random() < 0.15:
            return rng.choice(["0", "1", "2", "3", "7", "true", "false", "null", "x", "'4'", "'b'", "''"])
        if rng.random() < 0.2:
            return rng.choice(["-", "!", "+"]) + "(" + tree(depth - 1) + ")"
        return "(" + tree(depth - 1) + " " + rng.choice(["+", "-", "*", "/", "%", "<", "<=", "==", "!==", "|", "&", "^", "<<", ">>", ">>>"]) + " " + tree(depth - 1) + ")"

    sources = [f"f({tree(rng.randint(1, 5))});" for _ in range(200)]
    rules = lambda: [type(r)() if isinstance(r, Rule) else r() for r in PRESETS["generic"] if r.name in ("ConstantFolding", "StringConcatenation")]
    wanted = {}
    for i, s in enumerate(sources):
        x = bare(parse(rewrite(s, rules()).code).body[0].expression.arguments[0])
        minus = x.kind == "Unary" and x.op == "-" and x.value.kind == "Number"
        if x.kind in ("Number", "String", "Boolean") or minus:
            v = x.value.value if minus else x.value
            v = "-" + format_number(v) if minus else format_number(v) if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else v
            wanted[i] = v
    nodes = written(facts.nodes(table(spark, sources)))
    top = nodes.where("slot = 'arguments' and kind not in ('Number', 'String', 'Boolean', 'Null', 'Identifier')").select("script_id", "node_id")
    found = folding.fold(nodes).values.join(top, ["script_id", "node_id"], "left_semi").select("script_id", values.text(F.col("value")).alias("t")).collect()
    got = {r.script_id: r.t for r in found}
    tops = {r.script_id for r in top.collect()}
    assert len(got) > 30 and {i: v for i, v in wanted.items() if i in tops} == got


def test_a_chain_takes_as_many_joins_as_its_logarithm(spark):
    n = 10_000
    got, found = folded(spark, ["f(" + " + ".join(f"{i}.1" for i in range(n)) + ");", "f(" + "!" * 501 + "0);"])
    total = 0.1
    for i in range(1, n):
        total += float(f"{i}.1")
    assert float(got[0][0]) == total and got[1] == ["true"]  # in order, to the last bit
    assert found.phases == 1 and found.doublings[0] <= 15
    bushy, found = folded(spark, ["f(" + "(" * 0 + "+".join(f"({i}*{i}-({i}+1)*2)" for i in range(300)) + ");"])
    assert bushy[0] == [str(sum(i * i - (i + 1) * 2 for i in range(300)))] and found.phases <= 4


def test_empty_tables(spark):
    none = table(spark, ["f();"]).limit(0)
    nodes, symbols, references = written(facts.nodes(none)), facts.symbols(none), facts.references(none)
    assert folding.fold(nodes).values.count() == liveness.dead(nodes, symbols, references).units.count() == proxies.resolve(nodes, symbols)[0].count() == 0
    t = spark.createDataFrame([], "machine int, state int, next int")
    assert machines.trace(t, t).count() == machines.owners(t, t.withColumn("rank", F.lit(1))).count() == 0


def test_pointer_doubling(spark):
    links = [(1, i, i + 1) for i in range(50)] + [(2, 1, 2), (2, 2, 3), (2, 3, 1), (2, 9, 1), (3, 5, 6)]
    ends, joins = jumping.furthest(spark.createDataFrame(links, "k int, id int, to int"), "k")
    got = {(r.k, r.id): (r.end, r.distance) for r in ends.where("not looped").collect()}
    assert got == {(1, i): (50, 50 - i) for i in range(50)} | {(3, 5): (6, 1)} and joins <= 8
    assert {(r.k, r.id) for r in ends.where("looped").collect()} == {(2, 1), (2, 2), (2, 3), (2, 9)}


def dead_names(spark, sources):
    scripts = table(spark, sources)
    symbols = written(facts.symbols(scripts))
    found = liveness.dead(written(facts.nodes(scripts)), symbols, facts.references(scripts))
    rows = found.units.join(symbols.select("script_id", "symbol_id", "name"), ["script_id", "symbol_id"]).collect()
    return {(r.script_id, r.name): r.round for r in rows}, found


def test_what_nothing_uses_dies_by_rounds(spark):
    chain = "(function () {" + "".join(f"function f{i}() {{ return f{i - 1}(); }}" for i in range(1, 9)) + "function f0() {} })();"
    sources = [
        chain,
        "(function () { function a() { b(); } function b() { a(); } function c() { c(); } })();",  # circles keep each other
        "function top() {} var x = 1, y = [2, -x], z = g(), w = [1, ['a']]; use(y);",
        "(function () { function a() { function b() { c(); } var k = h(c); } function c() {} return 1; c(); var d = c(); })();",
        "for (var i = 0, j = 1; i < 2;) { i++; } for (var p in q) { } (function (m) { var n = m; })(1);",
    ]
    got, found = dead_names(spark, sources)
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, f"f{i}"): 8 - i for i in range(9)}
    assert {k[1] for k in got if k[0] == 1} == set()
    assert {k[1] for k in got if k[0] == 2} == {"w"}
    assert {k[1] for k in got if k[0] == 3} == {"a", "b", "k", "c", "d"}  # of d the initializer goes first
    assert {k[1] for k in got if k[0] == 4} == {"j"}
    assert len(found.removed) == 9 and found.removed[0] >= 4 and sum(found.released) >= 8


def test_dead_symbols_are_those_that_the_rewriter_removes(spark):
    rng = random.Random(3)
    sources = []
    for _ in range(40):
        names = [f"n{i}" for i in range(8)]
        parts = []
        for i, n in enumerate(names):
            used = rng.sample(names, rng.randint(0, 2))
            parts.append(f"function {n}() {{ {''.join(f'{u}();' for u in used if u != n)} }}" if rng.random() < 0.7 else f"var {n} = {rng.choice(['1', '[2]', 'g()', '-3'])};")
        sources.append("(function () {" + " ".join(parts) + f" {rng.choice(names)}(); }})();")
    got, _ = dead_names(spark, sources)
    rule = next(r for r in PRESETS["generic"] if r.name == "UnusedVariable")
    for i, s in enumerate(sources):
        code = rewrite(s, [type(rule)() if isinstance(rule, Rule) else rule()]).code
        gone = {f"n{j}" for j in range(8) if f"function n{j}(" not in code and f"var n{j} " not in code}
        assert {n for k, n in got if k == i} == gone, s


def test_proxies_of_proxies(spark):
    deep = "function f0(a, b) { return a - b; }" + "".join(f"function f{i}(a, b) {{ return f{i - 1}(b, a); }}" for i in range(1, 1001))
    sources = [
        deep,
        "function i(a, b) { return ((b)); } function j(p, q, r) { return i(r, p); } function c(f, x) { return f(x); } function d(g, y) { return c(g, y); } function e(g, y) { return c(y, g); } function n(a) { return out(a); } function m(a) { return n(a); }",
        "function a(x) { return b(x); } function b(x) { return a(x); } function c(x) { return b(x); } function w(x) { return w2(x, x); } function w2(p, q, r) { return p; } function s(a, b) { return t(a, b); } function t(a, b) { return a * a; }",
        "async function a(x) { return x; } function* g(x) { return x; } function r(...x) { return x; } function k(x) { return x + 1; } function z(x) { return x; } z = 1; function two(x) { f(); return x; }",
    ]
    scripts = table(spark, sources)
    found, joins = proxies.resolve(written(facts.nodes(scripts)), facts.symbols(scripts))
    got = {(r.script_id, r.name): (r.shape, r.op, r.places, r.hops, r.inlinable) for r in found.collect()}
    assert all(got[0, f"f{i}"] == ("binary", "-", [0, 1] if i % 2 == 0 else [1, 0], i, True) for i in range(1001)) and joins <= 11
    assert got[1, "i"] == ("identity", None, [1], 0, True) and got[1, "j"] == ("identity", None, [0], 1, True)
    assert got[1, "c"] == ("call", None, [0, 1], 0, True) and got[1, "d"] == ("call", None, [0, 1], 1, True) and got[1, "e"] == ("call", None, [1, 0], 1, False)
    assert got[1, "n"][0] == got[1, "m"][0] == "function" and got[1, "m"][2:4] == ([0], 1)
    assert {got[2, n][0] for n in "abc"} == {"cycle"} and got[2, "w"][0] == "function" and got[2, "s"] == ("binary", "*", [0, 0], 1, False)
    assert {n for k, n in got if k == 3} == set()


def test_long_machines(spark):
    rng = random.Random(2)
    n = 3000
    order = list(range(n))
    rng.shuffle(order)
    t = [(1, a, b) for a, b in zip(order, [*order[1:], None])]
    t += [(2, 0, 1), (2, 1, 2), (2, 2, 0), (3, 0, 1), (3, 1, 77), (4, 5, None), (5, 0, 2), (5, 1, 2), (5, 2, None)]
    frame = spark.createDataFrame(t, "machine int, state int, next int")
    starts = spark.createDataFrame([(1, order[0]), (2, 1), (3, 0), (4, 5), (5, 1), (6, 0)], "machine int, state int")
    got = sorted((r.machine, r.depth, r.state) for r in machines.trace(frame, starts).collect())
    assert got == [(1, i, s) for i, s in enumerate(order)] + [(4, 0, 5), (5, 0, 1), (5, 1, 2)]


def test_shared_cases_go_to_the_first_entry(spark):
    t = [(1, i, i + 1 if i < 9 else None) for i in range(10)] + [(2, 0, 1), (2, 1, 0), (2, 5, 6), (2, 6, None)]
    entries = [(1, 6, 1), (1, 0, 2), (1, 3, 3), (1, 8, 4), (2, 0, 1), (2, 5, 2), (2, 6, 3)]
    got = sorted((r.machine, r.rank, r.depth, r.state) for r in machines.owners(spark.createDataFrame(t, "machine int, state int, next int"), spark.createDataFrame(entries, "machine int, state int, rank int")).collect())
    assert got == [(1, 1, i, 6 + i) for i in range(4)] + [(1, 2, i, i) for i in range(6)] + [(2, 2, 0, 5), (2, 2, 1, 6)]


def test_rotations_in_one_pass(spark):
    rng = random.Random(8)
    numbers = [rng.randint(-50, 50) for _ in range(10_000)]
    turn = lambda a, r: a[r:] + a[:r]
    total = lambda a: sum((i + 1) * x for i, x in enumerate(a))
    rows = [(1, numbers, total(turn(numbers, 7_777))), (2, [1, 1], 7), (3, [], 0), (4, [5, 5, 5], 30)]
    frame = spark.createDataFrame(rows, "array_id int, numbers array<bigint>, target bigint")
    first = next(r for r in range(10_000) if r == 7_777 or total(turn(numbers, r)) == rows[0][2])
    assert {r.array_id: r.rotation for r in rotation.solve_weighted(frame).collect()} == {1: first, 2: None, 3: None, 4: 0}


def test_rotations_of_arrays_in_runs(spark, tmp_path):
    """no array is one row, and sums beyond 64 bits stay exact."""
    from scriptmill.plans.deep import long_rotations

    rng = random.Random(9)
    big = lambda: rng.randint(4 * 10**17, 5 * 10**17)
    lines = [(i, big(), 1, n, 1.0) for n, size in ((1, 400), (2, 18), (3, 17)) for i in range(size)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(map(tuple, long_rotations(spark, str(tmp_path)).collect())) == [(1, 17), (2, 17)]
    arrays = {1: [rng.randint(-50, 50) for _ in range(3000)], 2: [1, 1], 4: [5, 5, 5]}
    elements = spark.createDataFrame([(a, i, x) for a, xs in arrays.items() for i, x in enumerate(xs)], "array_id int, i int, x long")
    own = written(rotation.placed(elements, ["i"], 5))
    got = {(r.array_id, r.place): (r.x, int(r.before)) for r in own.collect()}
    assert got == {(a, i): (x, sum(xs[:i])) for a, xs in arrays.items() for i, x in enumerate(xs)}
    total = lambda a, r: sum((i + 1) * x for i, x in enumerate(a[r:] + a[:r]))
    targets = {1: total(arrays[1], 2000), 2: 7, 3: 0, 4: 30}
    found = {r.array_id: r.rotation for r in rotation.solve_placed(own, spark.createDataFrame(list(targets.items()), "array_id int, target long")).collect()}
    assert found == {1: next(r for r in range(3000) if r == 2000 or total(arrays[1], r) == targets[1]), 2: None, 3: None, 4: 0}


def test_checksums_of_terms(spark):
    texts = {1: ["12a", "7", "x3", "40", "5b"], 2: ["1", "2"], 3: ["a", "b"]}
    strings = spark.createDataFrame([(i, p, t) for i, ts in texts.items() for p, t in enumerate(ts)], "array_id int, place int, text string")
    terms = spark.createDataFrame([(i, 0, 0, 0, 1.0, -1.0) for i in texts] + [(i, 1, 0, 1, 2.0, 1.0) for i in texts] + [(i, 1, 1, 0, 4.0, -1.0) for i in texts], "array_id int, term int, factor int, place int, divisor double, sign double")
    at = lambda ts, p, r: float(ts[(p + r) % len(ts)].rstrip("ab"))
    check = lambda ts, r: -at(ts, 0, r) + at(ts, 1, r) / 2 * -at(ts, 0, r) / 4
    targets = spark.createDataFrame([(1, check(texts[1], 3)), (2, 99.0), (3, 1.0)], "array_id int, target double")
    assert {r.array_id: r.rotation for r in rotation.solve_checksum(strings, terms, targets).collect()} == {1: 3, 2: None, 3: None}


def test_aliases(spark):
    deep = "var d0 = atob;" + "".join(f"var d{i} = d{i - 1};" for i in range(1, 200)) + "var w = d5; w = 1; var x = y, y = x; let z = w;"
    scripts = table(spark, [deep])
    symbols = written(facts.symbols(scripts))
    found, joins = rotation.aliases(written(facts.nodes(scripts)), symbols)
    names = {r.symbol_id: r.name for r in symbols.collect()}
    got = {names[r.symbol_id]: (names[r.root], r.hops) for r in found.collect()}
    assert got == {f"d{i}": ("d0", i) for i in range(1, 200)} | {"z": ("w", 1)} and joins <= 9


@pytest.mark.parametrize("x, up, down, whole, near", [(1.5, 2, 1, 1, 2), (-1.5, -1, -2, -1, -2), (0.49999999999999994, 1, 0, 0, 0), (1e20, 1e20, 1e20, 1e20, 1e20), (-2.5, -2, -3, -2, -3), (float("inf"),) * 5, (9007199254740993.0,) * 5])
def test_rounding(spark, x, up, down, whole, near):
    r = spark.range(1).select(js.ceil(F.lit(x)).alias("up"), js.floor(F.lit(x)).alias("down"), js.trunc(F.lit(x)).alias("whole"), js.round_(F.lit(x)).alias("near")).head()
    assert tuple(r) == (up, down, whole, near)


def test_nan_compares_to_nothing(spark):
    nan = float("nan")
    for f, same in ((js.less, False), (js.less_equal, True), (js.greater, False), (js.greater_equal, True), (js.equal, True), (js.strict_equal, True)):
        r = spark.range(1).select(f(F.lit(1.0), F.lit(nan)).alias("a"), f(F.lit(nan), F.lit(nan)).alias("b"), f(F.lit(2.0), F.lit(2.0)).alias("c"), f(F.lit(None).cast("double"), F.lit(1.0)).alias("d")).head()
        assert tuple(r) == (False, False, same, None)
    assert spark.range(1).select(js.not_equal(F.lit(nan), F.lit(nan)).alias("a"), js.math_pow(F.lit(1e200), F.lit(2.0)).alias("b")).head() == (True, None)


@pytest.mark.parametrize("name", ["proxy_chains", "dead_chains", "edited_scripts", "pattern_matches", "folded_sums"])
def test_scripts_of_small_tables_are_dealt_out(spark, tmp_path, monkeypatch, name):
    """a small file is much parsing, so it isn't one task's."""
    from scriptmill.plans import deep

    class Seen(Exception):
        pass

    def seen(scripts, *_):
        raise Seen(scripts.rdd.getNumPartitions())

    spark.range(40).selectExpr("id as c_custkey", "'c' || id as c_name", "1.5D as c_acctbal", "'M' as c_mktsegment", "id % 5 as c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'1-U' as o_orderpriority").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(40).selectExpr("id % 9 as l_orderkey", "cast(id as int) as l_linenumber", "2.0D as l_quantity", "'R' as l_returnflag").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(deep.facts, "every", seen)
    monkeypatch.setattr(deep.facts, "nodes", seen)
    with pytest.raises(Seen) as x:
        getattr(deep, name)(spark, str(tmp_path))
    assert x.value.args == (int(spark.conf.get("spark.sql.shuffle.partitions")),)


def _broadcasts(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_many_rows_are_not_broadcast(spark):
    """rows of facts take next to no bytes in files, so that millions looked small enough to go through the driver."""
    rows = spark.range(BROADCAST_ROWS + 1).selectExpr("id % 10 as script_id", "cast(id as int) as node_id", "'x' as kind")
    for table in (written(rows), counted(rows)[0]):
        other = table.select("script_id", F.col("node_id").alias("parent_id"), F.col("node_id") + 1)
        for joined in (table.where("kind = 'x'").join(other, "script_id"), rows.join(table.select("script_id", "node_id"), ["script_id", "node_id"], "left_semi"), rows.join(table.groupBy("script_id").count(), "script_id", "left")):
            assert not _broadcasts(joined)
    small = written(rows.limit(10))
    assert _broadcasts(written(rows).select("script_id").hint("shuffle_hash").join(small.hint("broadcast"), "script_id"))
    assert _broadcasts(rows.join(small, "script_id"))


def test_facts_of_many_scripts_are_not_broadcast(spark):
    """nodes are many here, scopes are few."""
    known = facts.every(spark.range(2).selectExpr("id as script_id", f"repeat('f(1); ', {BROADCAST_ROWS // 6}) as source"))
    assert known.nodes.count() > BROADCAST_ROWS > known.scopes.count() == 2
    assert not _broadcasts(known.nodes.join(known.nodes.select("script_id", F.col("node_id").alias("parent_id")), ["script_id", "parent_id"]))
    assert _broadcasts(known.scopes.join(known.symbols, "script_id"))


@pytest.mark.parametrize("name", ["edited_scripts", "pattern_matches", "proxy_chains"])
def test_rows_are_the_same_without_broadcasts(spark, name, monkeypatch):
    from scriptmill import session
    from scriptmill.plans import deep

    few = [r for r in getattr(deep, name)(spark, "/root/testdata/sf0.001").collect()]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, getattr(deep, name)(spark, "/root/testdata/sf0.001").collect())) == sorted(map(repr, few))
