import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptmill.kernel import patterns as p
from scriptmill.kernel.parser import parse
from scriptmill.kernel.scope import analyse
from scriptmill.plans import sequences, twigs
from scriptmill.session import written
from scriptmill.sources import facts

SOURCES = [
    "a.b(1, 'x'); a['b'](2, \"y\"); a.b(); f(...q, 1); f(1, ...q); x = y = 3; x += 2; z.w = 1; [x] = [1];",
    "if (a === 1) { b(); c(); } else d; if (q) return_(1); function g(k) { var s = 1; let t = 2; s++; return s; } function h() { return; } function i() { return 1 + 2; } ;",
    "var v = c ? 'one' : 2, w = (1, a, true), u = [1, null, false], e = [], o = !0, n = -1.5, m = [1, , 2]; { } { f(); f(); g(); } { g(); f(); }",
    "function e() {} function r() { f(); f(); return 3; } x => x; f(f(f(1))); (a + b) * (c + 1); 'use strict'; /r/g; 10n;",
]
ANY = p.any_
PATTERNS = {
    "literals": p.any_literal,
    "binary": p.binary(None, p.capture("l"), p.capture("r")),
    "plus": p.binary("+", p.or_(p.any_identifier, p.any_number), p.not_(p.identifier("b"))),
    "call": p.call(p.member(p.capture("o", p.any_identifier), p.capture("m")), p.capture("n", p.any_number), p.capture("t", p.any_string)),
    "call0": p.call(p.capture("f", p.identifier("f")), p.capture("f", p.any_)),
    "no_arguments": p.call(ANY),
    "named": p.member(p.any_identifier, p.identifier("b")),
    "index": p.member(ANY, p.any_string),
    "member": p.member(p.any_identifier, p.and_(p.any_string, p.not_(p.string("c")))),
    "assigned": p.assignment(p.capture("lost", p.any_identifier), p.capture("v")),
    "any_assignment": p.assignment(ANY, ANY, None),
    "conditional": p.conditional(p.any_identifier, p.capture("yes", p.any_string), p.capture("no")),
    "sequence": p.sequence(ANY, p.any_identifier, p.capture("b", p.boolean(True))),
    "array": p.array(p.number(1), p.null, p.boolean(False)),
    "empty_array": p.array(),
    "pair": p.array(ANY, ANY),
    "unary": p.unary(None, p.capture("n", p.any_number)),
    "and_later_wins": p.and_(p.capture("x", p.any_identifier), p.capture("x"), p.capture("y")),
    "if_else": p.if_(p.binary("===", ANY, p.capture("n")), ANY, ANY),
    "if_alone": p.if_(ANY, ANY),
    "return": p.return_(p.capture("v")),
    "return_nothing": p.return_(),
    "var": p.variable_declaration("var"),
    "any_declaration": p.variable_declaration(),
    "empty": p.empty,
    "block": p.block(p.repeat(p.expression_statement(p.call(p.capture("f", p.any_identifier)))), p.repeat(p.return_(p.capture("v")))),
    "block2": p.block(p.repeat(p.expression_statement(p.call(p.identifier("f")))), p.expression_statement(p.call(p.capture("last")))),
    "all_then_one": p.block(p.repeat(ANY), p.return_(ANY)),  # a repeat gives nothing back: never
    "empty_block": p.block(),
    "repeat_alone": p.repeat(ANY),
    "body": p.block(p.variable_declaration("var"), p.variable_declaration("let"), p.expression_statement(ANY), p.return_(p.capture("s"))),
}


@pytest.fixture(scope="module")
def nodes(spark):
    return written(facts.nodes(spark.createDataFrame(list(enumerate(SOURCES)), "script_id long, source string"))).cache()


@pytest.fixture(scope="module")
def trees():
    out = []
    for s in SOURCES:
        program = parse(s)
        analyse(program)
        out.append([x for *_, x in facts._number_nodes(program)])
    return out


@pytest.mark.parametrize("name", PATTERNS)
def test_patterns_match_as_the_kernels_do(nodes, trees, name):
    pattern = PATTERNS[name]
    names = twigs.captures(pattern)
    want = {}
    for script, tree in enumerate(trees):
        for i, x in enumerate(tree):
            if (c := pattern.match(x)) is not None:
                want[script, i] = {k: v for k, v in c.items()}
    got = {}
    for r in twigs.find(nodes, pattern).collect():
        values = {n: r[n] for n in names if r[n] is not None and r[n].tag is not None}
        assert (r.script_id, r.node_id) not in got
        got[r.script_id, r.node_id] = {n: v.num if v.tag == "number" else v.bool if v.tag == "boolean" else v.str for n, v in values.items()}
    assert got == want


def test_conditions_and_what_lies_below(nodes, trees):
    got = {(r.script_id, r.node_id) for r in twigs.find(nodes, p.and_(p.any_binary, twigs.has(p.number(1)), twigs.where("op <> '==='"))).collect()}
    below = lambda x: [y for c in facts._number_nodes(x) for y in [c[-1]]][1:]
    want = {(s, i) for s, tree in enumerate(trees) for i, x in enumerate(tree) if x.kind == "Binary" and x.op != "===" and any(y.kind == "Number" and y.value == 1 for y in below(x))}
    assert got == want and want
    with pytest.raises(ValueError):
        twigs.find(nodes, p.predicate(lambda n: True))


def test_empty_tables(nodes):
    assert all(twigs.find(nodes.limit(0), x).count() == 0 for x in (PATTERNS["block"], PATTERNS["call"], p.not_(p.null)))


LETTERS = "abc"


def possessive(text, items):
    at, taken = 0, []
    for letters, many in items:
        begin = at
        while at < len(text) and text[at] in letters and (many or at == begin):
            at += 1
        if not many and at == begin:
            return None
        taken.append(at - begin)
    return taken if at == len(text) else None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "ab", "abc", "bc"]), st.booleans()), max_size=5), st.lists(st.text(LETTERS, max_size=7), min_size=1, max_size=12))
def test_runs_equal_regular_expressions(spark, items, texts):
    repeats = [m for _, m in items]
    masks = [[sum(1 << i for i, (x, _) in enumerate(items) if c in x) for c in t] for t in texts]
    rows = spark.createDataFrame(list(zip(texts, masks)), "t string, masks array<long>").select("t", sequences.accepts(F.col("masks"), repeats).alias("all"), sequences.counts(F.col("masks"), repeats).alias("taken")).collect()
    pattern = re.compile("".join(f"[{x}]{'*' if m else ''}" for x, m in items))
    for r in rows:
        assert r["all"] == (pattern.fullmatch(r.t) is not None)
        assert r.taken == possessive(r.t, items)


def test_long_lists(spark):
    row = spark.range(1).select(F.concat(F.array_repeat(F.lit(1).cast("long"), 50_000), F.array(F.lit(2).cast("long"))).alias("masks"))
    assert row.select(sequences.counts(F.col("masks"), [True, False]).alias("c"), sequences.accepts(F.col("masks"), [True, False]).alias("a")).head() == ([50_000, 1], True)
