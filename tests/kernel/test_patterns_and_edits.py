import pickle

from scriptmill.kernel import edits
from scriptmill.kernel import patterns as p
from scriptmill.kernel.parser import parse
from scriptmill.kernel.scope import analyse
from scriptmill.kernel.tree import expression_statement, number


def x(source):
    return parse(f"({source});").body[0].expression.value


def s(source):
    return parse(source).body[0]


def test_expressions():
    assert p.binary("+", p.capture("a", p.any_number), p.capture("b")).match(x("1 + y")) == {"a": 1.0, "b": "y"}
    assert p.call(p.member(p.identifier("Math"), p.identifier("max")), p.any_, p.any_literal).matches(x("Math.max(a, 2)"))
    assert not p.call(p.any_, p.any_).matches(x("f(...a)"))
    assert p.member(p.any_, p.string("k")).matches(x("o['k']")) and not p.member(p.any_, p.string("k")).matches(x("o.k"))
    assert p.assignment(p.capture("t"), p.capture("v")).match(x("t = true")) == {"v": True}
    assert not p.assignment(p.any_, p.any_).matches(x("o.t = 1"))
    assert p.array(p.number(1), p.null).matches(x("[1, null]")) and not p.array(p.any_, p.any_).matches(x("[1,,]"))
    assert p.unary("!", p.boolean(True)).matches(x("!true"))
    assert p.sequence(p.any_, p.any_string).matches(x("a, 'b'"))
    assert p.conditional(p.any_, p.any_, p.any_).matches(x("a ? b : c"))
    assert (p.any_number | p.any_string).matches(x("'s'")) and not (~p.any_).matches(x("a"))
    assert p.and_(p.capture("n"), p.capture("m")).match(x("q")) == {"n": "q", "m": "q"}
    assert p.predicate(lambda n: n.kind == "Array").matches(x("[]")) and p.any_binary.matches(x("a * b"))
    c = p.capture("v").match(x("'t'"))
    assert (p.as_string(c, "v"), p.as_number(c, "v"), p.as_boolean(c, "v")) == ("t", None, None)
    assert pickle.loads(pickle.dumps(p.binary(None, p.any_, p.any_))).matches(x("a - b"))


def test_statements():
    two = p.block(p.repeat(p.expression_statement(p.any_)), p.return_(p.capture("r")))
    assert two.match(s("{ a(); b(); return 5; }")) == {"r": 5.0} and two.matches(s("{ return 1; }"))
    # Repeat gives nothing back.
    assert not p.block(p.repeat(p.any_), p.return_(p.any_)).matches(s("{ a(); return 1; }"))
    assert not p.repeat(p.any_).matches(s("a();"))
    assert p.if_(p.any_, p.any_).matches(s("if (a) b;")) and not p.if_(p.any_, p.any_).matches(s("if (a) b; else c;"))
    assert p.variable_declaration("let").matches(s("let a;")) and p.empty.matches(s(";")) and p.return_().matches(parse("function f() { return; }").body[0].body.body[0])


def counts(source, edit):
    program = parse(source)
    root = analyse(program)
    a = root.symbols["a"]
    before = len(a.refs)
    edit(program, a)
    return before, len(a.refs)


def test_edits_keep_reference_counts():
    assert counts("var a; f(a, a); g(a);", lambda q, a: edits.remove_statement(q.body, 1)) == (3, 1)
    assert counts("var a; f(a + 1);", lambda q, a: edits.replace(q.body[1].expression, "arguments", q) if False else edits.replace(q.body[1], "expression", number(1))) == (1, 0)
    assert counts("var a; f(a);", lambda q, a: edits.replace(q.body[1], "expression", q.body[1].expression.arguments[0])) == (1, 1)
    assert counts("var a; f(function() { return a; });", lambda q, a: edits.remove(q.body[1], "expression")) == (1, 0)
    assert counts("var a; f(a); g(a);", lambda q, a: edits.retain(q.body, lambda t: t.kind == "VariableDeclaration")) == (2, 0)
    assert counts("var a; f(a);", lambda q, a: edits.replace_with_several(q.body, 1, [expression_statement(q.body[1].expression), expression_statement(number(1))])) == (1, 1)
    assert counts("var a; f(a);", lambda q, a: edits.replace_with_several(q.body, 1, [])) == (1, 0)
    assert counts("var a; a = 1; a++;", lambda q, a: edits.delete_references(q)) == (2, 0)

    program = parse("var a; f(a);")
    root = analyse(program)
    edits.rename_binding(root.symbols["a"], "b")
    assert root.find("b").name == "b" and root.find("a") is None and len(edits.collect_references(program)) == 1
    edits.append_expression(program.body, number(2))
    edits.insert_expression(program.body, 0, number(1))
    edits.replace_with_sequence(program.body[2], "expression", [number(3), number(4)])
    assert [t.kind for t in program.body] == ["ExpressionStatement", "VariableDeclaration", "ExpressionStatement", "ExpressionStatement"]


def test_created_blocks_have_a_scope():
    from scriptmill.kernel import edits
    from scriptmill.kernel.parser import parse
    from scriptmill.kernel.printer import render
    from scriptmill.kernel.scope import analyse

    program = parse("let a = 1; f(a); var b = 2; g(b, a);")
    root = analyse(program)
    inner = edits.create_block_statement(program.body[:2], root)
    program.body[:2] = [inner]
    assert [x.kind for x in root.scopes] == ["block"] and set(root.scopes[0].symbols) == {"a"}
    assert len(root.scopes[0].symbols["a"].refs) == 1 and root.scopes[0].find("b") is root.symbols["b"]
    assert len(root.symbols["a"].refs) == 1  # the use that was left outside
    assert render(program).startswith("{\n    let a = 1;\n    f(a);\n}")
