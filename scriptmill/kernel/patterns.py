"""A small algebra of patterns over trees.

A pattern's match() gives the captures as a dict, or None. Captures hold an identifier's name, a string, a
number or a boolean; other nodes match without being captured. Lists match by position and exact length;
spreads and holes never match. ``repeat`` takes as many statements as it can inside a block, without giving
any back. Patterns can be pickled, so they work in rules and in Arrow functions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from scriptmill.kernel.tree import Node

Captures = dict[str, object]


@dataclass(frozen=True)
class Pattern:
    """what: which test; parts: its operands (values, patterns or tuples of patterns)."""

    what: str
    parts: tuple = ()

    def match(self, n: Node | None) -> Captures | None:
        return None if n is None else _TESTS[self.what](n, *self.parts)

    def matches(self, n: Node | None) -> bool:
        return self.match(n) is not None

    def __and__(self, other: Pattern) -> Pattern:
        return and_(self, other)

    def __or__(self, other: Pattern) -> Pattern:
        return or_(self, other)

    def __invert__(self) -> Pattern:
        return not_(self)


def as_string(c: Captures, name: str) -> str | None:
    x = c.get(name)
    return x if isinstance(x, str) else None


def as_number(c: Captures, name: str) -> float | None:
    x = c.get(name)
    return x if isinstance(x, float) else None


def as_boolean(c: Captures, name: str) -> bool | None:
    x = c.get(name)
    return x if isinstance(x, bool) else None


def _of(kind: str):
    return lambda n: {} if n.kind == kind else None


def _value(n: Node) -> object:
    if n.kind == "Identifier":
        return n.name
    return n.value if n.kind in ("String", "Number", "Boolean") else None


def _all(nodes: list[Node | None], patterns: tuple[Pattern, ...]) -> Captures | None:
    if len(nodes) != len(patterns):
        return None
    out: Captures = {}
    for n, p in zip(nodes, patterns):
        if n is None or n.kind == "Spread":
            return None
        c = p.match(n)
        if c is None:
            return None
        out |= c
    return out


def _operator(kind: str, *fields: str):
    def test(n: Node, op: str | None, *patterns: Pattern) -> Captures | None:
        if n.kind != kind or op is not None and n.op != op:
            return None
        return _all([getattr(n, f) for f in fields], patterns)

    return test


def _member(n: Node, obj: Pattern, prop: Pattern) -> Captures | None:
    if n.kind == "Index":
        return _all([n.object, n.index], (obj, prop))
    if n.kind != "Member" or n.name.startswith("#") or prop.what not in ("identifier", "any_identifier", "any") and not (prop.what == "capture" and prop.parts[1].what in ("identifier", "any_identifier", "any")):
        return None
    return _all([n.object, Node("Identifier", name=n.name, symbol=None)], (obj, prop))


def _call(n: Node, callee: Pattern, arguments: tuple[Pattern, ...]) -> Captures | None:
    if n.kind != "Call":
        return None
    a = callee.match(n.callee)
    b = _all(n.arguments, arguments) if a is not None else None
    return None if b is None else a | b


def _assignment(n: Node, op: str | None, target: Pattern, value: Pattern) -> Captures | None:
    """Targets are plain names; what they capture is dropped."""
    if n.kind != "Assignment" or op is not None and n.op != op or n.target.kind != "Identifier" or target.match(n.target) is None:
        return None
    return value.match(n.value)


def _capture(n: Node, name: str, inner: Pattern) -> Captures | None:
    c = inner.match(n)
    v = _value(n) if c is not None else None
    return c if v is None else c | {name: v}


def _and(n: Node, *patterns: Pattern) -> Captures | None:
    out: Captures = {}
    for p in patterns:
        c = p.match(n)
        if c is None:
            return None
        out |= c
    return out


def _or(n: Node, *patterns: Pattern) -> Captures | None:
    return next((c for p in patterns if (c := p.match(n)) is not None), None)


def _return(n: Node, value: Pattern | None) -> Captures | None:
    if n.kind != "Return":
        return None
    if value is None:
        return {} if n.value is None else None
    return value.match(n.value)


def _block(n: Node, patterns: tuple[Pattern, ...]) -> Captures | None:
    if n.kind not in ("Block", "Body", "Program"):
        return None
    out: Captures = {}
    at = 0
    for p in patterns:
        if p.what == "repeat":
            while at < len(n.body) and (c := p.parts[0].match(n.body[at])) is not None:
                out |= c
                at += 1
            continue
        c = p.match(n.body[at]) if at < len(n.body) else None
        if c is None:
            return None
        out |= c
        at += 1
    return out if at == len(n.body) else None


def _if(n: Node, test: Pattern, then: Pattern, other: Pattern | None) -> Captures | None:
    if n.kind != "If" or (n.other is None) != (other is None):
        return None
    return _all([n.test, n.then, *([n.other] if other else [])], (test, then, *([other] if other else [])))


def _declaration(n: Node, word: str | None) -> Captures | None:
    return {} if n.kind == "VariableDeclaration" and word in (None, n.word) else None


_TESTS: dict[str, Callable[..., Captures | None]] = {
    "any": lambda n: {},
    "any_literal": lambda n: {} if n.kind in ("Number", "String", "Boolean", "Null", "BigInt", "Regex") else None,
    "any_identifier": _of("Identifier"),
    "any_number": _of("Number"),
    "any_string": _of("String"),
    "any_binary": _of("Binary"),
    "identifier": lambda n, name: {} if n.kind == "Identifier" and n.name == name else None,
    "string": lambda n, text: {} if n.kind == "String" and n.value == text else None,
    "number": lambda n, x: {} if n.kind == "Number" and abs(n.value - x) < sys.float_info.epsilon else None,
    "boolean": lambda n, x: {} if n.kind == "Boolean" and n.value == x else None,
    "null": _of("Null"),
    "binary": _operator("Binary", "left", "right"),
    "unary": _operator("Unary", "value"),
    "call": _call,
    "member": _member,
    "sequence": lambda n, patterns: _all(n.items, patterns) if n.kind == "Sequence" else None,
    "conditional": lambda n, *patterns: _all([n.test, n.then, n.other], patterns) if n.kind == "Conditional" else None,
    "assignment": _assignment,
    "array": lambda n, patterns: _all(n.items, patterns) if n.kind == "Array" else None,
    "capture": _capture,
    "and": _and,
    "or": _or,
    "not": lambda n, p: {} if p.match(n) is None else None,
    "predicate": lambda n, f: {} if f(n) else None,
    "expression_statement": lambda n, p: p.match(n.expression) if n.kind == "ExpressionStatement" else None,
    "return": _return,
    "block": _block,
    "if": _if,
    "variable_declaration": _declaration,
    "empty": _of("Empty"),
    "repeat": lambda n, p: None,  # only inside a block
}


# -- builders ---------------------------------------------------------------------------------------------------------

any_ = Pattern("any")
any_literal = Pattern("any_literal")
any_identifier = Pattern("any_identifier")
any_number = Pattern("any_number")
any_string = Pattern("any_string")
any_binary = Pattern("any_binary")
null = Pattern("null")
empty = Pattern("empty")


def identifier(name: str) -> Pattern:
    return Pattern("identifier", (name,))


def string(text: str) -> Pattern:
    return Pattern("string", (text,))


def number(x: float) -> Pattern:
    return Pattern("number", (float(x),))


def boolean(x: bool) -> Pattern:
    return Pattern("boolean", (x,))


def binary(op: str | None, left: Pattern, right: Pattern) -> Pattern:
    return Pattern("binary", (op, left, right))


def unary(op: str | None, value: Pattern) -> Pattern:
    return Pattern("unary", (op, value))


def call(callee: Pattern, *arguments: Pattern) -> Pattern:
    return Pattern("call", (callee, arguments))


def member(obj: Pattern, prop: Pattern) -> Pattern:
    return Pattern("member", (obj, prop))


def sequence(*items: Pattern) -> Pattern:
    return Pattern("sequence", (items,))


def conditional(test: Pattern, then: Pattern, other: Pattern) -> Pattern:
    return Pattern("conditional", (test, then, other))


def assignment(target: Pattern, value: Pattern, op: str | None = "=") -> Pattern:
    return Pattern("assignment", (op, target, value))


def array(*items: Pattern) -> Pattern:
    return Pattern("array", (items,))


def capture(name: str, inner: Pattern = any_) -> Pattern:
    return Pattern("capture", (name, inner))


def and_(*patterns: Pattern) -> Pattern:
    return Pattern("and", patterns)


def or_(*patterns: Pattern) -> Pattern:
    return Pattern("or", patterns)


def not_(p: Pattern) -> Pattern:
    return Pattern("not", (p,))


def predicate(f: Callable[[Node], bool]) -> Pattern:
    return Pattern("predicate", (f,))


def expression_statement(p: Pattern) -> Pattern:
    return Pattern("expression_statement", (p,))


def return_(value: Pattern | None = None) -> Pattern:
    return Pattern("return", (value,))


def block(*statements: Pattern) -> Pattern:
    return Pattern("block", (statements,))


def if_(test: Pattern, then: Pattern, other: Pattern | None = None) -> Pattern:
    return Pattern("if", (test, then, other))


def variable_declaration(word: str | None = None) -> Pattern:
    return Pattern("variable_declaration", (word,))


def repeat(p: Pattern) -> Pattern:
    return Pattern("repeat", (p,))
