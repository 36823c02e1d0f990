"""Rules that compute: operators, built-in calls, methods of literals, bitwise identities."""

from __future__ import annotations

import math
import re

from scriptmill.kernel import values as v
from scriptmill.kernel.fixpoint import Rule
from scriptmill.kernel.scope import forget
from scriptmill.kernel.tree import Node, bare, boolean, number, string, undefined, walk


class ConstantFolding(Rule):
    name = "ConstantFolding"
    interests = ("Binary", "Unary", "Logical")

    def enter_expression(self, x: Node) -> Node | None:
        new = {"Binary": self.binary, "Unary": self.unary, "Logical": self.logical}.get(x.kind, lambda _: None)(x)
        if new is not None:
            forget(x, new)
        return new

    def binary(self, x: Node) -> Node | None:
        a, b, op = v.coerced(x.left), v.coerced(x.right), x.op
        if a is not None and b is not None:
            if op in ("<", "<=", ">", ">=", "==", "!=", "===", "!=="):
                return boolean(v.compare(op, a, b))
            if op in ("|", "&", "^", "<<", ">>", ">>>"):
                return number(v.bitwise(op, v.int32(a), v.int32(b)))
            r = v.arithmetic(op, a, b)
            return None if r is None else number(r)
        left, right = bare(x.left), bare(x.right)
        if op == "+":
            text = lambda n: n.value if n.kind == "String" else v.array_text(n)
            s, t = text(left), text(right)
            return string(s + t) if s is not None and t is not None else None
        if op == "-":
            s, t = self.subtrahend(left), self.subtrahend(right)
            if s is not None and t is not None and math.isfinite(s - t):
                return number(s - t)
        return None

    @staticmethod
    def subtrahend(x: Node) -> float | None:
        if x.kind == "String":
            return v.numeric_text(x.value)
        return 0.0 if x.kind == "Array" and not x.items else v.coerced(x)

    def unary(self, x: Node) -> Node | None:
        op, inner = x.op, bare(x.value)
        if op == "!":
            known = v.truthy(inner)
            return None if known is None else boolean(not known)
        if op in ("-", "+"):
            n = 0.0 if inner.kind == "Array" and not inner.items else v.coerced(inner)
            if n is None and op == "+" and inner.kind == "String":
                n = v.numeric_text(inner.value)
            return None if n is None else number(-n if op == "-" else n)
        if op == "typeof":
            kind = {"Number": "number", "String": "string", "Boolean": "boolean", "Null": "object", "Function": "function", "Arrow": "function"}.get(x.value.kind)
            return string(kind) if kind else None
        if op == "void":
            return undefined() if v.is_literal(inner) else None
        if op == "~" and x.value.kind == "Number":
            return number(~v.int32(x.value.value))
        return None

    def logical(self, x: Node) -> Node | None:
        if x.op == "??":
            return None
        left, right, and_ = v.truthy(x.left), v.truthy(x.right), x.op == "&&"
        if left is not None:
            return x.right if left == and_ else x.left
        return x.left if right is not None and right == and_ else None


class StringConcatenation(Rule):
    name = "StringConcatenation"
    interests = ("Binary",)

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Binary" or x.op != "+":
            return None
        parts, stack = [], [x]
        while stack:
            n = stack.pop()
            if n.kind == "Binary" and n.op == "+":
                stack += [n.left, n.right]  # the right one comes first
            elif n.kind == "String":
                parts.append(n.value)
            else:
                return None
        return string("".join(reversed(parts)))


class BuiltinEvaluation(Rule):
    name = "BuiltinEvaluation"
    interests = ("Call",)
    FUNCTIONS = frozenset("parseInt parseFloat Number Boolean atob btoa".split())
    OBJECTS = frozenset("String Number Math".split())

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Call":
            return None
        c = x.callee
        if c.kind == "Identifier" and c.name in self.FUNCTIONS:
            name = c.name
        elif c.kind == "Member" and c.object.kind == "Identifier" and c.object.name in self.OBJECTS:
            name = f"{c.object.name}.{c.name}"
        else:
            return None
        a = [v.literal(i) if v.is_literal(i) else v.NOTHING for i in x.arguments]
        if any(i is v.NOTHING for i in a):
            return None
        r = v.call_builtin(name, a)
        if r is v.NOTHING:
            return None
        forget(x)
        return v.to_node(r)


class LiteralMethodEvaluation(Rule):
    name = "LiteralMethodEvaluation"
    interests = ("Call", "Member", "Index")

    def enter_expression(self, x: Node) -> Node | None:
        r = v.NOTHING
        if x.kind == "Call":
            c = x.callee
            if c.kind == "Member" and c.object.kind == "String":
                a = [v.literal(i) if v.is_literal(i) else v.NOTHING for i in x.arguments]
                if not any(i is v.NOTHING for i in a):
                    r = v.call_method(c.object.value, c.name, a)
        elif x.kind == "Member" and x.name == "length":
            if x.object.kind == "String":
                r = len(v.units(x.object.value)) / 2
            elif self.literals(x.object):
                r = float(len(x.object.items))
        elif x.kind == "Index" and x.index.kind == "Number":
            i = x.index.value
            if x.object.kind == "String":
                r = v.call_method(x.object.value, "charAt", [i])
            elif self.literals(x.object) and i >= 0 and i == int(i) and i < len(x.object.items):
                r = v.literal(x.object.items[int(i)])
        return None if r is v.NOTHING else v.to_node(r)

    @staticmethod
    def literals(x: Node) -> bool:
        return x.kind == "Array" and all(i is not None and v.is_literal(i) for i in x.items)


#: Operand values of the truth table (fixed values).
PAIRS = ((0, 0), (0, -1), (-1, 0), (-1, -1), (0x55555555, 0x33333333), (1, 2), (-42, 17), (0x7FFFFFFF, 1))
SINGLES = (0, 1, -1, 0x55555555, 42, -42, 0x7FFFFFFF, 100)
#: Candidates in order of preference: name, nodes, value.
CANDIDATES = (
    ("a", 1, lambda a, b: a),
    ("b", 1, lambda a, b: b),
    ("~a", 2, lambda a, b: ~a),
    ("~b", 2, lambda a, b: ~b),
    ("-a", 2, lambda a, b: v.wrap32(-a)),
    ("-b", 2, lambda a, b: v.wrap32(-b)),
    ("a & b", 3, lambda a, b: a & b),
    ("a | b", 3, lambda a, b: a | b),
    ("a ^ b", 3, lambda a, b: a ^ b),
    ("a + b", 3, lambda a, b: v.wrap32(a + b)),
    ("a - b", 3, lambda a, b: v.wrap32(a - b)),
    ("b - a", 3, lambda a, b: v.wrap32(b - a)),
)
_WRAPPING = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def in_int32(x: Node, names: dict[str, int]) -> int | None:
    """An expression's value in wrapping 32-bit arithmetic."""
    x = bare(x)
    if x.kind == "Number":
        return v.int32(x.value)
    if x.kind == "Identifier":
        return names.get(x.name)
    if x.kind == "Unary":
        a = in_int32(x.value, names)
        return None if a is None else {"~": ~a, "-": v.wrap32(-a), "+": a}.get(x.op)
    if x.kind != "Binary":
        return None
    a, b = in_int32(x.left, names), in_int32(x.right, names)
    if a is None or b is None:
        return None
    if x.op in _WRAPPING:
        return v.wrap32(_WRAPPING[x.op](a, b))
    return v.bitwise(x.op, a, b) if x.op in ("&", "|", "^", "<<", ">>", ">>>") else None


class BitwiseSimplification(Rule):
    name = "BitwiseSimplification"
    interests = ("Binary", "Unary")

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind not in self.interests:
            return None
        if getattr(x, "plain", False):  # part of a tree that was found to hold no names
            return None
        size, names = 0, []
        for n in walk(x):
            if n.kind == "Paren":
                continue
            size += 1
            if n.kind == "Identifier":
                if n.name not in names:
                    names.append(n.name)
            elif not (n.kind == "Number" or n.kind == "Unary" and n.op in "~-+" or n.kind == "Binary" and re.fullmatch(r"[&|^+*-]|<<|>>>?", n.op)):
                return None
            if len(names) > 2:
                return None
        if not names:
            for n in walk(x):
                n.plain = True
        if size < 3 or not names:
            return None
        single = len(names) == 1
        points = [(s, s) for s in SINGLES] if single else PAIRS
        table = [in_int32(x, dict(zip(names, p))) for p in points]
        if None in table:
            return None
        if len(set(table)) == 1:
            new: Node | None = number(table[0])
        else:
            new = None
            for form, cost, f in CANDIDATES:
                if single and form not in ("a", "~a", "-a"):
                    continue
                if [f(*p) for p in points] == table:
                    new = self.build(form, x, names) if cost < size else None
                    break
        if new is not None:
            forget(x, new)
        return new

    @staticmethod
    def build(form: str, x: Node, names: list[str]) -> Node:
        """The candidate from the expression's own identifiers, so that they stay references."""
        own = {}
        for n in walk(x):
            if n.kind == "Identifier":
                own.setdefault(n.name, n)
        a, b = own[names[0]], own[names[-1]]
        part = {"a": a, "b": b}
        if len(form) == 1:
            return part[form]
        if len(form) == 2:
            return Node("Unary", op=form[0], value=part[form[1]])
        return Node("Binary", op=form[2], left=part[form[0]], right=part[form[4]])
