"""Syntax trees: one node class, the order of each kind's children, and walks."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A node of some kind; its fields depend on the kind (see FIELDS)."""

    def __init__(self, kind: str, **fields):
        self.kind = kind
        self.__dict__.update(fields)

    def __repr__(self) -> str:
        return f"Node({', '.join([repr(self.kind), *(f'{k}={v!r}' for k, v in self.__dict__.items() if k not in ('kind', 'symbol'))])})"


#: Children of each kind in source order. A field holds a node, None, or a list of those.
FIELDS: dict[str, tuple[str, ...]] = {
    "Program": ("body",),
    "ExpressionStatement": ("expression",),
    "VariableDeclaration": ("declarations",),
    "Declarator": ("target", "init"),
    "FunctionDeclaration": ("name", "params", "body"),
    "ClassDeclaration": ("name", "base", "members"),
    "Return": ("value",),
    "If": ("test", "then", "other"),
    "For": ("init", "test", "update", "body"),
    "ForIn": ("left", "right", "body"),
    "ForOf": ("left", "right", "body"),
    "While": ("test", "body"),
    "DoWhile": ("body", "test"),
    "Throw": ("value",),
    "Try": ("block", "param", "handler", "finalizer"),
    "Switch": ("subject", "cases"),
    "Case": ("test", "body"),
    "Labeled": ("body",),
    "Block": ("body",),
    "Body": ("body",),
    "Export": ("declaration",),
    "ExportDefault": ("declaration",),
    "Array": ("items",),
    "Object": ("members",),
    "Property": ("key", "value"),
    "Spread": ("value",),
    "Function": ("name", "params", "body"),
    "Arrow": ("params", "body"),
    "Class": ("name", "base", "members"),
    "ClassMember": ("key", "value"),
    "StaticBlock": ("body",),
    "Template": ("values",),
    "Tagged": ("tag", "template"),
    "Unary": ("value",),
    "Update": ("target",),
    "Binary": ("left", "right"),
    "Logical": ("left", "right"),
    "Assignment": ("target", "value"),
    "Conditional": ("test", "then", "other"),
    "Call": ("callee", "arguments"),
    "New": ("callee", "arguments"),
    "ImportCall": ("arguments",),
    "Member": ("object",),
    "Index": ("object", "index"),
    "Sequence": ("items",),
    "Paren": ("value",),
    "Yield": ("value",),
    "Await": ("value",),
    "ObjectPattern": ("members",),
    "ArrayPattern": ("items",),
    "Default": ("target", "value"),
    "Rest": ("target",),
}

STATEMENTS = frozenset("ExpressionStatement VariableDeclaration FunctionDeclaration ClassDeclaration Return If For ForIn ForOf While DoWhile Throw Try Switch Labeled Block Empty Break Continue Debugger Import Export ExportDefault ExportList ExportAll".split())
EXPRESSIONS = frozenset("Identifier Number String Boolean Null BigInt Regex Template Tagged Array Object Function Arrow Class Unary Update Binary Logical Assignment Conditional Call New ImportCall Member Index Sequence Paren Yield Await This Super Meta PrivateName".split())
FUNCTIONS = frozenset(("Function", "FunctionDeclaration", "Arrow"))


def children(node: Node) -> Iterator[Node]:
    for field in FIELDS.get(node.kind, ()):
        x = getattr(node, field)
        if isinstance(x, list):
            yield from (c for c in x if c is not None)
        elif x is not None:
            yield x


def walk(node: Node) -> Iterator[Node]:
    """The node and all below it, in source order."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(list(children(n))))


def clone(node: Node) -> Node:
    """A copy of the tree; identifiers stay bound to their symbols but aren't counted as references yet."""
    out = Node(node.kind)
    fields = FIELDS.get(node.kind, ())
    for k, v in node.__dict__.items():
        if k in fields:
            v = [None if c is None else clone(c) for c in v] if isinstance(v, list) else None if v is None else clone(v)
        out.__dict__[k] = v
    return out


def bare(node: Node) -> Node:
    """The node inside any parentheses."""
    while node.kind == "Paren":
        node = node.value
    return node


def number(value: float) -> Node:
    return Node("Number", value=float(value), raw=None)


def string(value: str) -> Node:
    return Node("String", value=value)


def boolean(value: bool) -> Node:
    return Node("Boolean", value=value)


def identifier(name: str) -> Node:
    return Node("Identifier", name=name, symbol=None)


def undefined() -> Node:
    return identifier("undefined")


def void_zero() -> Node:
    return Node("Unary", op="void", value=number(0))


def empty() -> Node:
    return Node("Empty")


def block(body: list[Node]) -> Node:
    return Node("Block", body=body)


def expression_statement(x: Node) -> Node:
    return Node("ExpressionStatement", expression=x)


def negated(x: Node) -> Node:
    return Node("Unary", op="!", value=x)


def format_number(x: float) -> str:
    """Shortest decimal text that reads back as x; no exponent, no fraction on whole numbers."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    text = repr(x)
    mantissa, _, exponent = text.partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    if exponent:
        shift = int(exponent)
        digits = whole + fraction
        point = len(whole) + shift
        if point <= 0:
            whole, fraction = "0", "0" * -point + digits
        else:
            digits = digits.ljust(point, "0")
            whole, fraction = digits[:point], digits[point:]
    return sign + whole + (f".{fraction}" if fraction else "")
