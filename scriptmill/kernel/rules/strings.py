"""Rules that recover strings from encoded arrays.

All of them look in a statement list for three things: an array of strings (alone, or returned by a
function), a decoder (a function that indexes it) and, for shuffled arrays, a call that rotates the array
until a checksum comes out. What they learn is kept by the decoder's symbol; calls of a decoder, of an
alias or of a wrapper with literal arguments become literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from scriptmill.kernel import values as v
from scriptmill.kernel.fixpoint import FIRST, Rule
from scriptmill.kernel.rules.shaping import single
from scriptmill.kernel.scope import Symbol, forget
from scriptmill.kernel.tree import Node, bare, empty, walk

LEAST_PLAIN, LEAST_RC4 = 3, 10
LEAST_LETTERS = 40


def element(x: Node | None) -> object:
    """A literal of an array, negative numbers too."""
    if x is None:
        return v.NOTHING
    if x.kind == "Unary" and x.op == "-" and x.value.kind == "Number":
        return -x.value.value
    return v.literal(x) if v.is_literal(x) else v.NOTHING


def elements(x: Node) -> list | None:
    if x.kind != "Array":
        return None
    out = [element(i) for i in x.items]
    return None if any(i is v.NOTHING for i in out) else out


def integer(x: Node) -> int | None:
    """A literal index: a number or a numeric string."""
    x = bare(x)
    value = v.evaluate(x) if x.kind in ("Number", "Unary", "Binary") else v.numeric_text(x.value) if x.kind == "String" and not x.value.lower().startswith("0x") else float(int(x.value, 16)) if x.kind == "String" and re.fullmatch("0[xX][0-9a-fA-F]+", x.value) else None
    return int(value) if isinstance(value, float) and value == value and abs(value) < 2**53 and value == int(value) else None


def mentions(f: Node, test: Callable[[Node], bool]) -> bool:
    return any(test(n) for n in walk(f.body))


def alphabet_of(f: Node) -> str | None:
    """A custom base64 alphabet used by a function with indexOf."""
    if not mentions(f, lambda n: n.kind == "Member" and n.name == "indexOf"):
        return None
    for n in walk(f.body):
        if n.kind == "String" and len(n.value) in (64, 65) and sum(c.isascii() and c.isalnum() for c in n.value) >= LEAST_LETTERS:
            return n.value
    return None


class StringArrayDecoder(Rule):
    """var a = [...] and a function that indexes it and decodes base64."""

    name = "StringArrayDecoder"
    priority = FIRST
    interests = ("statements", "Call")

    def __init__(self):
        super().__init__()
        self.decoders: dict[Symbol, list] = {}

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            d = single(s)
            if d is None or d.init is None or d.target.symbol is None:
                continue
            own = elements(d.init)
            if own is None or len(own) < LEAST_PLAIN or not any(isinstance(x, str) for x in own):
                continue
            array = d.target.symbol
            for j, f in enumerate(body):
                if f.kind != "FunctionDeclaration" or f.is_async or f.star or f.name is None or f.name.symbol is None or not f.params or not mentions(f, lambda n: n.kind == "Index" and n.object.kind == "Identifier" and n.object.symbol is array):
                    continue
                if mentions(f, lambda n: n.kind == "Identifier" and n.name == "atob"):
                    alphabet = v.STANDARD
                elif (alphabet := alphabet_of(f)) is None:
                    continue
                decoded = [v.base64_decode(x, alphabet) if isinstance(x, str) else x for x in own]
                self.decoders[f.name.symbol] = [v.NOTHING if x is None and isinstance(o, str) else x for x, o in zip(decoded, own)]
                forget(s)
                forget(f)
                body[i] = body[j] = empty()
                changed = True
                break
        return changed

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Call" or len(x.arguments) not in (1, 2):
            return None
        callee, index = bare(x.callee), bare(x.arguments[0])
        if callee.kind != "Identifier" or callee.symbol not in self.decoders or index.kind != "Number":
            return None
        own, i = self.decoders[callee.symbol], index.value
        if i != int(i) or not 0 <= i < len(own) or own[int(i)] is v.NOTHING:
            return None
        forget(x)
        return v.to_node(own[int(i)])


# -- shuffled arrays --------------------------------------------------------------------------------------------------


def array_function(s: Node, least: int) -> list[str] | None:
    """The strings of a function without parameters that holds an array of them."""
    if s.kind != "FunctionDeclaration" or s.params or s.name is None:
        return None
    for b in s.body.body:
        for d in b.declarations if b.kind == "VariableDeclaration" else ():
            own = elements(d.init) if d.init is not None else None
            if own is not None and len(own) >= least and all(isinstance(x, str) for x in own):
                return own
    return None


def shift_of(f: Node) -> float | None:
    """K of p = p - K, where p is a parameter."""
    names = {p.symbol for p in f.params if p.kind == "Identifier"}
    for n in walk(f.body):
        if n.kind == "Assignment" and n.op == "=" and n.target.kind == "Identifier" and n.target.symbol in names:
            x = bare(n.value)
            if x.kind == "Binary" and x.op in ("-", "+") and bare(x.left).kind == "Identifier" and bare(x.left).symbol is n.target.symbol:
                k = v.evaluate(x.right)
                if isinstance(k, float):
                    return k if x.op == "-" else -k
        if n.kind == "Assignment" and n.op in ("-=", "+=") and n.target.kind == "Identifier" and n.target.symbol in names:
            k = v.evaluate(n.value)
            if isinstance(k, float):
                return k if n.op == "-=" else -k
    return None


def calls(f: Node, symbol: Symbol) -> bool:
    return mentions(f, lambda n: n.kind == "Call" and bare(n.callee).kind == "Identifier" and bare(n.callee).symbol is symbol)


def rotator(x: Node, array: Symbol) -> tuple[Node, float] | None:
    """Function and target of (function...)(arrayFunction, target), alone or in a sequence."""
    x = bare(x)
    if x.kind == "Sequence":
        return next((r for i in x.items if (r := rotator(i, array))), None)
    if x.kind == "Unary" and x.op == "!":
        x = bare(x.value)
    if x.kind != "Call" or bare(x.callee).kind != "Function" or len(x.arguments) < 2:
        return None
    first = bare(x.arguments[0])
    target = v.evaluate(x.arguments[1])
    if first.kind != "Identifier" or first.symbol is not array or not isinstance(target, float):
        return None
    return bare(x.callee), target


def checksum(f: Node) -> Node | None:
    """The expression with most parseInt calls that is assigned in a rotating function."""
    best, most = None, 0
    for n in walk(f.body):
        x = n.init if n.kind == "Declarator" else n.value if n.kind == "Assignment" and n.op == "=" else None
        if x is None or x.kind in ("Function", "Arrow"):
            continue
        count = sum(m.kind == "Call" and bare(m.callee).kind == "Identifier" and bare(m.callee).name == "parseInt" for m in walk(x))
        if count > most:
            best, most = x, count
    return best


def add_up(x: Node, decode: Callable[[Node], str | None]) -> float | None:
    """A checksum's value: numbers, + - * / %, and parseInt of decoded strings."""
    x = bare(x)
    if x.kind == "Number":
        return x.value
    if x.kind == "Unary" and x.op in ("-", "+"):
        a = add_up(x.value, decode)
        return a if a is None or x.op == "+" else -a
    if x.kind == "Binary":
        a, b = add_up(x.left, decode), add_up(x.right, decode)
        return None if a is None or b is None else v.arithmetic(x.op, a, b)
    if x.kind == "Call" and bare(x.callee).kind == "Identifier" and bare(x.callee).name == "parseInt" and x.arguments:
        a = bare(x.arguments[0])
        text = a.value if a.kind == "String" else decode(a) if a.kind == "Call" else None
        return None if text is None else v.parse_int(text)
    return None


def solve(n: int, target: float, sum_at: Callable[[int], float | None]) -> int | None:
    """The least rotation with the target checksum."""
    return next((r for r in range(n) if sum_at(r) == target), None)


class Table:
    """A rotated array with its decoder: index less shift, then plain text or base64 and RC4 with a key."""

    def __init__(self, strings: list[str], shift: float, keyed: bool):
        self.strings, self.shift, self.keyed = strings, shift, keyed
        self.rotation = 0

    def get(self, arguments: list[Node], rotation: int | None = None) -> str | None:
        if not arguments:
            return None
        i = integer(arguments[0])
        if i is None:
            return None
        i -= int(self.shift)
        if not 0 <= i < len(self.strings):
            return None
        text = self.strings[(i + (self.rotation if rotation is None else rotation)) % len(self.strings)]
        if not self.keyed:
            return text
        key = bare(arguments[1]) if len(arguments) > 1 else None
        return v.base64_rc4_decode(text, key.value) if key is not None and key.kind == "String" else None


class Wrapper:
    """A function that returns a decoder's call on its own parameters, one of them moved by a constant."""

    def __init__(self, table: Table, places: list[tuple[int, float]], n: int):
        self.table, self.places, self.n = table, places, n

    def arguments(self, own: list[Node]) -> list[Node] | None:
        out = []
        for at, move in self.places:
            if at >= len(own):
                return None
            x = bare(own[at])
            if move:
                i = integer(x)
                if i is None:
                    return None
                x = Node("Number", value=float(i) + move, raw=None)
            out.append(x)
        return out

    def get(self, own: list[Node], rotation: int | None = None) -> str | None:
        a = self.arguments(own)
        return None if a is None else self.table.get(a, rotation)


def wrapper_of(f: Node, known: dict[Symbol, object]) -> tuple[object, list[tuple[int, float]]] | None:
    """The decoder that a wrapper calls, with each argument's parameter and constant."""
    if len(f.body.body) != 1 or f.body.body[0].kind != "Return" or f.body.body[0].value is None:
        return None
    x = bare(f.body.body[0].value)
    if x.kind != "Call" or bare(x.callee).kind != "Identifier" or bare(x.callee).symbol not in known:
        return None
    symbols = [p.symbol if p.kind == "Identifier" else None for p in f.params]
    places = []
    for a in map(bare, x.arguments):
        move = 0.0
        if a.kind == "Binary" and a.op in ("+", "-"):
            k = v.evaluate(a.right)
            if not isinstance(k, float):
                return None
            move, a = (k if a.op == "+" else -k), bare(a.left)
        if a.kind != "Identifier" or a.symbol is None or a.symbol not in symbols:
            return None
        places.append((symbols.index(a.symbol), move))
    return known[bare(x.callee).symbol], places


class _Shuffled(Rule):
    """What both rules for shuffled arrays share."""

    priority = FIRST
    interests = ("statements", "Call")
    least = LEAST_PLAIN
    keyed = False
    removes = False

    def __init__(self):
        super().__init__()
        self.known: dict[Symbol, Table | Wrapper] = {}
        self.arrays: set[Symbol] = set()

    def is_decoder(self, f: Node, array: Symbol) -> bool:
        raise NotImplementedError

    def local(self, x: Node, inside: dict[Symbol, Table | Wrapper]) -> Callable[[Node, int], str | None]:
        def decode(call: Node, rotation: int) -> str | None:
            c = bare(call.callee)
            own = inside.get(c.symbol) if c.kind == "Identifier" else None
            return None if own is None else own.get(call.arguments, rotation)

        return decode

    def learn(self, body: list[Node]) -> bool:
        """Solve one array of this list, the last that qualifies."""
        for s in reversed(body):
            strings = array_function(s, self.least)
            if strings is None or s.name.symbol in self.arrays:
                continue
            array = s.name.symbol
            for f in body:
                if f.kind != "FunctionDeclaration" or f is s or f.name is None or not self.is_decoder(f, array):
                    continue
                shift = shift_of(f)
                if shift is None:
                    continue
                found = next(((b, r) for b in body if b.kind == "ExpressionStatement" and (r := rotator(b.expression, array))), None)
                if found is None:
                    continue
                statement, (spin, target) = found
                table = Table(strings, shift, self.keyed)
                inside: dict[Symbol, Table | Wrapper] = {f.name.symbol: table}
                for n in walk(spin.body):  # aliases and wrappers of the rotating function's own
                    if n.kind == "Declarator" and n.init is not None and n.init.kind == "Identifier" and n.init.symbol in inside and n.target.kind == "Identifier":
                        inside[n.target.symbol] = inside[n.init.symbol]
                    if n.kind == "FunctionDeclaration" and (w := wrapper_of(n, inside)):
                        inside[n.name.symbol] = Wrapper(table, w[1], len(n.params))
                sum_ = checksum(spin)
                decode = self.local(spin, inside)
                rotation = None if sum_ is None else solve(len(strings), target, lambda r: add_up(sum_, lambda c: decode(c, r)))
                self.arrays.add(array)  # the first solution is kept: later passes would see literals in the checksum
                if rotation is None and not self.removes:
                    return False
                table.rotation = rotation or 0  # unsolved keyed arrays are decoded as they stand
                self.known[f.name.symbol] = table
                if self.removes:
                    for i, b in enumerate(body):
                        if b is s or b is f:
                            forget(b)
                            body[i] = empty()
                        elif b is statement:
                            body[i] = self.without(b, array)
                return True
        return False

    @staticmethod
    def without(s: Node, array: Symbol) -> Node:
        """The statement without the rotating call."""
        x = bare(s.expression)
        if x.kind == "Sequence":
            left = [i for i in x.items if not rotator(i, array)]
            for i in x.items:
                if i not in left:
                    forget(i)
            if left:
                return Node("ExpressionStatement", expression=left[0] if len(left) == 1 else Node("Sequence", items=left))
            return empty()
        forget(s)
        return empty()

    def discover(self, body: list[Node]) -> bool:
        """Aliases and wrappers of known decoders in this list."""
        found = False
        for s in body:
            d = single(s)
            if d is not None and d.init is not None and d.init.kind == "Identifier" and d.init.symbol in self.known and d.target.symbol is not None and d.target.symbol not in self.known and d.target.symbol.stable:
                self.known[d.target.symbol] = self.known[d.init.symbol]
                found = True
            if self.keyed and s.kind == "FunctionDeclaration" and s.name is not None and s.name.symbol is not None and s.name.symbol not in self.known and (w := wrapper_of(s, self.known)):
                inner, places = w
                # A wrapper of a wrapper takes over the outer mapping alone.
                self.known[s.name.symbol] = Wrapper(inner if isinstance(inner, Table) else inner.table, places, len(s.params))
                found = True
        return found

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Call" or x.callee.kind != "Identifier" or x.callee.symbol not in self.known:
            return None
        text = self.known[x.callee.symbol].get(x.arguments)
        if text is None:
            return None
        forget(x)
        return v.to_node(text)


class StringArrayRotation(_Shuffled):
    """Plain strings. Nothing is removed, and a list never counts as changed."""

    name = "StringArrayRotation"

    def is_decoder(self, f: Node, array: Symbol) -> bool:
        return bool(f.params) and calls(f, array) and shift_of(f) is not None and alphabet_of(f) is None and not mentions(f, lambda n: n.kind == "String" and n.value.startswith(v.LOWER_FIRST))

    def enter_statements(self, body: list[Node]) -> bool:
        self.learn(body)
        self.discover(body)
        return False


class StringArrayRC4Decoder(_Shuffled):
    """Strings in base64 and RC4, each call with its key. Finding a wrapper counts as a change."""

    name = "StringArrayRC4Decoder"
    least = LEAST_RC4
    keyed = True
    removes = True

    def is_decoder(self, f: Node, array: Symbol) -> bool:
        return len(f.params) == 2 and calls(f, array) and mentions(f, lambda n: n.kind == "String" and n.value.startswith(v.LOWER_FIRST))

    def enter_statements(self, body: list[Node]) -> bool:
        changed = self.learn(body)
        return self.discover(body) or changed
