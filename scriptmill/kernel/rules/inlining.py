"""Rules that replace names by what they stand for, and rules that remove what nothing uses."""

from __future__ import annotations

from scriptmill.kernel import values as v
from scriptmill.kernel.fixpoint import FINALIZE, FIRST, LAST, Rule
from scriptmill.kernel.scope import Symbol, forget
from scriptmill.kernel.tree import Node, bare, empty


class ConstantInlining(Rule):
    """Names that qualified once stay inlinable, whatever happens to them later."""

    name = "ConstantInlining"
    priority = FIRST
    interests = ("statements", "Identifier")

    def __init__(self):
        super().__init__()
        self.constants: dict[Symbol, object] = {}

    @staticmethod
    def value(x: Node | None) -> object:
        if x is None:
            return v.NOTHING
        if x.kind == "Unary" and x.op == "void" and x.value.kind == "Number":
            return v.UNDEFINED
        return v.literal(x)

    def take(self, d: Node) -> bool:
        if d.target.kind != "Identifier" or d.target.symbol is None:
            return False
        s, value = d.target.symbol, self.value(d.init)
        if value is v.NOTHING or not s.stable or not s.refs:
            return False
        self.constants[s] = value
        return True

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            if s.kind == "VariableDeclaration":
                taken = [self.take(d) for d in s.declarations]
                if taken and all(taken):
                    body[i] = empty()
                    changed = True
            elif s.kind == "For" and s.init is not None and s.init.kind == "VariableDeclaration":
                for d in s.init.declarations:
                    if self.take(d):
                        d.init = None
                        changed = True
            elif s.kind in ("ForIn", "ForOf") and s.left.kind == "VariableDeclaration":
                for d in s.left.declarations:
                    self.take(d)
        return changed

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Identifier" or x.symbol not in self.constants or x not in x.symbol.refs:
            return None
        del x.symbol.refs[x]
        return v.to_node(self.constants[x.symbol])


class ProxyFunctionInlining(Rule):
    """A function that only returns a parameter, an operator on its two, or a call of its first."""

    name = "ProxyFunctionInlining"
    priority = FIRST
    interests = ("statements", "Call")

    def __init__(self):
        super().__init__()
        self.proxies: dict[Symbol, tuple] = {}

    @staticmethod
    def shape(f: Node) -> tuple | None:
        if f.is_async or f.star or any(p.kind != "Identifier" for p in f.params) or len(f.body.body) != 1 or f.body.body[0].kind != "Return" or f.body.body[0].value is None:
            return None
        symbols = [p.symbol for p in f.params]
        x = bare(f.body.body[0].value)
        place = lambda n: symbols.index(n.symbol) if n.kind == "Identifier" and n.symbol in symbols else None
        n = len(symbols)
        if x.kind == "Identifier" and place(x) is not None:
            return "identity", n, place(x), None
        if x.kind == "Binary" and n == 2:
            a, b = place(bare(x.left)), place(bare(x.right))
            if a is not None and b is not None and a != b:
                return "binary", n, a, x.op
        if x.kind == "Call" and n and place(x.callee) == 0 and [place(a) for a in x.arguments] == list(range(1, n)):
            return "call", n, 0, None
        return None

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            if s.kind != "FunctionDeclaration" or s.name is None or s.name.symbol is None or s.name.symbol.writes:
                continue
            shape = self.shape(s)
            if shape is None or not s.name.symbol.refs:
                continue
            self.proxies[s.name.symbol] = shape
            forget(s)
            body[i] = empty()
            changed = True
        return changed

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Call" or x.callee.kind != "Identifier" or x.callee.symbol not in self.proxies:
            return None
        kind, n, at, op = self.proxies[x.callee.symbol]
        a, x.arguments = x.arguments, []
        if len(a) != n or any(i.kind == "Spread" for i in a):
            for i in a:
                forget(i)
            return None
        if kind == "identity":
            new = a[at]
        elif kind == "binary":
            new = Node("Binary", op=op, left=a[at], right=a[1 - at])
        else:
            new = Node("Call", callee=a[0], arguments=a[1:], optional=False)
        for i in a:
            forget(i, new)
        forget(x, new)
        return new


def pure_statement(s: Node) -> bool:
    if s.kind != "ExpressionStatement":
        return False
    x = s.expression

    def pure(x: Node) -> bool:
        x = bare(x)
        if x.kind == "String":
            return not x.value.startswith("use ")
        if x.kind == "Unary":
            return x.op in ("void", "typeof") and pure(x.value)
        return x.kind in ("Number", "Boolean", "Null") or x.kind == "Identifier" and x.name in ("undefined", "NaN", "Infinity")

    return pure(x)


class DeadCode(Rule):
    """Reports a change only where a list's length has changed."""

    name = "DeadCode"
    phase = FINALIZE
    interests = ("statements",)
    TERMINAL = frozenset(("Return", "Throw", "Break", "Continue"))

    def enter_statements(self, body: list[Node]) -> bool:
        length = len(body)
        end = next((i for i, s in enumerate(body) if s.kind in self.TERMINAL), len(body))
        kept = body[: end + 1]
        for s in body[end + 1 :]:
            if s.kind == "FunctionDeclaration":
                kept.append(s)
            elif s.kind == "VariableDeclaration" and s.word == "var":
                for d in s.declarations:
                    d.init = None
                kept.append(s)
            else:
                forget(s)
        out = []
        for s in kept:
            if pure_statement(s):
                forget(s)
            elif s.kind == "Block" and s.body and not any(c.kind == "VariableDeclaration" and c.word != "var" for c in s.body):
                out += [c for c in s.body if c.kind != "Empty"]
            elif s.kind != "Empty":
                out.append(s)
        body[:] = out
        return len(body) != length


class UnusedVariable(Rule):
    name = "UnusedVariable"
    phase = FINALIZE
    interests = ("statements",)

    @staticmethod
    def pure(x: Node | None) -> bool:
        """Literals, arrays of them and unary operators on them; the name undefined isn't one."""
        if x is None:
            return True
        x = bare(x)
        if x.kind == "Array":
            return all(i is not None and i.kind != "Spread" and UnusedVariable.pure(i) for i in x.items)
        return UnusedVariable.pure(x.value) if x.kind == "Unary" else v.is_literal(x)

    def unused(self, d: Node) -> bool:
        return d.target.kind == "Identifier" and d.target.symbol is not None and not d.target.symbol.refs and self.pure(d.init)

    def prune(self, s: Node) -> bool:
        """Whether declarators went."""
        left = [d for d in s.declarations if not self.unused(d)]
        changed = len(left) != len(s.declarations)
        s.declarations = left
        return changed

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            if s.kind == "VariableDeclaration":
                if self.prune(s):
                    changed = True
                    if not s.declarations:
                        body[i] = empty()
            elif s.kind == "For" and s.init is not None and s.init.kind == "VariableDeclaration":
                if self.prune(s.init):
                    changed = True
                    if not s.init.declarations:
                        s.init = None
            elif s.kind == "FunctionDeclaration" and s.name is not None and s.name.symbol is not None:
                if not s.name.symbol.refs and not s.name.symbol.scope.top:
                    forget(s)
                    body[i] = empty()
                    changed = True
        return changed


class VariableRenaming(Rule):
    """Declared for the order of the set; renames nothing."""

    name = "VariableRenaming"
    phase = FINALIZE
    priority = LAST
