"""Rules that put control flow back in order, and a few that undo single tricks."""

from __future__ import annotations

from scriptmill.kernel import values as v
from scriptmill.kernel.fixpoint import FIRST, Rule
from scriptmill.kernel.rules.shaping import single
from scriptmill.kernel.scope import Symbol, forget
from scriptmill.kernel.tree import Node, bare, empty, format_number, number, void_zero, walk


def assigned_number(s: Node, symbol: Symbol, op: str = "=") -> float | None:
    """N of the statement ``symbol = N``."""
    if s.kind != "ExpressionStatement":
        return None
    x = bare(s.expression)
    if x.kind != "Assignment" or x.op != op or x.target.kind != "Identifier" or x.target.symbol is not symbol:
        return None
    n = v.evaluate(x.value)
    return n if isinstance(n, float) else None


def flat(body: list[Node]) -> list[Node]:
    """Statements, a lone block's own instead of it."""
    return flat(body[0].body) if len(body) == 1 and body[0].kind == "Block" else body


def ends(s: Node) -> bool:
    """Whether every path through the statement returns or throws."""
    if s.kind in ("Return", "Throw"):
        return True
    if s.kind == "Block":
        return any(map(ends, s.body))
    if s.kind == "If":
        return s.other is not None and ends(s.then) and ends(s.other)
    return s.kind == "Try" and ends(s.block) and (s.handler is None or ends(s.handler))


class ControlFlowFlattening(Rule):
    """for (var ..., s = N; true;) { switch (s) {...} break; } in the order its states come."""

    name = "ControlFlowFlattening"
    priority = FIRST
    interests = ("statements",)

    def enter_statements(self, body: list[Node]) -> bool:
        out, changed = [], False
        for s in body:
            new = self.linear(s)
            changed = changed or new is not None
            out += [s] if new is None else new
        if changed:
            body[:] = out
        return changed

    def linear(self, s: Node) -> list[Node] | None:
        if s.kind != "For" or s.update is not None or s.init is None or s.init.kind != "VariableDeclaration" or s.test is None or bare(s.test).kind != "Boolean" or not bare(s.test).value or s.body.kind != "Block":
            return None
        inner = [b for b in s.body.body if b.kind != "Empty"]
        if len(inner) != 2 or inner[0].kind != "Switch" or inner[1].kind != "Break" or bare(inner[0].subject).kind != "Identifier":
            return None
        switch = inner[0]
        symbol = bare(switch.subject).symbol
        head = next((d for d in s.init.declarations if d.target.kind == "Identifier" and d.target.symbol is symbol), None)
        first = v.evaluate(head.init) if head is not None and head.init is not None and symbol is not None else None
        if not isinstance(first, float):
            return None
        states: dict[float, int | None] = {}  # None: the end
        waiting: list[float] = []
        for i, c in enumerate(switch.cases):
            n = v.evaluate(c.test) if c.test is not None else None
            if isinstance(n, float):
                waiting.append(n)
            if c.body:
                for n in waiting:
                    states.setdefault(n, i)
                waiting = []
        for n in waiting:
            states.setdefault(n, None)
        out: list[Node] = []
        seen: set[int] = set()
        now: float | None = first
        while now is not None:
            if now not in states:
                return None
            i = states[now]
            if i is None:
                break
            if i in seen:
                return None
            seen.add(i)
            step = self.step(switch.cases[i].body, symbol)
            if step is None:
                return None
            code, now = step
            out += code
        others = [d for d in s.init.declarations if d is not head]
        kept = [Node("VariableDeclaration", word=s.init.word, declarations=others)] if others else []
        holder = Node("Block", body=kept + out)
        forget(s, holder)
        return kept + out

    @staticmethod
    def step(body: list[Node], symbol: Symbol) -> tuple[list[Node], float | None] | None:
        """A case's own statements and the next state (None: the end); nothing if the case says neither."""
        body = [b for b in flat(body) if b.kind != "Empty"]
        out: list[Node] = []
        to: float | None = None
        for b in body:
            n = assigned_number(b, symbol)
            if n is not None:
                to = n
            elif b.kind == "Continue" and b.label is None:
                break
            elif b.kind == "Break" and b.label is None:
                return out, None
            else:
                out.append(b)
                if ends(b):
                    return out, None
        return (out, to) if out or to is not None else None


def immediate(x: Node) -> Node | None:
    """The function of !function() {...}() or (function() {...})()."""
    x = bare(x)
    if x.kind == "Unary":
        x = bare(x.value)
    f = bare(x.callee) if x.kind == "Call" else None
    return f if f is not None and f.kind == "Function" else None


class ControlFlowArray(Rule):
    """s[x][y] of a table that a hash function builds, as the numbers it holds.

    The value is h(y, h(x, ROW)), h being (A*B ^ C*D ^ E*F) >>> 0 & (G - 1) with two of its arguments
    free, in 32-bit wrapping arithmetic. One table for each script.
    """

    name = "ControlFlowArray"
    priority = FIRST
    interests = ("statements", "Index")

    def __init__(self):
        super().__init__()
        self.target: Symbol | None = None
        self.hash = None
        self.row = 0

    @staticmethod
    def shape(f: Node) -> tuple[list[tuple[int, int]], int] | None:
        """Places of the parameters that are multiplied, and of the one that gives the mask."""
        if f.kind != "FunctionDeclaration" or len(f.params) < 7 or len(f.body.body) != 1 or f.body.body[0].kind != "Return":
            return None
        symbols = [p.symbol if p.kind == "Identifier" else None for p in f.params]
        place = lambda x: symbols.index(x.symbol) if x.kind == "Identifier" and x.symbol in symbols else None
        x = bare(f.body.body[0].value) if f.body.body[0].value is not None else None
        if x is None or x.kind != "Binary" or x.op != "&":
            return None
        shift, mask = bare(x.left), bare(x.right)
        if shift.kind != "Binary" or shift.op != ">>>" or v.evaluate(shift.right) != 0 or mask.kind != "Binary" or mask.op != "-" or v.evaluate(mask.right) != 1 or place(bare(mask.left)) is None:
            return None
        pairs, stack = [], [bare(shift.left)]
        while stack:
            n = bare(stack.pop())
            if n.kind == "Binary" and n.op == "^":
                stack += [n.left, n.right]
            elif n.kind == "Binary" and n.op == "*" and place(bare(n.left)) is not None and place(bare(n.right)) is not None:
                pairs.append((place(bare(n.left)), place(bare(n.right))))
            else:
                return None
        return (pairs, place(bare(mask.left))) if len(pairs) == 3 else None

    def find(self, f: Node, body: list[Node]) -> tuple[Node, tuple, Symbol, int] | None:
        """The building call, its hash's arguments, the variable it fills and the row that it takes."""
        for s in body:
            if s.kind != "ExpressionStatement":
                continue
            g = immediate(s.expression)
            if g is None:
                return None  # the search ends at the first other expression statement
            arguments = None
            for inner in g.body.body:
                if inner.kind == "FunctionDeclaration" and arguments is None:
                    for n in walk(inner.body):
                        if n.kind == "Call" and bare(n.callee).kind == "Identifier" and bare(n.callee).symbol is f.name.symbol:
                            arguments = n.arguments
                            break
            if arguments is None:
                return None
            own = [v.evaluate(a) for a in arguments]
            free = [i for i, a in enumerate(own) if not isinstance(a, float)]
            if len(free) != 2:
                return None
            for n in walk(g.body):
                if n.kind in ("Function", "Arrow") and n.body.kind == "Body":
                    for b in n.body.body:
                        x = bare(b.expression) if b.kind == "ExpressionStatement" else None
                        if x is not None and x.kind == "Assignment" and x.op == "=" and x.target.kind == "Identifier" and x.target.symbol is not None and bare(x.value).kind == "Index":
                            row = v.evaluate(bare(x.value).index)
                            if isinstance(row, float):
                                return s, (own, free), x.target.symbol, int(row)
            return None
        return None

    def value(self, x: int, y: int) -> int:
        pairs, mask, own, (column, row) = self.hash

        def h(c: int, r: int) -> int:
            a = [0 if not isinstance(n, float) else v.uint32(n) for n in own]
            a[column], a[row] = c, r
            out = 0
            for i, j in pairs:
                out ^= a[i] * a[j] % 2**32
            return out & (a[mask] - 1)

        return h(y, h(x, self.row))

    def enter_statements(self, body: list[Node]) -> bool:
        if self.target is not None:
            return False
        for s in body:
            shape = self.shape(s)
            if shape is None or s.name is None:
                continue
            found = self.find(s, body)
            if found is None:
                return False
            call, (own, free), target, row = found
            size = own[shape[1]] if shape[1] < len(own) else None
            if not isinstance(size, float) or size < 2 or int(size) & (int(size) - 1) or max(i for p in shape[0] for i in p) >= len(own):
                return False
            self.hash, self.row = (*shape, own, free), row
            if self.value(0, 0) == self.value(0, 1):
                self.hash = (*shape, own, free[::-1])
            self.target = target
            for i, b in enumerate(body):
                d = single(b)
                if b is s or b is call or d is not None and d.init is None and d.target.symbol is target:
                    forget(b)
                    body[i] = empty()
            return True
        return False

    @staticmethod
    def index(x: Node) -> int | None:
        n = x.value if x.kind == "Number" else v.numeric_text(x.value) if x.kind == "String" and x.value.isdigit() else None
        return int(n) if n is not None and n == int(n) and 0 <= n <= 255 else None

    def enter_expression(self, x: Node) -> Node | None:
        if self.target is None or x.kind != "Index" or x.object.kind != "Index" or x.object.object.kind != "Identifier" or x.object.object.symbol is not self.target:
            return None
        inner, outer = x.object.index, x.index
        a, b = self.index(inner), self.index(outer)
        if (a is None and inner.kind != "Null") or (b is None and outer.kind != "Null"):
            return None
        forget(x)
        return void_zero() if a is None or b is None else number(self.value(a, b))


class InitializerInlining(Rule):
    """A function of literal assignments that is called once, as a statement beside it: its body goes there."""

    name = "InitializerInlining"
    priority = FIRST
    interests = ("statements",)

    @classmethod
    def constant(cls, x: Node) -> bool:
        x = bare(x)
        if x.kind == "Array":
            return all(i is not None and cls.constant(i) for i in x.items)
        if x.kind == "Unary" and x.op in ("-", "+"):
            return v.is_literal(bare(x.value))
        return v.is_literal(x)

    def enter_statements(self, body: list[Node]) -> bool:
        for i, f in enumerate(body):
            if f.kind != "FunctionDeclaration" or f.params or f.name is None or f.name.symbol is None or len(f.name.symbol.refs) != 1 or not f.body.body or f.is_async or f.star:
                continue
            if not all(b.kind == "ExpressionStatement" and bare(b.expression).kind == "Assignment" and bare(b.expression).op == "=" and bare(b.expression).target.kind == "Identifier" and self.constant(bare(b.expression).value) for b in f.body.body):
                continue
            for j, s in enumerate(body):
                x = bare(s.expression) if s.kind == "ExpressionStatement" else None
                if x is not None and x.kind == "Call" and x.callee.kind == "Identifier" and x.callee.symbol is f.name.symbol and not x.arguments:
                    forget(s)
                    inner, f.body.body = f.body.body, [empty() for _ in f.body.body]
                    body[j : j + 1] = inner
                    return True
        return False


class SwitchDispatch(Rule):
    """function f(state, ...) { while (state != EXIT) { switch (state) {...} } } as one function for each entry.

    Statements are moved: what two entries share is left to the first.
    """

    name = "SwitchDispatch"
    interests = ("statements", "Call")
    PARAMETER = "Mh"  # fixed name

    def __init__(self):
        super().__init__()
        self.dispatchers: dict[Symbol, dict] = {}
        self.made: dict[tuple[Symbol, float], Symbol] = {}

    @staticmethod
    def machine(f: Node) -> tuple[Symbol, float, Node] | None:
        """State, exit value and switch."""
        if f.kind != "FunctionDeclaration" or not f.params or f.params[0].kind != "Identifier" or f.name is None or f.name.symbol is None:
            return None
        state = f.params[0].symbol
        for s in f.body.body:
            test = bare(s.test) if s.kind == "While" else None
            if test is None or test.kind != "Binary" or test.op not in ("!=", "!=="):
                continue
            a, b = bare(test.left), bare(test.right)
            if b.kind == "Identifier" and b.symbol is state:
                a, b = b, a
            end = v.evaluate(b)
            if a.kind != "Identifier" or a.symbol is not state or not isinstance(end, float):
                continue
            inner = [i for i in flat([s.body]) if i.kind != "Empty"]
            if len(inner) == 1 and inner[0].kind == "Switch" and bare(inner[0].subject).kind == "Identifier" and bare(inner[0].subject).symbol is state:
                return state, end, inner[0]
        return None

    @staticmethod
    def resolve(switch: Node, state: Symbol) -> bool:
        """state += k in a case of one known state becomes state = constant."""
        changed = False
        for c in switch.cases:
            now = v.evaluate(c.test) if c.test is not None else None
            if not isinstance(now, float):
                continue
            for n in walk(Node("Block", body=c.body)):
                if n.kind == "Assignment" and n.op in ("+=", "-=") and n.target.kind == "Identifier" and n.target.symbol is state:
                    k = v.evaluate(n.value)
                    if isinstance(k, float):
                        n.op, n.value = "=", number(now + k if n.op == "+=" else now - k)
                        if n.target in state.refs:
                            state.refs[n.target] = "w"
                        changed = True
        return changed

    @staticmethod
    def trace(entry: float, state: Symbol, end: float, switch: Node) -> list[tuple[Node, list[int]]] | None:
        """Cases in order with the places of their own statements; None for a cycle or an unknown state."""
        by_state = {v.evaluate(c.test): c for c in switch.cases if c.test is not None}
        out, seen, now = [], set(), entry
        while now != end:
            c = by_state.get(now)
            if c is None or now in seen:
                return None
            seen.add(now)
            body = flat(c.body)
            own, to, over = [], None, False
            for i, s in enumerate(body):
                n = assigned_number(s, state)
                if n is not None:
                    to = n
                elif s.kind in ("Break", "Continue") and s.label is None:
                    break
                elif s.kind != "Empty":
                    own.append(i)
                    over = over or ends(s)
                if over:
                    break
            out.append((c, own))
            if over:
                return out
            if to is None:
                return None
            now = to
        return out

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for f in body:
            m = self.machine(f)
            if m is not None:
                changed = self.resolve(m[2], m[0]) or changed
                self.dispatchers.setdefault(f.name.symbol, {"entries": []})
        if not self.dispatchers:
            return changed
        for s in body:
            for n in walk(s) if s.kind in ("ExpressionStatement", "VariableDeclaration", "Return", "If", "Block") else ():
                if n.kind == "Call" and n.callee.kind == "Identifier" and n.callee.symbol in self.dispatchers and n.arguments:
                    entry = v.evaluate(n.arguments[0])
                    entries = self.dispatchers[n.callee.symbol]["entries"]
                    if isinstance(entry, float) and entry not in entries:
                        entries.append(entry)
        i = 0
        while i < len(body):
            f, m = body[i], self.machine(body[i])
            i += 1
            if m is None:
                continue
            state, end, switch = m
            for entry in self.dispatchers[f.name.symbol]["entries"]:
                key = (f.name.symbol, entry)
                if key in self.made:
                    continue
                steps = self.trace(entry, state, end, switch)
                if steps is None:
                    continue
                moved = []
                for c, places in steps:
                    own = flat(c.body)
                    for p in places:
                        moved.append(own[p])
                        own[p] = empty()
                if not moved:
                    continue
                name = Node("Identifier", name=f"{f.name.name}_{format_number(entry)}", symbol=None)
                f.name.symbol.scope.declare(name)
                self.made[key] = name.symbol
                parameter = Node("Identifier", name=self.PARAMETER, symbol=None)
                body.insert(i, Node("FunctionDeclaration", name=name, params=[parameter], body=Node("Body", directives=[], body=moved), is_async=False, star=False))
                i += 1
                changed = True
        return changed

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Call" or x.callee.kind != "Identifier" or not x.arguments:
            return None
        new = self.made.get((x.callee.symbol, v.evaluate(x.arguments[0]))) if x.callee.symbol in self.dispatchers else None
        if new is None:
            return None
        forget(x.callee)
        forget(x.arguments[0])
        x.callee = Node("Identifier", name=new.name, symbol=new)
        new.refs[x.callee] = "r"
        x.arguments = x.arguments[1:]
        return x


class SetTimeoutUnwrap(Rule):
    """setTimeout(function() { x = literal; }, 0) as x = literal."""

    name = "SetTimeoutUnwrap"
    priority = FIRST
    interests = ("ExpressionStatement",)

    def enter_statement(self, s: Node) -> Node | None:
        x = s.expression if s.kind == "ExpressionStatement" else None
        if x is None or x.kind != "Call" or x.callee.kind != "Identifier" or x.callee.name != "setTimeout" or len(x.arguments) != 2:
            return None
        f, delay = x.arguments
        if f.kind != "Function" or f.params or delay.kind != "Number" or delay.value != 0 or len(f.body.body) != 1:
            return None
        inner = f.body.body[0]
        a = bare(inner.expression) if inner.kind == "ExpressionStatement" else None
        if a is None or a.kind != "Assignment" or a.op != "=" or a.target.kind != "Identifier":
            return None
        value = a.value
        if not (v.literal(value) is not v.NOTHING or value.kind == "Unary" and value.op in ("-", "void") and value.value.kind == "Number"):
            return None
        forget(s, inner)
        return inner


