"""Names and what they refer to: one analysis for each script, kept true while the tree changes."""

from __future__ import annotations

from scriptmill.kernel.tree import Node, children, walk


class Symbol:
    """A declared name. refs: the identifiers that resolve to it, each with r (read), w (write) or rw."""

    def __init__(self, name: str, scope: Scope):
        self.name, self.scope = name, scope
        self.redeclared = 0
        self.refs: dict[Node, str] = {}

    @property
    def writes(self) -> int:
        return sum("w" in how for how in self.refs.values())

    @property
    def stable(self) -> bool:
        """Never written after its declaration, and declared once."""
        return not self.redeclared and not self.writes


class Scope:
    def __init__(self, parent: Scope | None, kind: str):
        self.parent, self.kind = parent, kind
        self.symbols: dict[str, Symbol] = {}
        self.scopes: list[Scope] = []
        if parent is not None:
            parent.scopes.append(self)

    def declare(self, name: Node) -> None:
        symbol = self.symbols.get(name.name)
        if symbol is None:
            symbol = self.symbols[name.name] = Symbol(name.name, self)
        else:
            symbol.redeclared += 1
        name.symbol = symbol

    def find(self, name: str) -> Symbol | None:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.symbols:
                return scope.symbols[name]
            scope = scope.parent
        return None

    @property
    def top(self) -> bool:
        return self.parent is None


def bound_names(target: Node | None) -> list[Node]:
    """The identifiers that a binding pattern declares."""
    if target is None:
        return []
    if target.kind == "Identifier":
        return [target]
    if target.kind in ("Default", "Rest"):
        return bound_names(target.target)
    if target.kind == "ArrayPattern":
        return [n for i in target.items if i is not None for n in bound_names(i)]
    if target.kind == "ObjectPattern":
        return [n for m in target.members for n in bound_names(m.target if m.kind == "Rest" else m.value)]
    return []


def _vars(nodes: list[Node]) -> list[Node]:
    """var names and function-level declarations below, not entering functions."""
    out = []
    stack = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if n.kind == "VariableDeclaration" and n.word == "var":
            out += [x for d in n.declarations for x in bound_names(d.target)]
        if n.kind not in ("Function", "FunctionDeclaration", "Arrow", "Class", "ClassDeclaration"):
            stack.extend(reversed(list(children(n))))
    return out


class _Analysis:
    def __init__(self):
        self.unresolved: dict[str, list[Node]] = {}

    def lexical(self, body: list[Node], scope: Scope, functions: bool) -> None:
        for s in body:
            if s.kind in ("Export", "ExportDefault"):
                s = s.declaration
            if s.kind == "VariableDeclaration" and s.word != "var":
                for d in s.declarations:
                    for n in bound_names(d.target):
                        scope.declare(n)
            elif s.kind in ("ClassDeclaration", "FunctionDeclaration") and s.name is not None:
                scope.declare(s.name)
            elif s.kind == "Import":
                for name in s.locals:
                    scope.declare(Node("Identifier", name=name, symbol=None))

    def refer(self, n: Node, scope: Scope, how: str) -> None:
        symbol = scope.find(n.name)
        n.symbol = symbol
        if symbol is None:
            self.unresolved.setdefault(n.name, []).append(n)
        else:
            symbol.refs[n] = how

    def body(self, f: Node, outer: Scope) -> None:
        scope = Scope(outer, "function")
        if f.kind == "Function" and f.name is not None:
            named = Scope(outer, "name")
            named.declare(f.name)
            scope.parent = named
        for p in f.params:
            for n in bound_names(p):
                scope.declare(n)
        if f.body.kind == "Body":
            for n in _vars(f.body.body):
                scope.declare(n)
            self.lexical(f.body.body, scope, True)
        for p in f.params:
            self.binding(p, scope)
        if f.body.kind == "Body":
            for s in f.body.body:
                self.visit(s, scope)
        else:
            self.visit(f.body, scope)

    def binding(self, t: Node, scope: Scope) -> None:
        """Default values and computed keys of a declared pattern."""
        if t.kind == "Default":
            self.binding(t.target, scope)
            self.visit(t.value, scope)
        elif t.kind == "Rest":
            self.binding(t.target, scope)
        elif t.kind == "ArrayPattern":
            for i in t.items:
                if i is not None:
                    self.binding(i, scope)
        elif t.kind == "ObjectPattern":
            for m in t.members:
                if m.kind == "Property" and m.computed:
                    self.visit(m.key, scope)
                self.binding(m.target if m.kind == "Rest" else m.value, scope)

    def assigned(self, t: Node, scope: Scope, how: str) -> None:
        if t.kind == "Identifier":
            self.refer(t, scope, how)
        elif t.kind in ("Default", "Rest"):
            self.assigned(t.target, scope, how)
            if t.kind == "Default":
                self.visit(t.value, scope)
        elif t.kind == "ArrayPattern":
            for i in t.items:
                if i is not None:
                    self.assigned(i, scope, how)
        elif t.kind == "ObjectPattern":
            for m in t.members:
                if m.kind == "Property" and m.computed:
                    self.visit(m.key, scope)
                self.assigned(m.target if m.kind == "Rest" else m.value, scope, how)
        else:
            self.visit(t, scope)

    def inside(self, body: list[Node], scope: Scope) -> None:
        own = Scope(scope, "block")
        self.lexical(body, own, False)
        for s in body:
            self.visit(s, own)

    def visit(self, n: Node, scope: Scope) -> None:
        while True:  # along the left side of long operator chains
            k = n.kind
            if k == "Identifier":
                self.refer(n, scope, "r")
            elif k in ("Function", "FunctionDeclaration", "Arrow"):
                self.body(n, scope)
            elif k == "Block":
                self.inside(n.body, scope)
            elif k == "VariableDeclaration":
                for d in n.declarations:
                    self.binding(d.target, scope)
                    if d.init is not None:
                        self.visit(d.init, scope)
            elif k in ("For", "ForIn", "ForOf"):
                own = Scope(scope, "block")
                head = n.init if k == "For" else n.left
                if head is not None and head.kind == "VariableDeclaration" and head.word != "var":
                    for d in head.declarations:
                        for x in bound_names(d.target):
                            own.declare(x)
                if k != "For" and head.kind != "VariableDeclaration":
                    self.assigned(head, own, "w")
                elif head is not None:
                    self.visit(head, own)
                for x in (n.test, n.update) if k == "For" else (n.right,):
                    if x is not None:
                        self.visit(x, own)
                self.visit(n.body, own)
            elif k == "Try":
                self.visit(n.block, scope)
                if n.handler is not None:
                    own = Scope(scope, "catch")
                    for x in bound_names(n.param):
                        own.declare(x)
                    if n.param is not None:
                        self.binding(n.param, own)
                    self.visit(n.handler, own)
                if n.finalizer is not None:
                    self.visit(n.finalizer, scope)
            elif k == "Switch":
                self.visit(n.subject, scope)
                own = Scope(scope, "block")
                self.lexical([s for c in n.cases for s in c.body], own, False)
                for c in n.cases:
                    if c.test is not None:
                        self.visit(c.test, own)
                    for s in c.body:
                        self.visit(s, own)
            elif k in ("Class", "ClassDeclaration"):
                own = Scope(scope, "class")
                if k == "Class" and n.name is not None:
                    own.declare(n.name)
                if n.base is not None:
                    self.visit(n.base, own)
                for m in n.members:
                    if m.kind == "StaticBlock":
                        self.inside(m.body, own)
                        continue
                    if m.computed:
                        self.visit(m.key, own)
                    if m.value is not None:
                        self.visit(m.value, own)
            elif k == "Assignment":
                self.assigned(n.target, scope, "w" if n.op == "=" else "rw")
                n = n.value
                continue
            elif k == "Update":
                self.assigned(n.target, scope, "rw")
            elif k == "Property":
                if n.computed:
                    self.visit(n.key, scope)
                n = n.value
                continue
            elif k == "ExportList":
                if n.source is None:
                    for a, _ in n.names:
                        self.refer(Node("Identifier", name=a, symbol=None), scope, "r")
            elif k in ("Binary", "Logical"):
                self.visit(n.right, scope)
                n = n.left
                continue
            else:
                for c in children(n):
                    self.visit(c, scope)
            return


def analyse(program: Node) -> Scope:
    root = Scope(None, "program")
    a = _Analysis()
    for n in _vars([s.declaration if s.kind == "Export" else s for s in program.body]):
        root.declare(n)
    a.lexical(program.body, root, True)
    for s in program.body:
        a.visit(s, root)
    return root


# -- keeping references true ------------------------------------------------------------------------------------------


def references(node: Node) -> list[Node]:
    """Identifiers in the tree that count as references."""
    return [n for n in walk(node) if n.kind == "Identifier" and n.symbol is not None and n in n.symbol.refs]


def forget(old: Node, new: Node | None = None) -> None:
    """Drop the references in old that aren't in new."""
    kept = set(map(id, walk(new))) if new is not None else ()
    for n in references(old):
        if id(n) not in kept:
            del n.symbol.refs[n]


def rename(symbol: Symbol, name: str) -> None:
    """Rename a binding in the table; its nodes keep their text."""
    symbol.scope.symbols.pop(symbol.name, None)
    symbol.name = name
    symbol.scope.symbols[name] = symbol
