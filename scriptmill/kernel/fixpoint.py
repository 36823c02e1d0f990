"""The rewriting loop: rules, their dispatch by node kind, passes to convergence."""

from __future__ import annotations

from dataclasses import dataclass, field

from scriptmill.kernel.parser import SyntaxFault, parse
from scriptmill.kernel.printer import render
from scriptmill.kernel.scope import Scope, analyse
from scriptmill.kernel.tree import EXPRESSIONS, FIELDS, STATEMENTS, Node

MAIN, FINALIZE = "main", "finalize"
FIRST, DEFAULT, LAST = 0, 1, 2
#: Passes after which a main loop that doesn't converge is stopped and reported.
PASS_LIMIT = 10_000
LISTS = frozenset(("Program", "Block", "Body", "Case", "StaticBlock"))


class Rule:
    """A rewrite. An object serves one script; its attributes are that script's state.

    enter_* and exit_* return None for no change, else the node to stand there (the same node, if it was
    changed in place). enter_statements changes the list in place and says whether it did.
    """

    name = "Rule"
    phase = MAIN
    priority = DEFAULT
    interests: tuple[str, ...] = ()  # kinds of nodes, and "statements" for lists

    def __init__(self):
        self.root: Scope | None = None

    def enter_expression(self, x: Node) -> Node | None:
        return None

    def exit_expression(self, x: Node) -> Node | None:
        return None

    def enter_statement(self, s: Node) -> Node | None:
        return None

    def exit_statement(self, s: Node) -> Node | None:
        return None

    def enter_statements(self, body: list[Node]) -> bool:
        return False


@dataclass
class Diagnostics:
    main_iterations: int = 0
    finalize_iterations: int = 0
    converged: bool = True
    modifications: list[int] = field(default_factory=list)
    nodes_visited: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def report(self) -> str:
        lines = [f"main iterations: {self.main_iterations}", f"finalize iterations: {self.finalize_iterations}"]
        return "\n".join(lines + [f"{n}: {m} modifications, {v} nodes visited" for n, m, v in zip(self.names, self.modifications, self.nodes_visited)])


@dataclass
class Result:
    code: str
    parse_ok: bool
    diagnostics: Diagnostics


class _Pass:
    def __init__(self, rules: list[Rule], phase: str, d: Diagnostics):
        self.by_kind: dict[str, list[tuple[int, Rule]]] = {}
        order = sorted((i for i, r in enumerate(rules) if r.phase == phase), key=lambda i: rules[i].priority)
        for i in order:
            for kind in rules[i].interests:
                self.by_kind.setdefault(kind, []).append((i, rules[i]))
        self.exits = any(type(r).exit_expression is not Rule.exit_expression or type(r).exit_statement is not Rule.exit_statement for r in rules)
        self.d = d
        self.changed = False

    def run(self, program: Node) -> bool:
        self.changed = False
        self.list(program.body)
        return self.changed

    def list(self, body: list[Node]) -> None:
        d = self.d
        for i, r in self.by_kind.get("statements", ()):
            d.nodes_visited[i] += 1
            if r.enter_statements(body):
                d.modifications[i] += 1
                self.changed = True
        for j in range(len(body)):
            body[j] = self.node(body[j])

    def event(self, n: Node, hook: str, count: bool) -> Node:
        d = self.d
        for i, r in self.by_kind.get(n.kind, ()):  # the kind is looked up once
            d.nodes_visited[i] += count
            new = getattr(r, hook)(n)
            if new is not None:
                d.modifications[i] += 1
                self.changed = True
                n = new
        return n

    def node(self, n: Node) -> Node:
        kind = "statement" if n.kind in STATEMENTS else "expression" if n.kind in EXPRESSIONS else None
        if kind and n.kind in self.by_kind:
            n = self.event(n, f"enter_{kind}", True)
        if n.kind in ("Binary", "Logical"):
            self.chain(n)
        else:
            self.below(n)
        if self.exits and kind and n.kind in self.by_kind:
            n = self.event(n, f"exit_{kind}", False)
        return n

    def chain(self, n: Node) -> None:
        """The operands of a left-leaning chain, entered like others, without recursion along it."""
        spine = [n]
        while True:
            top = spine[-1]
            if top.left.kind not in ("Binary", "Logical"):
                top.left = self.node(top.left)
                break
            top.left = self.event(top.left, "enter_expression", True)
            if top.left.kind not in ("Binary", "Logical"):
                self.below(top.left)
                if self.exits:
                    top.left = self.event(top.left, "exit_expression", False)
                break
            spine.append(top.left)
        for i in range(len(spine) - 1, -1, -1):
            spine[i].right = self.node(spine[i].right)
            if self.exits and i:
                spine[i - 1].left = self.event(spine[i], "exit_expression", False)

    def below(self, n: Node) -> None:
        k = n.kind
        if k in LISTS:
            if k == "Case" and n.test is not None:
                n.test = self.node(n.test)
            self.list(n.body)
            return
        for f in FIELDS.get(k, ()):
            x = getattr(n, f)
            if x is None or f == "name":
                continue
            if f in ("key",) and not n.computed:
                continue
            if f in ("target", "left", "param") and k in ("Declarator", "Assignment", "Update", "ForIn", "ForOf", "Try", "Default", "Rest") or f == "params":
                for t in x if isinstance(x, list) else (x,):
                    self.target(t)
            elif isinstance(x, list):
                for j, c in enumerate(x):
                    if c is not None:
                        x[j] = self.node(c)
            else:
                setattr(n, f, self.node(x))

    def target(self, t: Node) -> None:
        """Bindings and assignment targets are no expressions themselves; what they hold is."""
        k = t.kind
        if k == "VariableDeclaration":
            self.below(t)
        elif k in ("Member", "Index"):
            self.below(t)
        elif k == "Default":
            self.target(t.target)
            t.value = self.node(t.value)
        elif k == "Rest":
            self.target(t.target)
        elif k == "ArrayPattern":
            for i in t.items:
                if i is not None:
                    self.target(i)
        elif k == "ObjectPattern":
            for m in t.members:
                if m.kind == "Property" and m.computed:
                    m.key = self.node(m.key)
                self.target(m.target if m.kind == "Rest" else m.value)


def rewrite(source: str, rules: list[Rule], max_iterations: int | None = None, pass_limit: int = PASS_LIMIT, indent: str = "    ") -> Result:
    """The rewritten script; the source itself if it isn't a program."""
    d = Diagnostics(names=[r.name for r in rules], modifications=[0] * len(rules), nodes_visited=[0] * len(rules))
    try:
        program = parse(source)
        root = analyse(program)
    except (SyntaxFault, RecursionError, ValueError, OverflowError):
        return Result(source, False, d)
    for r in rules:
        r.root = root
    main, last = _Pass(rules, MAIN, d), _Pass(rules, FINALIZE, d)
    rounds = 0
    while max_iterations is None or rounds < max_iterations:
        rounds += 1
        for _ in range(pass_limit):
            if not main.run(program):
                break
            d.main_iterations += 1
        else:
            d.converged = False
            break
        d.finalize_iterations += 1
        if not last.run(program):
            break
        if rounds > pass_limit:
            d.converged = False
            break
    return Result(render(program, indent), True, d)
