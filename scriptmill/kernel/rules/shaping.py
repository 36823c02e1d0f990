"""Rules that bring statements and expressions to plain forms."""

from __future__ import annotations

import re

from scriptmill.kernel import values as v
from scriptmill.kernel.fixpoint import FIRST, Rule
from scriptmill.kernel.scope import forget
from scriptmill.kernel.tree import Node, bare, block, empty, expression_statement, identifier, negated

GLOBALS = ("window", "self", "globalThis")
_PLAIN_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


def single(s: Node) -> Node | None:
    """The only declarator of a declaration, if it declares one plain name."""
    if s.kind == "VariableDeclaration" and len(s.declarations) == 1 and s.declarations[0].target.kind == "Identifier":
        return s.declarations[0]
    return None


class VariableDeclarationSplit(Rule):
    name = "VariableDeclarationSplit"
    priority = FIRST
    interests = ("statements",)

    def enter_statements(self, body: list[Node]) -> bool:
        if not any(s.kind == "VariableDeclaration" and len(s.declarations) > 1 for s in body):
            return False
        body[:] = [Node("VariableDeclaration", word=s.word, declarations=[d]) if s.kind == "VariableDeclaration" else s for s in body for d in (s.declarations if s.kind == "VariableDeclaration" else (None,))]
        return True


class VarHoisting(Rule):
    name = "VarHoisting"
    priority = FIRST
    interests = ("statements",)

    def enter_statements(self, body: list[Node]) -> bool:
        hoists = [s.kind == "VariableDeclaration" and s.word == "var" and all(d.init is None for d in s.declarations) for s in body]
        new = [s for s, h in zip(body, hoists) if h] + [s for s, h in zip(body, hoists) if not h]
        if all(a is b for a, b in zip(new, body)):
            return False
        body[:] = new
        return True


class GlobalAliasSimplification(Rule):
    name = "GlobalAliasSimplification"
    priority = FIRST
    interests = ("statements", "Member")

    def __init__(self):
        super().__init__()
        self.aliases: set = set()

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            if s.kind != "VariableDeclaration":
                continue
            own = [d.target.symbol for d in s.declarations if d.target.kind == "Identifier" and d.target.symbol is not None and d.target.symbol.stable and d.init is not None and d.init.kind == "Identifier" and d.init.name in GLOBALS]
            self.aliases.update(own)
            if own and len(own) == len(s.declarations):
                forget(s)
                body[i] = empty()
                changed = True
        return changed

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Member" or x.object.kind != "Identifier" or x.object.symbol not in self.aliases or x.name.startswith("#"):
            return None
        forget(x)
        return identifier(x.name)


class DeclarationMerge(Rule):
    name = "DeclarationMerge"
    priority = FIRST
    interests = ("statements",)

    @staticmethod
    def constant(x: Node) -> bool:
        if x.kind == "Unary":
            return x.op in ("-", "void") and x.value.kind == "Number"
        return v.literal(x) is not v.NOTHING

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            d = single(s)
            if d is None or d.init is not None or d.target.symbol is None:
                continue
            symbol = d.target.symbol
            if symbol.writes != 1 or symbol.redeclared:
                continue
            for j in range(i + 1, len(body)):
                x = body[j].expression if body[j].kind == "ExpressionStatement" else None
                if x is None or x.kind != "Assignment" or x.op != "=" or x.target.kind != "Identifier" or x.target.symbol is not symbol:
                    continue
                if self.constant(x.value):
                    d.init = x.value
                    forget(x.target)
                    body[j] = empty()
                    changed = True
                break
        return changed


class BlockNormalization(Rule):
    name = "BlockNormalization"
    interests = ("If", "For", "ForIn", "ForOf", "While", "DoWhile")

    def enter_statement(self, s: Node) -> Node | None:
        if s.kind not in self.interests:
            return None
        changed = False
        for f in ("then", "other") if s.kind == "If" else ("body",):
            b = getattr(s, f)
            if b is not None and b.kind != "Block" and not (f == "other" and b.kind == "If"):
                setattr(s, f, block([b]))
                changed = True
        return s if changed else None


class Comma(Rule):
    name = "Comma"
    interests = ("Sequence",)

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Sequence" or not all(i.kind == "Identifier" or v.is_literal(i) for i in x.items[:-1]):
            return None
        forget(x, x.items[-1])
        return x.items[-1]


class Member(Rule):
    name = "Member"
    interests = ("Index", "Assignment")

    @staticmethod
    def plain(x: Node) -> Node | None:
        if x.kind != "Index" or x.index.kind != "String" or not _PLAIN_NAME.fullmatch(x.index.value):
            return None
        return Node("Member", object=x.object, name=x.index.value, optional=x.optional)

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind == "Assignment":
            new = self.plain(x.target)
            if new is None:
                return None
            x.target = new
            return x
        return self.plain(x)


class ControlFlow(Rule):
    name = "ControlFlow"
    interests = ("Conditional", "If")

    @staticmethod
    def known(x: Node) -> bool | None:
        return v.truthy(x) if v.is_literal(bare(x)) else None

    def enter_expression(self, x: Node) -> Node | None:
        if x.kind != "Conditional":
            return None
        then, other, test = self.known(x.then), self.known(x.other), self.known(x.test)
        if then is True and other is False:
            new = x.test
        elif then is False and other is True:
            new = negated(x.test)
        elif test is not None:
            new = x.then if test else x.other
        else:
            return None
        forget(x, new)
        return new

    def enter_statement(self, s: Node) -> Node | None:
        if s.kind != "If":
            return None
        test = self.known(s.test)
        if test is not None:
            new = (s.then if test else s.other) or empty()
            if new.kind == "Block" and len(new.body) == 1:
                new = new.body[0]
            forget(s, new)
            return new
        bare_block = lambda b: b.kind == "Block" and not b.body or b.kind == "Empty"
        if s.other is not None and bare_block(s.other):
            if bare_block(s.then):
                return expression_statement(s.test)
            s.other = None
            return s
        if bare_block(s.then):
            if s.other is None:
                return expression_statement(s.test)
            s.test, s.then, s.other = negated(s.test), s.other, None
            return s
        return None


class FunctionDeclaration(Rule):
    name = "FunctionDeclaration"
    interests = ("statements",)

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for i, s in enumerate(body):
            d = single(s)
            if d is None or d.init is None or d.init.kind != "Function" or d.init.name is not None:
                continue
            symbol = d.target.symbol
            if symbol is None or not symbol.stable:
                continue
            f = d.init
            body[i] = Node("FunctionDeclaration", name=d.target, params=f.params, body=f.body, is_async=f.is_async, star=f.star)
            changed = True
        return changed


class TernaryToIf(Rule):
    name = "TernaryToIf"
    interests = ("ExpressionStatement",)

    def enter_statement(self, s: Node) -> Node | None:
        if s.kind != "ExpressionStatement":
            return None
        x = bare(s.expression)
        if x.kind != "Conditional":
            return None
        return Node("If", test=x.test, then=block([expression_statement(x.then)]), other=block([expression_statement(x.other)]))


class LogicalToIf(Rule):
    """A statement a ?? b loses its expression without counting as changed; null stays until it is swept."""

    name = "LogicalToIf"
    interests = ("ExpressionStatement",)

    def enter_statement(self, s: Node) -> Node | None:
        if s.kind != "ExpressionStatement":
            return None
        x = bare(s.expression)
        if x.kind != "Logical":
            return None
        if x.op == "??":
            forget(x)
            s.expression = Node("Null")
            return None
        return Node("If", test=x.left if x.op == "&&" else negated(x.left), then=block([expression_statement(x.right)]), other=None)


class SequenceStatement(Rule):
    name = "SequenceStatement"
    interests = ("statements",)
    FIELD = {"ExpressionStatement": "expression", "Return": "value", "If": "test", "While": "test", "Throw": "value", "Switch": "subject", "For": "test"}

    def enter_statements(self, body: list[Node]) -> bool:
        out, changed = [], False
        for s in body:
            f = self.FIELD.get(s.kind)
            x = getattr(s, f) if f else None
            if x is not None and bare(x).kind == "Sequence":
                items = bare(x).items
                out += [expression_statement(i) for i in items[:-1]]
                setattr(s, f, items[-1])
                changed = True
            out.append(s)
        if changed:
            body[:] = out
        return changed
