"""Edits that keep the symbol table true: for users' own rules.

Each takes the place of what it changes as (owner, field) or (list, index), and drops the references that
are gone. New nodes bring none until they are made of old ones.
"""

from __future__ import annotations

from scriptmill.kernel.scope import Scope, Symbol, bound_names, forget, references, rename
from scriptmill.kernel.tree import Node, block, empty, expression_statement, void_zero, walk


def replace(owner: Node, field: str, new: Node) -> None:
    """Put another node in a field; references in the old tree that aren't in the new one go."""
    forget(getattr(owner, field), new)
    setattr(owner, field, new)


def replace_statement(body: list[Node], at: int, new: Node) -> None:
    forget(body[at], new)
    body[at] = new


def remove(owner: Node, field: str) -> None:
    """void 0 stands where the expression was."""
    replace(owner, field, void_zero())


def remove_statement(body: list[Node], at: int) -> None:
    replace_statement(body, at, empty())


def retain(body: list[Node], keep) -> None:
    """Empty statements stand where statements that aren't kept were."""
    for i, s in enumerate(body):
        if not keep(s):
            remove_statement(body, i)


def replace_with_several(body: list[Node], at: int, new: list[Node]) -> None:
    """One statement by many; by none, it becomes empty."""
    forget(body[at], block(list(new)))
    body[at : at + 1] = new or [empty()]


def insert(body: list[Node], at: int, s: Node) -> None:
    body.insert(at, s)


def append(body: list[Node], s: Node) -> None:
    body.append(s)


def insert_expression(body: list[Node], at: int, x: Node) -> None:
    body.insert(at, expression_statement(x))


def append_expression(body: list[Node], x: Node) -> None:
    body.append(expression_statement(x))


def create_block_statement(body: list[Node], scope: Scope) -> Node:
    """A block with a scope of its own below ``scope``; names that it declares by let, const, class or function go there."""
    own = Scope(scope, "block")
    for s in body:
        names = [n for d in s.declarations for n in bound_names(d.target)] if s.kind == "VariableDeclaration" and s.word != "var" else [s.name] if s.kind in ("FunctionDeclaration", "ClassDeclaration") and s.name is not None else []
        for n in names:
            old = n.symbol
            own.declare(n)
            if old is not None:
                for ref, how in list(old.refs.items()):
                    if any(ref is x for b in body for x in walk(b)):
                        del old.refs[ref]
                        ref.symbol = n.symbol
                        n.symbol.refs[ref] = how
                if not old.refs and old.scope.symbols.get(old.name) is old:
                    del old.scope.symbols[old.name]
    return block(body)


def replace_with_sequence(owner: Node, field: str, items: list[Node]) -> None:
    replace(owner, field, items[0] if len(items) == 1 else Node("Sequence", items=items))


def rename_binding(symbol: Symbol, name: str) -> None:
    """In the symbol table; nodes keep their text."""
    rename(symbol, name)


def collect_references(tree: Node) -> list[Node]:
    """The tree's references, those in nested functions too."""
    return references(tree)


def delete_references(tree: Node) -> None:
    forget(tree)
