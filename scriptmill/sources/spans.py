"""Where nodes stand in their source: spans for edits that leave the rest of a script as it is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from scriptmill.kernel.parser import Parser
from scriptmill.kernel.tree import Node
from scriptmill.sources import facts

SPANS = "node_id int, first int, last int, short boolean"


class _Spanned(Parser):
    """Notes where statements, names, literals and expressions up to assignments begin and end."""

    def _noted(self, f: Callable[[], Node]) -> Node:
        begin = self.start
        x = f()
        if not hasattr(x, "span"):
            x.span = (begin, self.previous_end)
        return x

    def statement(self) -> Node:
        return self._noted(super().statement)

    def assignment(self) -> Node:
        return self._noted(super().assignment)

    def conditional(self) -> Node:
        return self._noted(super().conditional)

    def unary(self) -> Node:
        return self._noted(super().unary)

    def primary(self) -> Node:
        return self._noted(super().primary)

    def binding_name(self) -> Node:
        return self._noted(super().binding_name)

    def key(self) -> tuple[Node, bool]:
        begin = self.start
        x, computed = super().key()
        x.span = (begin, self.previous_end)
        return x, computed


def span_rows(source: str) -> Iterator[tuple]:
    """(node, first byte, byte after the last, whether a name is also its property's key); nodes are numbered as facts.nodes does."""
    program = _Spanned(source).program()
    byte = range(len(source) + 1) if source.isascii() else list(accumulate((len(c.encode("utf-8", "replace")) for c in source), initial=0))
    short: set[int] = set()  # nodes that stand for a name that is its property's key
    for n, parent, slot, _, x in facts._number_nodes(program):
        if x.kind == "Property" and x.short:
            short.add(n)
            name = x.value.target if x.value.kind == "Default" else x.value
            if name.kind == "Identifier" and hasattr(x.key, "span"):
                name.span = x.key.span
        if x.kind == "Default" and parent in short:
            short.add(n)
        if (span := getattr(x, "span", None)) is not None:
            yield n, byte[span[0]], byte[span[1]], x.kind == "Identifier" and parent in short and slot in ("value", "target")


def spans(scripts: DataFrame, key: str = "script_id", source: str = "source") -> DataFrame:
    """(key, node_id, first, last, short): places in the UTF-8 bytes of the source. Calls and members within longer ones have none."""
    return facts._table(scripts, key, source, SPANS, None, span_rows)
