"""Scripts as relations: one row for each node, scope, symbol and reference.

Each function takes a table with a key and a source column and runs the parser once for each script, in
Arrow batches; rows leave in bounded batches, so a long script needs no more memory than its own tree. The
table functions js_nodes, js_symbols and js_references do the same in SQL, laterally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scriptmill.kernel.parser import SyntaxFault, parse
from scriptmill.kernel.scope import Scope, analyse
from scriptmill.kernel.tree import FIELDS, Node
from scriptmill.session import scratch, shuffled

NODES = "node_id int, last_id int, parent_id int, slot string, ordinal int, kind string, op string, str_value string, num_value double, bool_value boolean, symbol_id int, is_write boolean"
SYMBOLS = "symbol_id int, scope_id int, name string, n_redeclared int, n_references int, n_writes int"
REFERENCES = "node_id int, symbol_id int, name string, is_write boolean"
SCOPES = "scope_id int, parent_scope_id int, kind string"
BATCH_ROWS = 20_000


def _scopes(root: Scope) -> list[Scope]:
    out, stack = [], [root]
    while stack:
        s = stack.pop()
        out.append(s)
        stack.extend(reversed(s.scopes))
    return out


def _numbered(root: Scope) -> dict:
    return {s: i for i, s in enumerate(x for scope in _scopes(root) for x in scope.symbols.values())}


def _last_ids(program: Node) -> list[int]:
    """For each node, the greatest id among it and what is below it."""
    parents = [parent for _, parent, _, _, _ in _number_nodes(program)]
    last = list(range(len(parents)))
    for i in range(len(parents) - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])
    return last


def _number_nodes(program: Node) -> Iterator[tuple[int, int | None, str | None, int, Node]]:
    """(id, parent's id, slot, ordinal, node) in source order."""
    stack: list[tuple[int | None, str | None, int, Node]] = [(None, None, 0, program)]
    n = 0
    while stack:
        parent, slot, ordinal, node = stack.pop()
        yield n, parent, slot, ordinal, node
        below = []
        for f in FIELDS.get(node.kind, ()):
            x = getattr(node, f)
            below += [(n, f, i, c) for i, c in enumerate(x if isinstance(x, list) else [x]) if c is not None]
        stack.extend(reversed(below))
        n += 1


def _binding(node: Node) -> tuple:
    """Symbol and whether it is written here; (None, None) if this is no reference."""
    s = node.symbol if node.kind == "Identifier" else None
    return (s, "w" in s.refs[node]) if s is not None and node in s.refs else (s, None)


def node_rows(program: Node, root: Scope) -> Iterator[tuple]:
    ids, last = _numbered(root), _last_ids(program)
    for n, parent, slot, ordinal, x in _number_nodes(program):
        symbol, write = _binding(x)
        value = getattr(x, "value", None)
        text = x.name if x.kind in ("Identifier", "Member", "KeyName", "PrivateName") and isinstance(x.name, str) else value if isinstance(value, str) else getattr(x, "raw", None) if x.kind in ("Regex", "BigInt") else None
        flags = " ".join(f for f, on in (("async", getattr(x, "is_async", False)), ("*", getattr(x, "star", False))) if on)
        yield (n, last[n], parent, slot, ordinal, x.kind, getattr(x, "op", None) or getattr(x, "word", None) or flags or None, text, value if isinstance(value, float) else None, value if isinstance(value, bool) else None, ids.get(symbol), write)


def symbol_rows(program: Node, root: Scope) -> Iterator[tuple]:
    place = {s: i for i, s in enumerate(_scopes(root))}
    for s, i in _numbered(root).items():
        yield i, place[s.scope], s.name, s.redeclared, len(s.refs), s.writes


def reference_rows(program: Node, root: Scope) -> Iterator[tuple]:
    ids = _numbered(root)
    declared = {"Declarator": ("target",), "Function": ("name", "params"), "FunctionDeclaration": ("name", "params"), "Arrow": ("params",), "Class": ("name",), "ClassDeclaration": ("name",), "Try": ("param",)}
    kinds: dict[int, str] = {}
    bound: set[int] = set()
    for n, parent, slot, _, x in _number_nodes(program):
        kinds[n] = x.kind
        if parent is not None and (slot in declared.get(kinds[parent], ()) or parent in bound and x.kind in ("Identifier", "Rest", "Default", "ArrayPattern", "ObjectPattern", "Property") and slot not in ("key",) and not (kinds[parent] == "Default" and slot == "value")):
            bound.add(n)
        if x.kind == "Identifier" and n not in bound:
            symbol, write = _binding(x)
            yield n, ids.get(symbol), x.name, bool(write)


def scope_rows(program: Node, root: Scope) -> Iterator[tuple]:
    place = {s: i for i, s in enumerate(_scopes(root))}
    for s, i in place.items():
        yield i, place.get(s.parent), s.kind


def _rows(source: str | None, f: Callable | None, whole: Callable | None = None) -> Iterator[tuple]:
    """No rows for null and for what is no program. ``whole`` parses for itself."""
    if source is None:
        return
    try:
        if whole is not None:
            yield from list(whole(source))
            return
        program = parse(source)
        root = analyse(program)
    except (SyntaxFault, RecursionError, ValueError, OverflowError):
        return
    yield from f(program, root)


def _table(scripts: DataFrame, key: str, source: str, columns: str, f: Callable | None, whole: Callable | None = None) -> DataFrame:
    key_type = dict(scripts.dtypes)[key]
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    types = [{"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(0).type
            keys: list = []
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                out = [pa.array(keys, kind), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))]
                keys.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(out, names)

            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in _rows(s, f, whole):
                    keys.append(k)
                    rows.append(r)
                    if len(rows) >= BATCH_ROWS:
                        yield flush()
            yield flush()

    return scripts.select(key, source).mapInArrow(run, f"{key} {key_type}, {columns}")


def nodes(scripts: DataFrame, key: str = "script_id", source: str = "source") -> DataFrame:
    return _table(scripts, key, source, NODES, node_rows)


def symbols(scripts: DataFrame, key: str = "script_id", source: str = "source") -> DataFrame:
    return _table(scripts, key, source, SYMBOLS, symbol_rows)


def references(scripts: DataFrame, key: str = "script_id", source: str = "source") -> DataFrame:
    """symbol_id is null for names that nothing declares."""
    return _table(scripts, key, source, REFERENCES, reference_rows)


def scopes(scripts: DataFrame, key: str = "script_id", source: str = "source") -> DataFrame:
    return _table(scripts, key, source, SCOPES, scope_rows)


@dataclass
class Facts:
    """All tables of a set of scripts, from one pass of the parser."""

    nodes: DataFrame
    symbols: DataFrame
    references: DataFrame
    scopes: DataFrame


#: A row's table, and its columns.
KINDS: dict[str, tuple[str, Callable]] = {"nodes": (NODES, node_rows), "symbols": (SYMBOLS, symbol_rows), "references": (REFERENCES, reference_rows), "scopes": (SCOPES, scope_rows)}


def every(scripts: DataFrame, key: str = "script_id", source: str = "source") -> Facts:
    """Parses each script once and writes what it finds, a folder for each table: plans that read several tables, or one several
    times, don't parse again. The tables lie where session.written puts others."""
    columns = {c.split()[0]: c for table, _ in KINDS.values() for c in table.split(", ")}
    places = {name: [list(columns).index(c.split()[0]) for c in table.split(", ")] for name, (table, _) in KINDS.items()}

    def rows(program: Node, root: Scope) -> Iterator[tuple]:
        for name, (_, f) in KINDS.items():
            for r in f(program, root):
                out = [None] * len(columns) + [name]
                for at, x in zip(places[name], r):
                    out[at] = x
                yield tuple(out)

    tagged = _table(scripts, key, source, ", ".join([*columns.values(), "fact string"]), rows)
    path = scratch(scripts.sparkSession)
    seen = Observation()
    tagged.observe(seen, *[F.count(F.when(F.col("fact") == name, 1)).alias(name) for name in KINDS]).write.partitionBy("fact").parquet(path)
    key_type = dict(scripts.dtypes)[key]
    whole = scripts.sparkSession.read.schema(f"`{key}` {key_type}, {', '.join(columns.values())}, fact string").parquet(path)
    return Facts(*[shuffled(whole.where(F.col("fact") == name).select(key, *(c.split()[0] for c in table.split(", "))), seen.get[name]) for name, (table, _) in KINDS.items()])


@F.udtf(returnType=NODES)
class JsNodes:
    def eval(self, source: str):
        yield from _rows(source, node_rows)


@F.udtf(returnType=SYMBOLS)
class JsSymbols:
    def eval(self, source: str):
        yield from _rows(source, symbol_rows)


@F.udtf(returnType=REFERENCES)
class JsReferences:
    def eval(self, source: str):
        yield from _rows(source, reference_rows)


def register(spark: SparkSession) -> None:
    """js_nodes, js_symbols, js_references and js_deobfuscate(source, preset) for SQL."""
    for name, f in (("js_nodes", JsNodes), ("js_symbols", JsSymbols), ("js_references", JsReferences)):
        spark.udtf.register(name, f)

    @F.pandas_udf("string")
    def deobfuscate(source: pd.Series, preset: pd.Series) -> pd.Series:
        from scriptmill.operators.rewrite import presets_of, run_one

        return pd.Series([None if s is None else run_one(s, presets_of(p or "generic")).code for s, p in zip(source, preset)], dtype=object)

    spark.udf.register("js_deobfuscate", deobfuscate)
