"""Rewriting a column of scripts: the kernel inside Arrow batches, one script at a time, no state between rows."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from scriptmill.kernel.fixpoint import Result, Rule, rewrite
from scriptmill.kernel.presets import resolve, rules_of
from scriptmill.kernel.rules.bundles import annotate_requires

STATS = "array<struct<name:string,modifications:bigint,nodes_visited:bigint>>"
RESULT = f"struct<code:string,parse_ok:boolean,converged:boolean,diagnostics:struct<main_iterations:bigint,finalize_iterations:bigint,stats:{STATS}>>"
#: Scripts of at most so many characters are remembered, this many at a time: corpora repeat the small ones.
REMEMBERED, REMEMBERED_LENGTH = 2000, 2000


def presets_of(presets: str | tuple[str, ...] | list[str]) -> tuple[str, ...]:
    names = tuple(p.strip() for p in presets.split(",")) if isinstance(presets, str) else tuple(presets)
    out = []
    for n in names:
        if resolve(n) is None:
            rules_of(n)  # says which presets there are
        out.append(resolve(n))
    return tuple(out)


def run_one(source: str, presets: tuple[str, ...], max_iterations: int | None = None, make_rules: Callable[[], list[Rule]] | None = None, indent: str = "    ") -> Result:
    r = rewrite(source, make_rules() if make_rules is not None else rules_of(*presets), max_iterations, indent=indent)
    if "debundler" in presets and r.parse_ok:
        r.code = annotate_requires(r.code)
    return r


def as_row(r: Result) -> dict:
    d = r.diagnostics
    stats = [{"name": n, "modifications": m, "nodes_visited": v} for n, m, v in zip(d.names, d.modifications, d.nodes_visited)]
    return {"code": r.code, "parse_ok": r.parse_ok, "converged": d.converged, "diagnostics": {"main_iterations": d.main_iterations, "finalize_iterations": d.finalize_iterations, "stats": stats}}


def rewritten(source: str | Column, presets: str | tuple[str, ...] = "generic", max_iterations: int | None = None, make_rules: Callable[[], list[Rule]] | None = None, indent: str = "    ") -> Column:
    """A struct column: code, parse_ok, converged, diagnostics. Null sources stay null.

    make_rules: gives new rule objects for each script, instead of the presets' own.
    """
    names = presets_of(presets)

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        known: OrderedDict[str, dict] = OrderedDict()
        out = []
        for text in s:
            if text is None:
                out.append({"code": None, "parse_ok": None, "converged": None, "diagnostics": None})
                continue
            row = known.get(text)
            if row is None:
                row = as_row(run_one(text, names, max_iterations, make_rules, indent))
                if len(text) <= REMEMBERED_LENGTH:
                    known[text] = row
                    if len(known) > REMEMBERED:
                        known.popitem(last=False)
            out.append(row)
        return pd.DataFrame(out, columns=["code", "parse_ok", "converged", "diagnostics"])

    return run(F.col(source) if isinstance(source, str) else source)


def rewrite_scripts(scripts: DataFrame, source: str = "source", presets: str | tuple[str, ...] = "generic", max_iterations: int | None = None, parts: int | None = None) -> DataFrame:
    """All columns, and code, parse_ok, converged and diagnostics. parts: deal the scripts out by their hash first."""
    own = scripts.repartition(parts, F.xxhash64(source)) if parts else scripts
    return own.withColumn("__r", rewritten(source, presets, max_iterations)).select("*", "__r.*").drop("__r")


def rewrite_batches(batches: Iterator[pa.RecordBatch], column: int, presets: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[Result]]]:
    """For own mapInArrow functions: each batch with its results."""
    for b in batches:
        yield b, [run_one(x or "", presets) for x in b.column(column).to_pylist()]


def statistics(rewrites: DataFrame) -> DataFrame:
    """Sums over a corpus: what each rule changed and visited, and in how many scripts it changed anything."""
    each = rewrites.select(F.explode("diagnostics.stats").alias("s"))
    return each.groupBy(F.col("s.name").alias("name")).agg(F.sum("s.modifications").alias("modifications"), F.sum("s.nodes_visited").alias("nodes_visited"), F.count_if(F.col("s.modifications") > 0).alias("scripts"))
