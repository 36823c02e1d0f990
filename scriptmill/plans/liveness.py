"""What nothing uses, to a fixpoint: semi-naive iteration over units of code.

A unit is what can be removed whole: a function declared in a nested scope, a declarator whose initializer does nothing, or a
statement after one that ends its list. A round removes the units whose symbol lost its last reference in the round before,
with the units inside them, and takes the references that lie in them off their symbols' counts; only what was removed last is
joined to references and units. So a chain of functions that use each other dies in one query, in as many rounds as it is long.
Functions that use each other in a circle keep each other alive, as they do for the rewriter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.plans.jumping import furthest
from scriptmill.session import counted, written

ENDS = ("Return", "Throw", "Break", "Continue")
LISTS = ("Program", "Body", "Block", "Case")
#: What an initializer may hold if it can go.
PURE = ("Number", "String", "Boolean", "Null", "BigInt", "Regex", "Array", "Unary", "Paren")


@dataclass
class Dead:
    """(key, node_id, last_id, symbol_id, round) of removed units; units within others come with the outermost one's round or before."""

    units: DataFrame
    #: Units that each round removed, and references that it took off.
    removed: list[int] = field(default_factory=list)
    released: list[int] = field(default_factory=list)


def unreachable(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_id) of what goes after the first statement that ends its list: statements, but of declarations that are hoisted
    only the initializers of var."""
    lists = nodes.where(F.col("kind").isin(*LISTS)).select(key, F.col("node_id").alias("parent_id"))
    own = nodes.where("slot = 'body'").join(lists, [key, "parent_id"]).select(key, "parent_id", "ordinal", "node_id", "kind", "op")
    first = F.min(F.when(F.col("kind").isin(*ENDS), F.col("ordinal"))).over(Window.partitionBy(key, "parent_id"))
    after = own.withColumn("first", first).where("ordinal > first and kind <> 'FunctionDeclaration'")
    var = (F.col("kind") == "VariableDeclaration") & (F.col("op") == "var")
    declarators = nodes.where("kind = 'Declarator'").select(key, F.col("node_id").alias("of"), F.col("parent_id").alias("node_id"))
    inits = nodes.where("slot = 'init'").select(key, "node_id", F.col("parent_id").alias("of"))
    stripped = after.where(var).select(key, "node_id").join(declarators, [key, "node_id"]).select(key, "of").join(inits, [key, "of"])
    return after.where(~var).select(key, "node_id").unionByName(stripped.select(key, "node_id"))


def units(nodes: DataFrame, symbols: DataFrame, key: str = "script_id") -> tuple[DataFrame, DataFrame]:
    """Units (key, unit, last_id, symbol_id, outer, gone, fixed) and the innermost unit (key, node_id, unit) of each node in one.

    A declarator whose initializer does something is fixed: it goes with a unit around it, and not by itself.
    """
    named = lambda slot: nodes.where((F.col("slot") == slot) & (F.col("kind") == "Identifier") & F.col("symbol_id").isNotNull()).select(key, F.col("parent_id").alias("unit"), "symbol_id")
    nested = symbols.where("scope_id <> 0").select(key, "symbol_id")
    functions = nodes.where("kind = 'FunctionDeclaration' and slot = 'body'").select(key, F.col("node_id").alias("unit"), "last_id")
    functions = functions.join(named("name"), [key, "unit"]).join(nested, [key, "symbol_id"], "left_semi")
    heads = nodes.where("kind = 'VariableDeclaration' and slot in ('body', 'init')").select(key, F.col("node_id").alias("parent_id"))
    declarators = nodes.where("kind = 'Declarator'").join(heads, [key, "parent_id"], "left_semi").select(key, F.col("node_id").alias("unit"), "last_id").join(named("target"), [key, "unit"])
    cut = unreachable(nodes, key).join(nodes.select(key, "node_id", "last_id"), [key, "node_id"]).select(key, F.col("node_id").alias("unit"), "last_id", F.lit(None).cast("int").alias("symbol_id"), F.lit(True).alias("gone"))
    own = functions.unionByName(declarators).select(key, "unit", "last_id", "symbol_id", F.lit(False).alias("gone")).unionByName(cut)
    own = written(own.groupBy(key, "unit").agg(F.max("last_id").alias("last_id"), F.max("symbol_id").alias("symbol_id"), F.max("gone").alias("gone")))
    # The innermost unit of every node: parents are followed until a unit comes.
    parents = nodes.where("parent_id is not null").select(key, F.col("node_id").alias("id"), F.col("parent_id").alias("to"))
    ends, _ = furthest(parents.join(own.select(key, F.col("unit").alias("id")), [key, "id"], "left_anti"), key)
    itself = own.select(key, F.col("unit").alias("node_id"), "unit")
    inside = written(ends.select(key, F.col("id").alias("node_id"), F.col("end").alias("unit")).join(own.select(key, "unit"), [key, "unit"], "left_semi").select(key, "node_id", "unit").unionByName(itself))
    busy = nodes.where(~F.col("kind").isin(*PURE, "Declarator") & (F.coalesce(F.col("slot"), F.lit("")) != "target")).select(key, "node_id")
    fixed = inside.join(busy, [key, "node_id"], "left_semi").select(key, "unit").join(declarators.select(key, "unit"), [key, "unit"], "left_semi").distinct().withColumn("fixed", F.lit(True))
    above = parents.select(key, F.col("id").alias("unit"), F.col("to").alias("node_id")).join(inside.withColumnRenamed("unit", "outer"), [key, "node_id"]).select(key, "unit", "outer")
    every = own.join(above, [key, "unit"], "left").join(fixed, [key, "unit"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    return written(every.select(key, "unit", "last_id", "symbol_id", "outer", "gone", "fixed")), inside


def dead(nodes: DataFrame, symbols: DataFrame, references: DataFrame, key: str = "script_id") -> Dead:
    """Units that nothing uses, once what nothing uses is gone."""
    every, inside = units(nodes, symbols, key)
    refs = written(references.where("symbol_id is not null").select(key, "node_id", "symbol_id").join(inside, [key, "node_id"], "left"))
    counts = refs.groupBy(key, "symbol_id").agg(F.count("*").alias("n"))
    own = F.when(F.col("symbol_id").isNotNull() & ~F.col("fixed"), F.coalesce("n", F.lit(0)))
    state = written(every.join(counts, [key, "symbol_id"], "left").withColumn("left", own).drop("n", "fixed"))
    out = Dead(state)
    rows = [key, "unit", "last_id", "symbol_id"]
    delta, n = counted(state.where("gone or left = 0").select(*rows))
    found, alive = delta.withColumn("round", F.lit(0)), state
    while n:
        out.removed.append(n)
        # References of what was removed last; each lies in one innermost unit, so each is taken off once.
        lost, k = counted(refs.join(delta.select(key, "unit"), [key, "unit"], "left_semi").groupBy(key, "symbol_id").agg(F.count("*").alias("lost")))
        out.released.append(k)
        rest = alive.join(delta.select(key, "unit"), [key, "unit"], "left_anti").join(lost, [key, "symbol_id"], "left")
        alive = written(rest.withColumn("left", F.col("left") - F.coalesce("lost", F.lit(0))).drop("lost"))
        within = delta.select(key, F.col("unit").alias("outer"))
        free = alive.where("left = 0").select(*rows)
        delta, n = counted(free.unionByName(alive.where(F.coalesce(F.col("left") != 0, F.lit(True))).join(within, [key, "outer"], "left_semi").select(*rows)))
        if n:
            found = found.unionByName(delta.withColumn("round", F.lit(len(out.removed))))
    out.units = found.withColumnRenamed("unit", "node_id")
    return out
