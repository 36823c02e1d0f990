"""Functions that only hand on their parameters, resolved through each other by pointer jumping.

A proxy returns a parameter, an operator on its two, a call of its first with the rest, or a call of another function with its
own parameters in some order. The last kind is a link with a map of places; following two links composes their maps, so a proxy
of proxies a thousand deep is resolved in some ten joins. Links that come to a cycle resolve to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.plans.jumping import furthest
from scriptmill.session import counted, written


def shapes(nodes: DataFrame, symbols: DataFrame, key: str = "script_id") -> DataFrame:
    """(key, node_id, symbol_id, name, n, shape, op, places, target) of functions with one return, by what they return.

    ``places`` are the parameters in the order of use, that of a call's callee first; ``target`` is the symbol of a function that is called with them.
    """
    stable = symbols.where("n_writes = 0").select(key, "symbol_id", "name")
    f = nodes.where("kind = 'FunctionDeclaration' and op is null").select(key, F.col("node_id").alias("f"))
    child = lambda slot, *more: nodes.where(F.col("slot") == slot).select(key, F.col("parent_id").alias("f"), *more)
    named = f.join(child("name", "symbol_id"), [key, "f"]).join(stable, [key, "symbol_id"])
    params = child("params", "ordinal", "kind", F.col("symbol_id").alias("param")).join(f, [key, "f"], "left_semi")
    counts = params.groupBy(key, "f").agg(F.count("*").alias("n"), F.bool_and(F.col("kind") == "Identifier").alias("plain"))
    body = child("body", F.col("node_id").alias("body")).join(f, [key, "f"], "left_semi")
    statements = nodes.where("slot = 'body'").select(key, F.col("parent_id").alias("body"), "kind", F.col("node_id").alias("statement"))
    only = body.join(statements, [key, "body"]).groupBy(key, "f").agg(F.count("*").alias("k"), F.first("kind").alias("kind"), F.first("statement").alias("statement")).where("k = 1 and kind = 'Return'").select(key, "f", "statement")
    # Parentheses are looked through, however deep they are.
    parens = nodes.where("kind = 'Paren'").select(key, F.col("node_id").alias("id"))
    inner, _ = furthest(nodes.where("slot = 'value'").select(key, F.col("parent_id").alias("id"), F.col("node_id").alias("to")).join(parens, [key, "id"], "left_semi"), key)
    bare = nodes.select(key, "node_id", "parent_id", "slot", "ordinal").join(inner.select(key, F.col("id").alias("node_id"), "end"), [key, "node_id"], "left").withColumn("x", F.coalesce("end", "node_id"))
    what = nodes.select(key, F.col("node_id").alias("x"), "kind", "op", "symbol_id")
    seen = bare.drop("node_id", "end").join(what, [key, "x"])
    value = seen.where("slot = 'value'").select(key, F.col("parent_id").alias("statement"), "x", "kind", "op", F.col("symbol_id").alias("used"))
    returned = written(only.join(value, [key, "statement"]).select(key, "f", "x", "kind", "op", "used"))
    place = params.select(key, "f", "param", "ordinal")
    own = returned.where("kind = 'Identifier'").join(place.withColumnRenamed("param", "used"), [key, "f", "used"]).select(key, "f", F.lit("identity").alias("shape"), F.lit(None).cast("string").alias("op"), F.array("ordinal").alias("places"), F.lit(None).cast("int").alias("target"))
    # Operands of operators and arguments of calls, as places; those of a call aren't looked through parentheses.
    operands = seen.where("slot in ('left', 'right')").select(key, F.col("parent_id").alias("x"), F.when(F.col("slot") == "left", 0).otherwise(1).alias("at"), F.col("symbol_id").alias("param"))
    arguments = nodes.where("slot = 'arguments'").select(key, F.col("parent_id").alias("x"), F.col("ordinal").alias("at"), F.when(F.col("kind") == "Identifier", F.col("symbol_id")).alias("param"))
    used = returned.where("kind in ('Binary', 'Call')").select(key, "f", "x").join(operands.unionByName(arguments), [key, "x"]).join(place, [key, "f", "param"], "left")
    lists = used.groupBy(key, "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ordinal"))), lambda a: a["ordinal"]).alias("places"), F.bool_and(F.col("ordinal").isNotNull()).alias("all"))
    lists = lists.where("all").drop("all")
    pairs = returned.where("kind = 'Binary'").join(lists, [key, "f"]).select(key, "f", F.lit("binary").alias("shape"), "op", "places", F.lit(None).cast("int").alias("target"))
    callee = nodes.where("slot = 'callee' and kind = 'Identifier'").select(key, F.col("parent_id").alias("x"), F.col("symbol_id").alias("target"))
    calls = returned.where("kind = 'Call'").select(key, "f", "x").join(callee, [key, "x"]).join(lists, [key, "f"], "left").join(nodes.where("slot = 'arguments'").select(key, F.col("parent_id").alias("x")).distinct().withColumn("given", F.lit(True)), [key, "x"], "left")
    calls = calls.where("places is not null or given is null").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    first = place.where("ordinal = 0").select(key, "f", F.col("param").alias("target"), F.lit(True).alias("first"))
    places = F.when(F.col("first"), F.concat(F.array(F.lit(0)), F.col("places"))).otherwise(F.col("places"))
    calls = calls.join(first, [key, "f", "target"], "left").select(key, "f", F.when(F.col("first"), "call").otherwise("forward").alias("shape"), F.lit(None).cast("string").alias("op"), places.alias("places"), "target")
    every = own.unionByName(pairs).unionByName(calls)
    return named.join(counts, [key, "f"], "left").where(F.coalesce("plain", F.lit(True))).join(every, [key, "f"]).select(key, F.col("f").alias("node_id"), "symbol_id", "name", F.coalesce("n", F.lit(0)).cast("int").alias("n"), "shape", "op", "places", "target")


def resolve(nodes: DataFrame, symbols: DataFrame, key: str = "script_id") -> tuple[DataFrame, int]:
    """(key, node_id, symbol_id, name, shape, op, places, target, hops, inlinable) of all proxies, and the joins it took.

    What a chain ends at gives the shape: identity, binary, call, function (``target`` is none of these, and is called with the
    parameters at ``places``) or cycle. ``inlinable``: the shape is one that calls are replaced by.
    """
    own = written(shapes(nodes, symbols, key))
    # A call with another number of arguments loses them: no link.
    to = own.select(key, F.col("symbol_id").alias("target"), F.col("n").alias("takes"))
    linked = own.where("shape = 'forward'").join(to, [key, "target"]).where(F.size("places") == F.col("takes")).select(key, "node_id")
    state, moving = counted(own.join(linked.withColumn("moving", F.lit(True)), [key, "node_id"], "left").withColumns({"moving": F.coalesce("moving", F.lit(False)), "hops": F.lit(0).cast("long")}), F.col("moving"))
    joins = 0
    most = state.where("moving").groupBy(key).agg(F.count("*").alias("k")).agg(F.max("k")).head()[0] or 0
    while moving and 1 << max(joins - 1, 0) <= most:
        onward = state.select(key, F.col("symbol_id").alias("target"), F.struct("shape", "op", "places", "target", "hops", "moving").alias("t"))
        both = state.where("moving").join(onward, [key, "target"])
        both = both.select(key, "node_id", "symbol_id", "name", "n", "t.shape", "t.op", F.transform("t.places", lambda p: F.get("places", p)).alias("places"), "t.target", "t.moving", (F.col("hops") + 1 + F.col("t.hops")).alias("hops"))
        state, moving = counted(state.where("not moving").unionByName(both), F.col("moving"))
        joins += 1
    shape = F.when(F.col("moving"), "cycle").when(F.col("shape") == "forward", "function").otherwise(F.col("shape"))
    fits = (
        F.when(F.col("shape") == "identity", F.lit(True))
        .when(F.col("shape") == "binary", (F.col("n") == 2) & (F.get("places", F.lit(0)) != F.get("places", F.lit(1))))
        .when(F.col("shape") == "call", F.col("places") == F.sequence(F.lit(0), F.col("n") - 1))
        .otherwise(F.lit(False))
    )
    return state.withColumn("shape", shape).withColumn("inlinable", fits).select(key, "node_id", "symbol_id", "name", "shape", "op", "places", F.when(F.col("shape") == "function", F.col("target")).alias("target"), "hops", "inlinable"), joins
