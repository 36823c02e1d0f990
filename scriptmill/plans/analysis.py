"""The rewriter's relational questions as plans over facts.

All of them key on the script first, so at scale every join and window is local to a script's rows; none
collects, and the only broadcasts are tables of fixed size (presets, operators, test points).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptmill.plans import machines, rotation

#: Rows of a table that may be broadcast.
MOST_BROADCAST = 10_000


def symbol_counts(symbols: DataFrame, key: str = "script_id") -> DataFrame:
    """References and writes of each symbol as the parser has counted them: one pass over the scripts, no join."""
    return symbols.select(key, "symbol_id", "scope_id", "name", F.col("n_references").cast("long").alias("refs"), F.col("n_writes").cast("long").alias("writes"))


def array_readers(nodes: DataFrame, key: str = "script_id") -> DataFrame:
    """Functions whose bodies index a variable that holds an array literal (semi-join): (key, node_id, name).

    A node lies in a function if its number is between the function's own and that of the next node that is not below.
    """
    arrays = nodes.where("slot = 'init' and kind = 'Array'").select(key, "parent_id")
    held = nodes.where("slot = 'target' and symbol_id is not null").join(arrays, [key, "parent_id"], "left_semi").select(key, "symbol_id")
    indexed = nodes.where("kind = 'Index'").select(key, F.col("node_id").alias("parent_id"))
    uses = nodes.where("slot = 'object' and symbol_id is not null").join(indexed, [key, "parent_id"], "left_semi").join(held, [key, "symbol_id"], "left_semi").select(key, F.col("node_id").alias("at"))
    functions = nodes.where("kind = 'FunctionDeclaration'").select(key, "node_id", "last_id")
    names = nodes.where("slot = 'name' and kind = 'Identifier'").select(key, F.col("parent_id").alias("node_id"), F.col("str_value").alias("name"))
    inside = functions.join(uses, (functions[key] == uses[key]) & uses["at"].between(functions["node_id"], functions["last_id"]), "left_semi")
    return inside.join(names, [key, "node_id"]).select(key, "node_id", "name")


def gone_references(old: DataFrame, new: DataFrame, key: str = "script_id") -> DataFrame:
    """Names (key, name) that a script's old form refers to and its new one doesn't (set difference)."""
    return old.select(key, "name").subtract(new.select(key, "name"))


def distinct_names(references: DataFrame, key: str = "script_id") -> DataFrame:
    """How often each script refers to names, and to how many different ones (distinct)."""
    each = references.groupBy(key, "name").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("n_references"), F.count("*").alias("n_names"))


def combined_rules(preset_rule: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rules of several presets one after another, with those that come twice: chosen (combination, turn, preset)."""
    w = Window.partitionBy("combination").orderBy("turn", "position")
    return chosen.join(preset_rule, "preset").withColumn("place", F.row_number().over(w)).select("combination", "place", "rule")


def symbol_stats(symbols: DataFrame, references: DataFrame, key: str = "script_id") -> DataFrame:
    """References and writes of each symbol, counted by a join (those without any are 0)."""
    counts = references.where("symbol_id is not null").groupBy(key, "symbol_id").agg(F.count("*").alias("refs"), F.count_if("is_write").alias("writes"))
    own = symbols.select(key, "symbol_id", "scope_id", "name", "n_redeclared").join(counts, [key, "symbol_id"], "left")
    return own.withColumns({"refs": F.coalesce("refs", F.lit(0)), "writes": F.coalesce("writes", F.lit(0))})


def unused_symbols(symbols: DataFrame, references: DataFrame, key: str = "script_id") -> DataFrame:
    """Symbols that nothing refers to (anti-join)."""
    return symbols.join(references.where("symbol_id is not null").select(key, "symbol_id"), [key, "symbol_id"], "left_anti")


def inlinable_constants(nodes: DataFrame, symbols: DataFrame, key: str = "script_id") -> DataFrame:
    """Uses of names with a literal initializer that are never written or redeclared: (key, node_id, name, literal)."""
    literal = F.coalesce("str_value", F.col("num_value").cast("string"), F.col("bool_value").cast("string"), F.lit("null"))
    inits = nodes.where("slot = 'init' and kind in ('Number', 'String', 'Boolean', 'Null')").select(key, "parent_id", literal.alias("literal"))
    targets = nodes.where("slot = 'target' and kind = 'Identifier' and symbol_id is not null").select(key, "parent_id", "symbol_id")
    stable = symbols.where("n_writes = 0 and n_redeclared = 0 and n_references > 0").select(key, "symbol_id", "name")
    uses = nodes.where("is_write = false and symbol_id is not null").select(key, "node_id", "symbol_id")
    constants = targets.join(inits, [key, "parent_id"]).join(stable, [key, "symbol_id"]).drop("parent_id")
    return uses.join(constants, [key, "symbol_id"]).select(key, "node_id", "name", "literal")


def reachable_statements(statements: DataFrame, key: str = "list_id") -> DataFrame:
    """Statements (list_id, ordinal, kind, word) up to the first that ends its list, and later declarations that are hoisted."""
    ends = F.col("kind").isin("Return", "Throw", "Break", "Continue")
    first = F.min(F.when(ends, F.col("ordinal"))).over(Window.partitionBy(key))
    own = statements.withColumn("first_end", first)
    hoisted = (F.col("kind") == "FunctionDeclaration") | (F.col("word") == "var")
    return own.where(F.col("first_end").isNull() | (F.col("ordinal") <= F.col("first_end")) | F.coalesce(hoisted, F.lit(False))).drop("first_end")


def merged_declarations(declarations: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each declaration (list_id, symbol, ordinal) with its first later assignment (list_id, symbol, ordinal, literal) in the
    same list, if the symbol is assigned once; a first assignment that is no literal ends the search."""
    a = assignments.select("list_id", "symbol", F.col("ordinal").alias("at"), "literal")
    once = a.groupBy("list_id", "symbol").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min_by("literal", "at").alias("literal"))
    return declarations.join(once, ["list_id", "symbol"]).where("n = 1 and at > ordinal and literal is not null").drop("n")


def trace_states(transitions: DataFrame, starts: DataFrame) -> DataFrame:
    """The order in which states come: transitions (machine, state, next: null at the end), starts (machine, state).

    Machines that come to a cycle or to a state without transition are left out; there is no longest machine.
    """
    return machines.trace(transitions, starts)


def solve_rotation(arrays: DataFrame) -> DataFrame:
    """arrays (array_id, numbers array<bigint>, target): the least left rotation whose alternating checksum, the sum of
    each element times its place, is the target; null if none is."""
    return rotation.solve_weighted(arrays).select("array_id", "rotation")


def decode_calls(calls: DataFrame, arrays: DataFrame) -> DataFrame:
    """calls (array_id, call_id, index) with the array's decoded value: arrays (array_id, shift, strings)."""
    from scriptmill.functions import js

    values = arrays.select("array_id", "shift", F.posexplode("strings").alias("place", "text")).select("array_id", (F.col("place") + F.col("shift")).alias("index"), js.base64_decode("text").alias("value"))
    return calls.join(values, ["array_id", "index"], "left").select("array_id", "call_id", "index", "value")


def match_identities(tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """tables (expression_id, point, value), candidates (form, rank, nodes, point, value): the first form that agrees at
    every point. Candidates are a small fixed set and broadcast if they are; others are shuffled."""
    wanted = candidates.withColumnRenamed("value", "wanted")
    small = candidates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    both = tables.join(F.broadcast(wanted) if small else wanted, "point")
    whole = both.groupBy("expression_id", "form", "rank", "nodes").agg(F.bool_and(F.col("value") == F.col("wanted")).alias("same")).where("same")
    return whole.groupBy("expression_id").agg(F.min_by("form", "rank").alias("form"), F.min_by("nodes", "rank").alias("nodes"))


def preset_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """preset (name, alias), preset_rule (preset, position, rule), rule (rule, phase, priority, kind), from the rules themselves."""
    from scriptmill.kernel.presets import ALIASES, PRESETS

    names = [(p, a) for p, others in ALIASES.items() for a in (p, *others)]
    order = [(p, i, r.name) for p, rules in PRESETS.items() for i, r in enumerate(rules)]
    rules = sorted({(r.name, r.phase, r.priority, k) for rules in PRESETS.values() for r in rules for k in r.interests})
    return spark.createDataFrame(names, "preset string, alias string"), spark.createDataFrame(order, "preset string, position int, rule string"), spark.createDataFrame(rules, "rule string, phase string, priority int, kind string")


def dispatch_order(preset_rule: DataFrame, rule: DataFrame) -> DataFrame:
    """The rank of each rule among those of its preset, phase and kind: by priority, then by registration."""
    w = Window.partitionBy("preset", "phase", "kind").orderBy("priority", "position")
    return preset_rule.join(F.broadcast(rule), "rule").withColumn("rank", F.row_number().over(w)).select("preset", "phase", "kind", "rank", "rule")


def module_names(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """dependencies (bundle, path, target), modules (bundle, module): a name from the shortest path, ties by text."""
    best = dependencies.groupBy("bundle", "target").agg(F.min_by("path", F.struct(F.octet_length("path"), "path")).alias("path"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^(\.\./)+", ""), r"^\./", ""), r"\.js$", ""), "[^A-Za-z0-9_$]", "_")
    name = F.when(clean.rlike("^([0-9]|$)"), F.concat(F.lit("module_"), clean)).otherwise(clean)
    own = modules.join(best.withColumnRenamed("target", "module"), ["bundle", "module"], "left")
    return own.select("bundle", "module", F.coalesce(name, F.concat(F.lit("module_"), F.col("module").cast("string"))).alias("name"))


def table_hash(x, y, row: int, k: tuple[int, int, int, int]) -> object:
    """h(y, h(x, row)) for h(c, r) = (c*k0 ^ r*k1 ^ k2*k3) & 31 in 32-bit arithmetic, as a Column."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    h = lambda c, r: low(c * k[0]).bitwiseXOR(low(r * k[1])).bitwiseXOR(F.lit(k[2] * k[3])).bitwiseAND(F.lit(31))
    return h(y, h(x, F.lit(row).cast("bigint")))
