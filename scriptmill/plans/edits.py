"""Edits of scripts as tables of spans: the text between edits stays as it is written, and nothing is printed anew.

An edit names a node and what comes in its place, before or after it. Edits of a script are settled by a sweep: of nodes within
each other the outer one's replacement stands, of several for one node the first by number, and what would be inserted into a
replaced span goes with it. One ordered aggregate then puts each script together; it cuts bytes, so that a piece costs its own
length wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edits: (key, node_id, number, action, texts); actions are replace, remove, before and after.
STATEMENTS = "ExpressionStatement VariableDeclaration FunctionDeclaration ClassDeclaration Return If For ForIn ForOf While DoWhile Throw Try Switch Labeled Block Empty Break Continue Debugger".split()


def renames(nodes: DataFrame, spans: DataFrame, names: DataFrame, key: str = "script_id") -> DataFrame:
    """Edits that give symbols (key, symbol_id, name) new names wherever they stand; {a} becomes {a: b}."""
    own = nodes.where("kind = 'Identifier' and symbol_id is not null").select(key, "node_id", "symbol_id", F.col("str_value").alias("old"))
    own = own.join(names.select(key, "symbol_id", "name"), [key, "symbol_id"]).join(spans.select(key, "node_id", "short"), [key, "node_id"])
    text = F.when(F.col("short"), F.concat("old", F.lit(": "), "name")).otherwise(F.col("name"))
    return own.select(key, "node_id", F.lit(0).cast("long").alias("number"), F.lit("replace").alias("action"), F.array(text).alias("texts"))


def _text(action: Column, texts: Column, statement: Column) -> Column:
    """Statements come one a line; none leaves an empty statement, no expression leaves void 0, several become a sequence."""
    several = F.array_join(texts, "\n")
    replaced = F.when(statement, F.when(F.size(texts) == 0, ";").otherwise(several)).otherwise(F.when(F.size(texts) == 0, "void 0").when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join(texts, ", "), F.lit(")"))))
    gone = F.when(statement, ";").otherwise("void 0")
    return F.when(action == "remove", gone).when(action == "before", F.concat(several, F.lit("\n"))).when(action == "after", F.concat(F.lit("\n"), several)).otherwise(replaced)


def settled(edits: DataFrame, nodes: DataFrame, spans: DataFrame, key: str = "script_id") -> DataFrame:
    """(key, first, last, number, text) of the edits that stand, none within another's span."""
    where = spans.select(key, "node_id", F.col("first").alias("a"), F.col("last").alias("z"))
    kinds = nodes.select(key, "node_id", F.col("kind").isin(*STATEMENTS).alias("statement"))
    own = edits.join(where, [key, "node_id"]).join(kinds, [key, "node_id"])
    action = F.col("action")
    first, last = F.when(action == "after", F.col("z")).otherwise(F.col("a")), F.when(action == "before", F.col("a")).otherwise(F.col("z"))
    own = own.select(key, "node_id", first.alias("first"), last.alias("last"), "number", (first == last).alias("inserted"), _text(action, F.col("texts"), F.col("statement")).alias("text"))
    # Outer spans come before inner ones of the same beginning; insertions at a place come before what is replaced there.
    order = Window.partitionBy(key).orderBy("first", F.desc("inserted"), F.desc("last"), "number", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(~F.col("inserted"), F.col("last"))).over(order)
    return own.withColumn("reached", reached).where("reached is null or first >= reached").select(key, "first", "last", "number", "inserted", "text")


def apply(scripts: DataFrame, edits: DataFrame, nodes: DataFrame, spans: DataFrame, key: str = "script_id", source: str = "source") -> DataFrame:
    """(key, source) of all scripts with their edits done; scripts without any, or that don't parse, are unchanged."""
    own = settled(edits, nodes, spans, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", F.expr("not inserted").alias("replaces"), "number", "last", "text"))).alias("own"))
    both = scripts.select(key, source).join(own, key, "left").withColumn("raw", F.encode(source, "UTF-8"))
    raw, each = F.col("raw"), F.col("own")
    before = lambda i: F.when(i > 0, F.get(each, i - 1)["last"]).otherwise(0)
    pieces = F.transform(each, lambda e, i: F.concat(F.substring(raw, before(i) + 1, e["first"] - before(i)), F.encode(e["text"], "UTF-8")))
    # Hex joins bytes in one pass; concatenating piece by piece would copy what is there each time.
    tail = F.substring(raw, F.element_at(each, -1)["last"] + 1, F.octet_length(raw))
    whole = F.decode(F.unhex(F.array_join(F.transform(F.concat(pieces, F.array(tail)), lambda x: F.hex(x)), "")), "UTF-8")
    return both.select(key, F.when(each.isNull(), F.col(source)).otherwise(whole).alias(source))
