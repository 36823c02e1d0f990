"""Patterns over trees as plans over tables of nodes.

Patterns are those of scriptmill.kernel.patterns; ``find`` turns one into joins and gives the nodes that it matches, with what it
captures as columns: structs of a tag (identifier, string, number or boolean) with a text, a number or a boolean. A pattern's
operands are joined on their parent, from the leaves up; ``and_`` is a join, ``or_`` a union with an anti-join, ``not_`` an
anti-join, a block's statements run through one aggregate (sequences). Nodes are encoded as intervals (node_id to last_id), so
``has`` finds what lies anywhere below by a running minimum instead of a join; ``where`` is a condition in SQL over the columns of
facts.nodes, in place of a Python predicate.

A hole at the end of an array has no row, so [1,,] counts as one item here.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.kernel.patterns import Pattern
from scriptmill.plans import sequences

VALUE = "struct<tag:string,str:string,num:double,bool:boolean>"
LITERAL = ("Number", "String", "Boolean", "Null", "BigInt", "Regex")
#: The slots of operators' operands, in the order of a pattern's parts.
OPERANDS = {"binary": ("Binary", ("left", "right")), "unary": ("Unary", ("value",)), "conditional": ("Conditional", ("test", "then", "other"))}
LISTS = {"sequence": ("Sequence", "items"), "array": ("Array", "items")}


def where(condition: str) -> Pattern:
    """A condition in SQL on a node's own columns."""
    return Pattern("where", (condition,))


def has(p: Pattern) -> Pattern:
    """Something below matches, at any depth; its captures are dropped."""
    return Pattern("has", (p,))


def captures(p: Pattern) -> list[str]:
    """The names that a pattern may capture, in order."""
    if p.what in ("not", "has"):
        return []
    own = [p.parts[0]] if p.what == "capture" else []
    parts = p.parts[2:] if p.what == "assignment" else p.parts
    for x in parts:
        for y in x if isinstance(x, tuple) else (x,):
            if isinstance(y, Pattern):
                own += captures(y)
    return list(dict.fromkeys(own))


class _Plan:
    """Plans of parts are frames (key, id, a column for each capture)."""

    def __init__(self, nodes: DataFrame, key: str):
        self.nodes, self.key = nodes, key
        self.on = [key, "id"]

    def ids(self, condition: Column | str) -> DataFrame:
        return self.nodes.where(condition).select(self.key, F.col("node_id").alias("id"))

    def up(self, slot: str, p: Pattern, ordinal: int | None = None) -> DataFrame:
        """Parents whose child in a slot matches."""
        place = self.nodes.where((F.col("slot") == slot) & (F.col("kind") != "Spread"))
        place = place if ordinal is None else place.where(F.col("ordinal") == ordinal)
        links = place.select(self.key, F.col("node_id").alias("id"), F.col("parent_id").alias("up"))
        if p.what == "any":
            return links.select(self.key, F.col("up").alias("id"))
        return self.of(p).join(links, self.on).drop("id").withColumnRenamed("up", "id")

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """All match; of captures of one name the later wins."""
        out = frames[0]
        for f in frames[1:]:
            twice = [c for c in f.columns if c in out.columns and c not in self.on]
            both = out.join(f.withColumnsRenamed({c: f"{c}__later" for c in twice}), self.on)
            out = both.withColumns({c: F.coalesce(f"{c}__later", c) for c in twice}).drop(*(f"{c}__later" for c in twice)) if twice else both
        return out

    def items(self, slot: str, patterns: tuple[Pattern, ...], kind: str) -> list[DataFrame]:
        """Nodes of a kind whose list has just these items."""
        children = self.nodes.where(F.col("slot") == slot)
        if not patterns:
            return [self.ids(F.col("kind") == kind).join(children.select(self.key, F.col("parent_id").alias("id")), self.on, "left_anti")]
        n = len(patterns)
        whole = children.groupBy(self.key, F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.bool_or(F.col("kind") == "Spread").alias("spread"))
        whole = whole.where((F.col("n") == n) & (F.col("last") == n - 1) & ~F.col("spread")).select(*self.on)
        return [whole, *(self.up(slot, p, i) for i, p in enumerate(patterns))]

    def of(self, p: Pattern) -> DataFrame:
        make = getattr(self, f"_{p.what}", None)
        if make is None:
            raise ValueError(f"{p.what} has no plan" + (": say it in SQL with where()" if p.what == "predicate" else ""))
        return make(*p.parts)

    # Leaves.

    def _any(self) -> DataFrame:
        return self.ids(F.lit(True))

    def _any_literal(self) -> DataFrame:
        return self.ids(F.col("kind").isin(*LITERAL))

    def _any_identifier(self) -> DataFrame:
        return self.ids("kind = 'Identifier'")

    def _any_number(self) -> DataFrame:
        return self.ids("kind = 'Number'")

    def _any_string(self) -> DataFrame:
        return self.ids("kind = 'String'")

    def _any_binary(self) -> DataFrame:
        return self.ids("kind = 'Binary'")

    def _null(self) -> DataFrame:
        return self.ids("kind = 'Null'")

    def _empty(self) -> DataFrame:
        return self.ids("kind = 'Empty'")

    def _identifier(self, name: str) -> DataFrame:
        return self.ids((F.col("kind") == "Identifier") & (F.col("str_value") == name))

    def _string(self, text: str) -> DataFrame:
        return self.ids((F.col("kind") == "String") & (F.col("str_value") == text))

    def _number(self, x: float) -> DataFrame:
        return self.ids((F.col("kind") == "Number") & (F.abs(F.col("num_value") - x) < sys.float_info.epsilon))

    def _boolean(self, x: bool) -> DataFrame:
        return self.ids((F.col("kind") == "Boolean") & (F.col("bool_value") == x))

    def _where(self, condition: str) -> DataFrame:
        return self.ids(F.expr(condition))

    def _variable_declaration(self, word: str | None) -> DataFrame:
        own = F.col("kind") == "VariableDeclaration"
        return self.ids(own if word is None else own & (F.col("op") == word))

    # Nodes with operands.

    def operator(self, what: str, op: str | None, patterns: tuple[Pattern, ...]) -> DataFrame:
        kind, slots = OPERANDS[what]
        own = F.col("kind") == kind
        return self.together([self.ids(own if op is None else own & (F.col("op") == op)), *(self.up(s, p) for s, p in zip(slots, patterns))])

    def _binary(self, op, *patterns) -> DataFrame:
        return self.operator("binary", op, patterns)

    def _unary(self, op, *patterns) -> DataFrame:
        return self.operator("unary", op, patterns)

    def _conditional(self, *patterns) -> DataFrame:
        return self.operator("conditional", None, patterns)

    def _sequence(self, patterns) -> DataFrame:
        return self.together([self.ids("kind = 'Sequence'"), *self.items("items", patterns, "Sequence")])

    def _array(self, patterns) -> DataFrame:
        return self.together([self.ids("kind = 'Array'"), *self.items("items", patterns, "Array")])

    def _call(self, callee: Pattern, arguments) -> DataFrame:
        return self.together([self.ids("kind = 'Call'"), self.up("callee", callee), *self.items("arguments", arguments, "Call")])

    def _member(self, obj: Pattern, prop: Pattern) -> DataFrame:
        """x[i], and x.name where the property's pattern is one for names."""
        indexed = self.together([self.ids("kind = 'Index'"), self.up("object", obj), self.up("index", prop)])
        inner = prop.parts[1] if prop.what == "capture" else prop
        if inner.what not in ("identifier", "any_identifier", "any"):
            return indexed
        own = (F.col("kind") == "Member") & ~F.col("str_value").startswith("#")
        own = own & (F.col("str_value") == inner.parts[0]) if inner.what == "identifier" else own
        named = self.nodes.where(own).select(self.key, F.col("node_id").alias("id"), *([self.value("identifier", F.col("str_value")).alias(prop.parts[0])] if prop.what == "capture" else []))
        return indexed.unionByName(self.together([self.up("object", obj), named]), allowMissingColumns=True)

    def _assignment(self, op, target: Pattern, value: Pattern) -> DataFrame:
        own = F.col("kind") == "Assignment"
        names = self.nodes.where("slot = 'target' and kind = 'Identifier'").select(self.key, F.col("node_id").alias("id"), F.col("parent_id").alias("up"))
        plain = names.join(self.of(target).select(*self.on), self.on, "left_semi").select(self.key, F.col("up").alias("id"))
        return self.together([self.ids(own if op is None else own & (F.col("op") == op)), plain, self.up("value", value)])

    # Logic and captures.

    @staticmethod
    def value(tag: str, text: Column | None = None, num: Column | None = None, boolean: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(tag).alias("tag"), (none if text is None else text).alias("str"), (none if num is None else num).alias("num"), (none if boolean is None else boolean).alias("bool")).cast(VALUE)

    def _capture(self, name: str, inner: Pattern) -> DataFrame:
        k = F.col("kind")
        v = F.when(k == "Identifier", self.value("identifier", F.col("str_value"))).when(k == "String", self.value("string", F.col("str_value"))).when(k == "Number", self.value("number", num=F.col("num_value"))).when(k == "Boolean", self.value("boolean", boolean=F.col("bool_value")))
        own = self.nodes.select(self.key, F.col("node_id").alias("id"), v.alias(name))
        return own if inner.what == "any" else self.together([self.of(inner), own])

    def _and(self, *patterns: Pattern) -> DataFrame:
        return self.together([self.of(p) for p in patterns])

    def _or(self, *patterns: Pattern) -> DataFrame:
        out = self.of(patterns[0])
        for p in patterns[1:]:
            out = out.unionByName(self.of(p).join(out.select(*self.on), self.on, "left_anti"), allowMissingColumns=True)
        return out

    def _not(self, p: Pattern) -> DataFrame:
        return self._any().join(self.of(p).select(*self.on), self.on, "left_anti")

    def _has(self, p: Pattern) -> DataFrame:
        found = self.of(p).select(self.key, F.col("id").alias("node_id"), F.lit(True).alias("found"))
        after = Window.partitionBy(self.key).orderBy("node_id").rowsBetween(1, Window.unboundedFollowing)
        both = self.nodes.select(self.key, "node_id", "last_id").join(found, [self.key, "node_id"], "left")
        return both.withColumn("next", F.min(F.when(F.col("found"), F.col("node_id"))).over(after)).where("next <= last_id").select(self.key, F.col("node_id").alias("id"))

    # Statements.

    def _expression_statement(self, p: Pattern) -> DataFrame:
        return self.together([self.ids("kind = 'ExpressionStatement'"), self.up("expression", p)])

    def _return(self, value: Pattern | None) -> DataFrame:
        own = self.ids("kind = 'Return'")
        if value is None:
            return own.join(self.nodes.where("slot = 'value'").select(self.key, F.col("parent_id").alias("id")), self.on, "left_anti")
        return self.together([own, self.up("value", value)])

    def _if(self, test: Pattern, then: Pattern, other: Pattern | None) -> DataFrame:
        frames = [self.ids("kind = 'If'"), self.up("test", test), self.up("then", then)]
        if other is not None:
            return self.together([*frames, self.up("other", other)])
        return self.together(frames).join(self.nodes.where("slot = 'other'").select(self.key, F.col("parent_id").alias("id")), self.on, "left_anti")

    def _block(self, patterns: tuple[Pattern, ...]) -> DataFrame:
        """Statements by position; a repeat takes as many as it can and gives none back."""
        own = self.ids(F.col("kind").isin("Block", "Body", "Program"))
        children = self.nodes.where("slot = 'body'").select(self.key, F.col("parent_id").alias("up"), F.col("node_id").alias("id"), "ordinal")
        if not patterns:
            return own.join(children.select(self.key, F.col("up").alias("id")), self.on, "left_anti")
        inner = [p.parts[0] if p.what == "repeat" else p for p in patterns]
        fits = [self.of(p) for p in inner]
        mask = children.withColumn("mask", F.lit(0).cast("long"))
        for i, f in enumerate(fits):
            mask = mask.join(f.select(*self.on).withColumn("hit", F.lit(1 << i)), self.on, "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("hit", F.lit(0)))).drop("hit")
        repeats = [p.what == "repeat" for p in patterns]
        grouped = sequences.lists(mask.select(self.key, "up", "ordinal", "mask"), [self.key, "up"])
        empty = own.join(children.select(self.key, F.col("up").alias("id")), self.on, "left_anti")
        taken = grouped.withColumn("taken", sequences.counts(F.col("masks"), repeats)).where("taken is not null").select(self.key, "up", "taken")
        out = own.join(taken.select(self.key, F.col("up").alias("id")), self.on, "left_semi")
        if all(repeats):
            out = out.unionByName(empty)
        # What an item's statements capture: of a repeat the last that captures wins, of items the later.
        for i, f in enumerate(fits):
            names = [c for c in f.columns if c not in self.on]
            if names:
                before = F.aggregate(F.slice("taken", F.lit(1), F.lit(i)), F.lit(0), lambda a, b: a + b) if i else F.lit(0)
                place = taken.select(self.key, "up", before.alias("lo"), (before + F.get("taken", F.lit(i))).alias("hi"))
                own_part = children.join(place, [self.key, "up"]).where("ordinal >= lo and ordinal < hi").join(f, self.on)
                last = own_part.groupBy(self.key, F.col("up").alias("id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in names])
                twice = [c for c in names if c in out.columns]
                out = out.join(last.withColumnsRenamed({c: f"{c}__later" for c in twice}), self.on, "left")
                out = out.withColumns({c: F.coalesce(f"{c}__later", c) for c in twice}).drop(*(f"{c}__later" for c in twice)) if twice else out
        return out

    def _repeat(self, p: Pattern) -> DataFrame:
        return self.ids(F.lit(False))  # only inside a block


def find(nodes: DataFrame, p: Pattern, key: str = "script_id") -> DataFrame:
    """(key, node_id, a column for each capture) of the nodes that match. Nodes are read several times: give a written table."""
    out = _Plan(nodes, key).of(p).withColumnRenamed("id", "node_id")
    missing = [F.lit(None).cast(VALUE).alias(c) for c in captures(p) if c not in out.columns]
    return out.select(key, "node_id", *[c for c in captures(p) if c in out.columns], *missing)
