"""Connected components of an undirected graph, with all of its state in tables.

First every node takes its least neighbour's name, and edges between equal names go: of stars, which most edges come in, nothing
is left, so that the rounds are over few edges. Each round every node takes the least label among its neighbours' (hooking), then its label's label
(shortcut), so paths shrink by halves and chains of length n take about log n rounds. A hub's messages
are combined by min on the map side; the rows of a hub and of a large component's label don't meet in one task
(join_unique). Each round's labels are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import hot_keys, join_unique, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), longs; component: the least node reachable.

    Loops and repeated edges are harmless; a null end drops its edge; no edges, no rows.
    """
    # Written first: if edges were computed once for each direction, two spanning forests could differ, and links be lost.
    both = materialize(edges.select("a", "b").where("a is not null and b is not null"))
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # least: the least of a node's neighbours and itself
    named = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    one = both.where("a < b")
    one = join_unique(one, named.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").select("a", "y").distinct()
    left = materialize(join_unique(materialize(one), named.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").select("x", "y").where("x <> y").distinct())
    if not left.limit(1).count():
        return named.withColumnRenamed("label", "component")
    # Names are nodes, and the least node of a component names itself.
    groups = _rounds(materialize(left.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(left.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()))
    return join_unique(named, groups.select(F.col("node").alias("label"), "component"), "label").select("node", F.coalesce("component", "label").alias("component"))


def _rounds(both: DataFrame) -> DataFrame:
    """(node, component) over edges that are there both ways."""
    hubs = hot_keys(both, "b")
    # label: the least of a node's neighbours and itself
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        # What b's label says to a; and to the node that a's label names (hooking of roots).
        heard = join_unique(both, labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("m"))
        best = labels.join(heard, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        hook = best.where("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("h"))
        hooked = best.join(hook, "node", "left").select("node", F.least("label", F.coalesce("h", "label")).alias("label"), "old")
        # A root is a node, so every label has a label.
        hooked = materialize(hooked)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = join_unique(hooked, up, "label").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        new = materialize(new)
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
