"""State machines as tables: the order in which states come, and the entry that each case goes to.

transitions (machine, state, next: null at the end), with one row a state. Both follow tables of 1, 2, 4, ... steps (jumping),
so a machine of n states takes log n joins, no path is kept in a row, and no bound has to be guessed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.plans.jumping import jumps
from scriptmill.session import written


def _links(transitions: DataFrame) -> DataFrame:
    """Steps to states that are there."""
    there = transitions.select("machine", F.col("state").alias("to"))
    return transitions.where("next is not null").select("machine", F.col("state").alias("id"), F.col("next").alias("to")).join(there, ["machine", "to"], "left_semi")


def trace(transitions: DataFrame, starts: DataFrame) -> DataFrame:
    """(machine, depth, state) from each machine's start (machine, state) to its end.

    Machines that come to a cycle or to a state without transition are left out.
    """
    steps = jumps(_links(transitions), "machine")
    path = starts.select("machine", "state").join(transitions.select("machine", "state"), ["machine", "state"], "left_semi")
    if steps.endless is not None:
        path = path.join(steps.endless.withColumnRenamed("id", "state"), ["machine", "state"], "left_anti")
    path = written(path.select("machine", F.lit(0).cast("int").alias("depth"), "state"))
    for k in reversed(range(len(steps))):  # all states of an even depth are known from those of twice the step
        onward = path.join(steps.tables[k].withColumnRenamed("id", "state"), ["machine", "state"]).select("machine", (F.col("depth") + (1 << k)).alias("depth"), F.col("to").alias("state"))
        path = written(path.unionByName(onward))
    ends = transitions.where("next is null").select("machine", "state")
    whole = path.join(ends, ["machine", "state"], "left_semi").select("machine").distinct()
    return path.join(whole, "machine", "left_semi")


def owners(transitions: DataFrame, entries: DataFrame) -> DataFrame:
    """(machine, rank, depth, state): each case with the first entry (machine, state, rank) that comes to it, and its place there.

    Statements move to the first function that needs them, so later entries don't have them any more. Entries that come to a
    cycle get nothing. Labels (rank, depth) spread by doubling: after k joins a state knows the least of all within 2^k steps.
    """
    steps = jumps(_links(transitions), "machine")
    own = entries.select("machine", "state", "rank").join(transitions.select("machine", "state"), ["machine", "state"], "left_semi")
    if steps.endless is not None:
        own = own.join(steps.endless.withColumnRenamed("id", "state"), ["machine", "state"], "left_anti")
    label = own.groupBy("machine", "state").agg(F.min(F.struct("rank", F.lit(0).alias("depth"))).alias("best"))
    for k, table in enumerate(steps.tables):
        moved = label.join(table.withColumnRenamed("id", "state"), ["machine", "state"]).select("machine", F.col("to").alias("state"), F.struct(F.col("best.rank"), (F.col("best.depth") + (1 << k)).alias("depth")).alias("best"))
        label = written(label.unionByName(moved).groupBy("machine", "state").agg(F.min("best").alias("best")))
    return label.select("machine", "best.rank", "best.depth", "state")
