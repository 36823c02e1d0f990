"""Pointer doubling over tables of links (key, id, to): whatever a chain's length n, it takes log n joins.

An id has one link at most. All joins are on (key, id) or (key, to), so that one giant script spreads out like many small ones;
rounds end in written tables, whose rows the writing job counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.session import counted


def _most(links: DataFrame, key: str) -> int:
    """Links of the key that has most."""
    return links.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0


def furthest(links: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, id, end, distance, looped) and the joins it took: where each chain of links ends, and after how many.

    Ids that come to a cycle are looped; their end means nothing.
    """
    state, n = counted(links.select(key, "id", F.col("to").alias("end"), F.lit(1).cast("long").alias("distance"), F.lit(True).alias("moved")))
    joins, bound = 0, None
    while n:
        onward = state.select(key, F.col("id").alias("end"), F.col("end").alias("next"), F.col("distance").alias("more"))
        both = state.drop("moved").join(onward, [key, "end"], "left")
        state, n = counted(both.select(key, "id", F.coalesce("next", "end").alias("end"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("next").isNotNull().alias("moved")), F.col("moved"))
        joins += 1
        if n and joins >= 4:  # only long chains and cycles come here
            bound = bound or _most(links, key)
            if 1 << (joins - 1) >= bound:  # more steps than there are links
                break
    return state.withColumnRenamed("moved", "looped"), joins


@dataclass
class Jumps:
    """Tables (key, id, to) of 1, 2, 4, ... steps; ``endless`` has the ids that come to a cycle, None if there are none."""

    tables: list[DataFrame]
    endless: DataFrame | None

    def __len__(self) -> int:
        return len(self.tables)


def jumps(links: DataFrame, key: str) -> Jumps:
    """Each table joins the last one to itself; the first that would be empty, or whose steps are more than the links, ends it."""
    table, n = counted(links.select(key, "id", "to"))
    if not n:
        return Jumps([], None)
    tables, bound = [], _most(links, key)
    while n:
        if 1 << len(tables) > bound:
            return Jumps(tables, table.select(key, "id"))
        tables.append(table)
        table, n = counted(table.join(table.select(key, F.col("id").alias("to"), F.col("to").alias("next")), [key, "to"]).select(key, "id", F.col("next").alias("to")))
    return Jumps(tables, None)
