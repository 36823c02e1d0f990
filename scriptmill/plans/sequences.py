"""Ordered lists against patterns with repeats, by one native aggregate a list.

A pattern is a row of items, each single or repeated (zero or more). An element comes as a bit mask of the items that it fits.
``counts`` runs as the rewriter's blocks do: a repeated item takes what it can and gives nothing back. ``accepts`` follows all
ways at once, as a regular expression does: a bit mask of states, moved by each element and closed over items that may be empty.
Both keep a few numbers however long a list is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a pattern: states have to fit a 64-bit integer.
MOST_ITEMS = 62


def _checked(repeats: list[bool]) -> list[bool]:
    if len(repeats) > MOST_ITEMS:
        raise ValueError(f"a pattern has at most {MOST_ITEMS} items")
    return repeats


def _fits(mask: Column, item: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << item)) != 0


def accepts(masks: Column, repeats: list[bool]) -> Column:
    """Whether a whole list (array of masks) can be taken apart into the items, giving back where that helps."""
    _checked(repeats)
    many = sum(1 << i for i, r in enumerate(repeats) if r)
    single = sum(1 << i for i, r in enumerate(repeats) if not r)
    run = max((len(r) for r in "".join("r" if x else " " for x in repeats).split()), default=0)

    def closed(states: Column) -> Column:
        """With the states behind repeated items, which may take nothing: as often as such items stand in a row."""
        for _ in range(run):
            states = F.get(F.transform(F.array(states), lambda s: s.bitwiseOR(F.shiftleft(s.bitwiseAND(F.lit(many)), 1))), F.lit(0))
        return states

    def step(states: Column, mask: Column) -> Column:
        here = states.bitwiseAND(mask)
        return closed(here.bitwiseAND(F.lit(many)).bitwiseOR(F.shiftleft(here.bitwiseAND(F.lit(single)), 1)))

    begin = 1
    for i, r in enumerate(repeats):
        if not r:
            break
        begin |= 1 << (i + 1)
    last = F.aggregate(masks, F.lit(begin).cast("long"), step)
    return last.bitwiseAND(F.lit(1 << len(repeats))) != 0


def counts(masks: Column, repeats: list[bool]) -> Column:
    """How many elements each item takes, in order and without giving back; null if the list doesn't fit."""
    n = len(_checked(repeats))

    def taker(state: int, mask: Column) -> Column:
        """The item that takes the next element, coming from an item: -1 if none may."""
        out = F.lit(-1)
        reach = state
        while reach < n and repeats[reach]:
            reach += 1
        for i in reversed(range(state, min(reach, n - 1) + 1)):
            out = F.when(_fits(mask, i), i).otherwise(out)
        return out

    def step(acc: Column, mask: Column) -> Column:
        item = F.lit(-1)
        for s in range(n):
            item = F.when(acc["state"] == s, taker(s, mask)).otherwise(item)
        moved = F.transform(F.array(item), lambda j: F.struct(F.when(j < 0, -1).when(F.get(F.array(*map(F.lit, repeats)), j) if n else F.lit(False), j).otherwise(j + 1).alias("state"), F.transform(acc["taken"], lambda c, i: c + (i == j).cast("int")).alias("taken")))
        return F.get(moved, F.lit(0)).cast("struct<state:int,taken:array<int>>")

    start = F.struct(F.lit(0).alias("state"), F.array(*[F.lit(0)] * n).cast("array<int>").alias("taken")).cast("struct<state:int,taken:array<int>>")
    enough = next((i for i in range(n, -1, -1) if i == 0 or not repeats[i - 1]), 0)  # all items from here on may be empty
    return F.aggregate(masks, start, step, lambda acc: F.when(acc["state"] >= enough, acc["taken"]))


def lists(elements: DataFrame, key: list[str], ordinal: str = "ordinal", mask: str = "mask") -> DataFrame:
    """(key, masks) of ordered lists that come as a row an element."""
    own = elements.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(mask).cast("long").alias("m")))).alias("own"))
    return own.select(*key, F.transform("own", lambda x: x["m"]).alias("masks"))
