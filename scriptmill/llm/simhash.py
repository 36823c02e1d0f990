"""SimHash near-dedup by bit-sliced comparison.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Fingerprints that are
equal form one class first, so copies are never compared. Two that differ in at most ``radius`` of 64
bits agree on ``free`` whole blocks of radius + free equal blocks (pigeonhole); each choice of ``free`` blocks
is a table whose key is those blocks' bits, and only rows of one key are compared.

Within a key the bits are stored vertically: a plane for each bit position holds that bit of 64 fingerprints
in each word. Many probes are compared to a whole block at once (the pairs of many small keys share a block): planes that
differ are added to carry-save counters, and a word of a block is left as soon as all of its counters exceed the radius. Keys with more rows than a
block are cut into blocks, each a group of its own, so that a hot key spreads out; rows outside its largest class visit the other blocks.
A task emits a spanning forest of the links it finds, not the links. ``free`` follows from the number of
distinct fingerprints, so that a key of unrelated ones has few rows at any size.

Edge cases: a null or blank text has fingerprint zero, linked like any other; texts of fewer words than a
shingle have one shingle; rows that repeat a doc_id each get a row; null doc_ids keep a fingerprint and get
their class's id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import hold, join_unique, materialize, utf8_texts
from scriptmill.llm.components import components

RADIUS, SHINGLE, SEED, BITS = 4, 4, 42, 64
#: Blocks beyond the radius that must agree: more of them, longer keys and more tables. Unrelated rows of a key.
FREE_BLOCKS, UNRELATED = (2, 3, 4), 16
BLOCK_ROWS = 4096
#: Groups of so few rows put their pairs into shared blocks.
SMALL_GROUP = 16
#: Rows of a large key that come to all of its blocks, about; blocks' worth of visitors that a block gets at once.
PIVOTS, VISITORS = 16, 16
#: Hashes counted at a time: bounds memory for long texts.
COUNTED = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    stop = (start + size)[min(shingle, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, COUNTED):
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[lo : min(n, lo + COUNTED)].tolist(), stop[lo : lo + COUNTED].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash")
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8_texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit position by packed row; the last word's spare rows are zero."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _add(count: list[np.ndarray], over: np.ndarray, four: list[np.ndarray], radius: int) -> np.ndarray:
    """Carry-save: four more planes in the counters of three planes or more; returns where the radius is exceeded by now."""
    a, b, c, d = four
    ab = a ^ b
    low, carry = ab ^ c, (a & b) | (ab & c)  # a + b + c = 2 carry + low
    total, carry2 = low ^ d, low & d
    k0 = count[0] & total
    count[0] = count[0] ^ total
    x = k0 ^ carry
    twos, fours = x ^ carry2, (k0 & carry) | (x & carry2)
    k1 = count[1] & twos
    count[1] = count[1] ^ twos
    y = k1 ^ fours
    carry = (k1 & fours) | (count[2] & y)
    count[2] = count[2] ^ y
    for i in range(3, len(count)):
        count[i], carry = count[i] ^ carry, count[i] & carry
    over = over | carry
    more, same = np.zeros_like(over), ~np.zeros_like(over)
    for bit in range(len(count) - 1, -1, -1):  # count > radius, from the top bit down
        if radius >> bit & 1:
            same = same & count[bit]
        else:
            more = more | (same & count[bit])
            same = same & ~count[bit]
    return over | more


def within(vertical: np.ndarray, probes: np.ndarray, radius: int, read: list[int] | None = None) -> np.ndarray:
    """(probes, words): packed masks of the rows with at most ``radius`` bits that differ from each probe.

    Planes are added four at a time for all probes and words at once. A word of a probe is abandoned once all of its rows
    exceed the radius; when most are, what is left goes on as a list. ``read``, if given, gets the words of planes read.
    """
    flip = -((probes.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    flip = flip.view(np.uint64)
    shape = (len(probes), vertical.shape[1])
    out = np.zeros(shape, np.uint64)
    count, over, left = [np.zeros(shape, np.uint64) for _ in range(max(3, radius.bit_length()))], np.zeros(shape, np.uint64), None
    for i in range(0, BITS, 4):
        if left is None:
            four = [vertical[j] ^ flip[:, j, None] for j in range(i, i + 4)]
        else:
            four = [vertical[j, left[1]] ^ flip[left[0], j] for j in range(i, i + 4)]
        if read is not None:
            read.append(4 * over.size)
        over = _add(count, over, four, radius)
        going = ~over != 0
        n = np.count_nonzero(going)
        if not n:
            return out
        if n <= going.size // 2:
            left = np.nonzero(going) if left is None else (left[0][going], left[1][going])
            count, over = [c[going] for c in count], over[going]
    if left is None:
        return ~over
    out[left] = ~over
    return out


def near(probe: int, vertical: np.ndarray, radius: int) -> np.ndarray:
    """Packed mask of the rows within the radius of the probe."""
    return within(vertical, np.array([probe], np.uint64), radius)[0]


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within the radius: the pairs of many small groups are the rows of one block."""
    mask = near(0, planes(x ^ y), radius)
    return np.unpackbits(mask.view(np.uint8), bitorder="little")[: len(x)].astype(bool)


#: Fingerprints that are probed at once, at most; the first goes alone, for it may link all.
PROBES = 256


def links(left: np.ndarray, right: np.ndarray | None, radius: int, read: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of fingerprints (right None: within the left)."""
    own = left if right is None else np.concatenate([left, right])
    other = own if right is None else right
    shift = 0 if right is None else len(left)
    vertical = planes(other)
    label = np.arange(len(own))
    apart = len(own)
    found = []
    lo, step = 0, 1
    while lo < len(left) and apart > 1:  # or nothing is left to join
        probes = left[lo : lo + step].astype(np.uint64)
        at = lo // 64 if right is None else 0  # rows before have been probed
        masks = within(vertical[:, at:], probes, radius, read)
        if right is None:  # each is near itself
            i = np.arange(lo, lo + len(probes))
            masks[i - lo, i // 64 - at] &= ~(np.uint64(1) << (i % 64).astype(np.uint64))
        for k in np.flatnonzero(masks.any(1)).tolist():
            i = lo + k
            hits = np.flatnonzero(np.unpackbits(masks[k].view(np.uint8), bitorder="little")) + 64 * at
            hits = hits[hits < len(other)] + shift
            hits = hits[label[hits] != label[i]]
            if not len(hits):
                continue
            others, first = np.unique(label[hits], return_index=True)
            found += [(i, j) for j in hits[first].tolist()]
            label[np.isin(label, others)] = label[i]
            apart -= len(others)
        lo += len(probes)
        step = min(2 * step, PROBES)
    return found


def free_blocks(distinct: int, radius: int = RADIUS) -> int:
    """The least choice of FREE_BLOCKS whose keys hold few unrelated fingerprints."""
    fits = [f for f in FREE_BLOCKS if distinct <= UNRELATED << (BITS * f // (radius + f))]
    return fits[0] if fits else FREE_BLOCKS[-1]


def tables(radius: int, free: int) -> list[int]:
    """Masks of the bits in each choice of ``free`` of radius + free blocks."""
    edges = np.linspace(0, BITS, radius + free + 1).round().astype(int)
    blocks = [sum(1 << int(i) for i in range(a, b)) for a, b in zip(edges[:-1], edges[1:])]
    return [sum(c) for c in combinations(blocks, free)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked(distinct: DataFrame, radius: int = RADIUS, free: int = FREE_BLOCKS[0], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as all links within the radius do."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold radii up to 7")
    masks = tables(radius, free)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    find = lambda left, right: links(left, right, radius)
    return compared(keyed.withColumnRenamed("fp", "node"), find, lambda x, y: near_pairs(x, y, radius), block_rows)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[np.ndarray | None]:
    """The columns of each group; the first ``key`` columns name it, and partitions are sorted by them. None ends a batch."""
    last, group = None, []
    for batch in batches:
        c = np.stack([col.to_numpy(zero_copy_only=False).astype(np.int64) for col in batch.columns])
        cuts = np.flatnonzero((c[:key, 1:] != c[:key, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), c.shape[1]]):
            k = tuple(c[:key, lo].tolist()) if hi > lo else last
            if k != last:
                if group:
                    yield np.concatenate(group, axis=1)
                last, group = k, []
            group.append(c[:, lo:hi])
        yield None
    if group:
        yield np.concatenate(group, axis=1)


def _first_of(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """For each of n rows the first row of its component."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in edges:
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    return np.array([top(i) for i in range(n)], np.int64)


def compared(keyed: DataFrame, find: Callable[[np.ndarray, np.ndarray | None], list[tuple[int, int]]], near: Callable[[np.ndarray, np.ndarray], np.ndarray], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between the nodes of each key of ``keyed`` (node, t, k and, if the node isn't its own fingerprint, its words).

    ``find`` gives a spanning forest within a block or between two, ``near`` says which pairs of small keys are linked.

    A key of more rows than a block is cut into blocks, each with some PIVOTS of the key's rows. Rows that their block links to one
    pivot are one class in all blocks. Whoever isn't in the key's largest class visits the other blocks, and nobody else does, so
    a group of near copies takes linear work and gives linearly many edges, whatever its size, and each pair has been compared
    or is in one class. A visit gives an edge for each pair of classes, not of rows.
    """
    words = [c for c in keyed.columns if c not in ("node", "t", "k")]
    keyed = keyed.withColumn("k", F.col("k").cast("long"))
    # Only large keys are broadcast, fewer than one in block_rows rows.
    large = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).withColumn("g", F.ceil(F.col("n") / block_rows).cast("int")))
    some = large.limit(1).count() > 0
    order = F.xxhash64("node", F.lit(7)).bitwiseAND(F.lit((1 << 53) - 1))  # one order in all keys: pivots first, and forests share edges
    pivot = order / F.lit(float(1 << 53)) * F.col("n") < PIVOTS
    if some:
        rows = keyed.join(F.broadcast(large), ["t", "k"], "left").withColumn("own", F.when(F.col("g").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("g"))).cast("int"))
        at = F.explode(F.when(F.col("g").isNotNull() & pivot, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.greatest("own", F.lit(0)))))
        rows = rows.select("t", "k", at.alias("x"), "own", "node", *words)
    else:
        rows = keyed.select("t", "k", F.lit(0).alias("x"), F.lit(-1).alias("own"), "node", *words)
    fields = ["a", "b", "t", "k", "own", *words]
    schema = "a long, b long, t int, k long, own int" + "".join(f", {w} long" for w in words)

    def within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (t is null), and (node, class, t, k, block, words) of the rows of large keys."""
        pairs: list[tuple[np.ndarray, ...]] = []
        out: list[np.ndarray] = []
        classes: list[np.ndarray] = []

        def of(group: np.ndarray) -> None:
            (t, k, x, own, node), rest = group[:5], group[5:]
            fp = np.ascontiguousarray(rest.T).view(np.uint64) if len(rest) else node.view(np.uint64)
            n = len(node)
            if own[0] < 0 and n <= SMALL_GROUP:
                i, j = np.triu_indices(n, 1)
                pairs.append((node[i], node[j], fp[i], fp[j]))
                return
            found = find(fp, None)
            out.append(node[np.array(found, np.int64).reshape(-1, 2)].T)
            if own[0] >= 0:
                label = node[_first_of(n, found)]
                classes.append(np.concatenate([np.stack([node, label, t, k, own]), rest])[:, own == x])

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if pairs and sum(len(p[0]) for p in pairs) >= least:
                a, b, x, y = (np.concatenate(c) for c in zip(*pairs))
                hit = near(x, y)
                out.append(np.stack([a[hit], b[hit]]))
                pairs.clear()
            if out and sum(o.shape[1] for o in out) >= min(least, 10_000):
                a, b = np.concatenate(out, axis=1)
                out.clear()
                none = [pa.nulls(len(a), f.type) for f in empty[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], fields)
            if classes and sum(c.shape[1] for c in classes) >= min(least, 10_000):
                c = np.concatenate(classes, axis=1)
                classes.clear()
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip(c, empty)], fields)

        empty = [pa.field(f, {"t": pa.int32(), "own": pa.int32()}.get(f, pa.int64())) for f in fields]
        for group in _groups(batches, 3):
            if group is None:
                yield from ready(1 << 16)
            else:
                of(group)
        yield from ready(0)

    apart = rows.repartition("t", "k", "x").sortWithinPartitions("t", "k", "x", order).mapInArrow(within_blocks, schema)
    if not some:
        return apart.select("a", "b")
    apart = materialize(apart)
    classes = apart.where("t is not null")
    by_class = classes.groupBy("t", "k", "b").agg(F.count("*").alias("n"))
    spread = by_class.groupBy("t", "k").agg(F.max_by("b", "n").alias("largest"), F.count("*").alias("c"), (F.sum("n") - F.max("n")).alias("others"))
    still = materialize(spread.where("c > 1").join(F.broadcast(large.select("t", "k", "g")), ["t", "k"]).withColumn("parts", F.ceil(F.col("others") / (VISITORS * block_rows)).cast("int")).drop("c", "others"))
    rows = classes.join(F.broadcast(still), ["t", "k"]).withColumn("visits", F.col("b") != F.col("largest"))
    home = rows.withColumn("x", F.col("own")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    away = rows.where("visits").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).where("x <> own").withColumn("y", F.pmod(F.xxhash64("a", F.lit(9)), F.col("parts")).cast("int"))
    rows = home.unionByName(away).select("t", "k", "x", "y", "own", F.col("visits").cast("int").alias("visits"), "b", F.col("a").alias("node"), *words)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visitors of blocks before meet all rows of a block, others those of the largest class: no pair meets twice."""
        for group in _groups(batches, 4):
            if group is None:
                continue
            (_, _, x, _, own, visits, label, node), rest = group[:8], group[8:]
            fp = np.ascontiguousarray(rest.T).view(np.uint64) if len(rest) else node.view(np.uint64)
            for one, other in ((own < x, own == x), (own > x, (own == x) & (visits == 0))):
                if not one.any() or not other.any():
                    continue
                found = np.array(find(fp[one], fp[other]), np.int64).reshape(-1, 2)
                both = np.concatenate([np.flatnonzero(one), np.flatnonzero(other)])
                i, j = both[found].T
                other_class = label[i] != label[j]
                i, j = i[other_class], j[other_class]
                at = list({c: n for n, c in enumerate(zip(label[i].tolist(), label[j].tolist()))}.values())
                yield pa.RecordBatch.from_arrays([pa.array(node[i[at]], pa.int64()), pa.array(node[j[at]], pa.int64())], ["a", "b"])

    more = rows.repartition("t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y").mapInArrow(visited, "a long, b long")
    return apart.where("t is null").select("a", "b").unionByName(more)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, free: int | None = None, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable)."""
    own = materialize(fingerprints(docs, shingle))
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = linked(classes.select("fp"), radius, free or free_blocks(classes.count(), radius), block_rows)
    # The component of fingerprints, then the least doc_id in it; fingerprints without links are their own.
    groups = materialize(components(edges).join(classes.select(F.col("fp").alias("node"), "first"), "node"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    in_groups = join_unique(groups, least, "component").select(F.col("node").alias("fp"), F.col("component_id").alias("least"))
    by_fp = classes.join(in_groups, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return join_unique(own, materialize(by_fp), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
