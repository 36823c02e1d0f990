"""Near copies of texts: components under Jaccard similarity of word shingles.

Candidates come from SimHash by bit-sliced comparison, as in ``simhash``, with sketches wide enough for the similarity. A sketch bit is
set where more than half of a text's distinct shingles have it; two texts of similarity s differ in a bit with probability
arccos(2s / (1 + s)) / pi at most, which is 0.151 at 0.8. The bits of a table are its key, apart from all other tables' bits, and there are
as many tables as leave one pair in 1 / MISSED of similarity 0.8 without a common key. Within a key the first word of the sketches is
compared bit-sliced (NEAR_BITS), whoever is left by all SKETCH_WORDS words (SKETCH_BITS). The candidates' components are then compared by
whole shingle sets, so that no link is below the threshold, and a set goes to one component, not to each of its keys.

Within a task texts meet by their rarest shingles: of two similar texts the first shingle that they share, rare ones first, lies
near the beginning of both (prefixes), so that texts alike below the threshold are hardly ever compared, however many they are.

A component of more rows or shingles than a block is cut into blocks, each with the component's least text as a pivot, and rows are
compared within their block. Copies of one text are one component by then, in linear work, whatever their number.
Where candidates have other components left, their rows, and only they, visit the other blocks, so that no link is
lost. Texts that are linked already, also by others, aren't compared again.

Edge cases: null and blank texts are alike; texts of fewer words than a shingle have one shingle; a component
of null ids alone has a null id; of rows that repeat an id with one text ``distinct`` keeps one; an empty table
gives an empty result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm import simhash
from scriptmill.llm.common import hold, join_unique, materialize, short_batches, utf8_texts
from scriptmill.llm.components import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Texts of this similarity differ in a bit of their sketches with this probability.
DIFFER = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Bits in which texts of this similarity may differ: four deviations more than they do on average, in one word and in all.
SKETCH_WORDS = 4
NEAR_BITS, SKETCH_BITS = (math.ceil(n * DIFFER + 4 * math.sqrt(n * DIFFER * (1 - DIFFER))) for n in (64, 64 * SKETCH_WORDS))
#: Pairs without a common key; unrelated rows of a key, which bit-slicing compares 64 at a time; bits of a key.
MISSED, UNRELATED, KEY_BITS = 4e-4, 1024, range(4, 21)
BLOCK_ROWS = 2048
#: Shingles of a block: bounds memory where texts are long.
BLOCK_SHINGLES = 1 << 21
#: Hashes that are mixed at a time: bounds memory for long texts.
MIXED = 1 << 12
#: Bytes of shingle sets that leave a worker at once.
SENT = 1 << 22
#: Bits a row of the filter that tells whose texts are shuffled, and of the whole filter: bounds what is broadcast.
FILTER_SHARE, FILTER_BITS = 16, 1 << 27

_rng = np.random.default_rng(11)
_ODD = _rng.integers(0, 1 << 63, 96, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, 96, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    stop = (start + size)[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist())], np.uint64))


def key_tables(texts: int) -> tuple[int, int]:
    """Bits of a key, and how many tables there are."""
    bits = min(max(round(math.log2(max(texts, 1) / UNRELATED)), KEY_BITS[0]), KEY_BITS[-1])
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** bits)))


def sketch(own: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, list[int]]:
    """A set's sketch (SKETCH_WORDS words) and its key in each table."""
    words = SKETCH_WORDS - (-bits * tables // 64)
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(own), MIXED):
        x = (own[lo : lo + MIXED, None] ^ _XOR[:words]) * _ODD[:words]
        x ^= x >> np.uint64(32)
        x *= _ODD[:words]
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    one = (2 * ones > len(own)).astype(np.uint8)
    keys = one[64 * SKETCH_WORDS :][: bits * tables].reshape(tables, bits) @ (1 << np.arange(bits))
    return np.packbits(one[: 64 * SKETCH_WORDS], bitorder="little").view("<u8"), keys.tolist()


def near_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of sketches may be similar."""
    hit = simhash.near_pairs(x[:, 0], y[:, 0], NEAR_BITS)
    hit[hit] = np.bitwise_count(x[hit] ^ y[hit]).sum(1) <= SKETCH_BITS
    return hit


def sketch_links(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may be similar, between two lists of sketches (right None: within the left)."""
    own = left if right is None else np.concatenate([left, right])
    other, shift = (own, 0) if right is None else (right, len(left))
    vertical = simhash.planes(other[:, 0])
    label, apart = np.arange(len(own)), len(own)
    found: list[tuple[int, int]] = []
    lo, step = 0, 1  # the first goes alone, for it may link all
    while lo < len(left) and apart > 1:
        at = lo // 64 if right is None else 0  # rows before have been probed
        masks = simhash.within(vertical[:, at:], left[lo : lo + step, 0], NEAR_BITS)
        i, j = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
        i, j = i + lo, j + 64 * at
        inside = (j < len(other)) & (j > i) if right is None else j < len(other)
        i, j = i[inside], j[inside] + shift
        asked = label[i] != label[j]
        i, j = i[asked], j[asked]
        hit = np.bitwise_count(own[i] ^ own[j]).sum(1) <= SKETCH_BITS
        i, j = i[hit], j[hit]
        for hits in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
            a, b = int(i[hits[0]]), j[hits]
            b = b[label[b] != label[a]]
            others, first = np.unique(label[b], return_index=True)
            if len(others):
                found += [(a, x) for x in b[first].tolist()]
                label[np.isin(label, others)] = label[a]
                apart -= len(others)
        lo, step = lo + step, min(8 * step, simhash.PROBES)
    return found


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared)


def prefixes(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, set, place) of what can be the first shingle that two similar sets share, sorted by token, rare tokens first.

    Sets are ordered by how many of them hold a shingle. Two sets of similarity s share s / (1 + s) of their sizes' sum at least,
    and at most what follows the first that they share; a partner is no smaller than s times a set and than the smallest set.
    Shingles of one set alone are never shared, but count as places.
    """
    size = np.array([len(x) for x in sets], np.int64)
    if not size.sum():
        return (np.zeros(0, np.int64),) * 3
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))
    own = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((rank[token], own))
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    token = token[order]
    partner = np.maximum(np.ceil(similarity * size - 1e-9), size[size > 0].min())
    shared = np.ceil(similarity / (1 + similarity) * (size + partner) - 1e-9)
    use = (count[token] > 1) & (size[own] - place >= shared[own])
    token, own, place = rank[token[use]], own[use], place[use]
    order = np.argsort(token, kind="stable")
    return token[order], own[order], place[order]


def links(sets: list[np.ndarray], side: list[int] | None = None, label: list[int] | None = None, compared: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides (None: between all), beyond what equal labels join already.

    Sets are compared if they share a shingle of their prefixes, have sizes and places that allow the similarity, and aren't joined
    yet, and then once. ``compared``, if given, gets 1 for each comparison.
    """
    n = len(sets)
    every = side is None
    side = np.zeros(n, np.int64) if side is None else np.array(side)
    root = np.unique(np.array(label), return_inverse=True)[1] if label is not None else np.arange(n)
    size = np.array([len(x) for x in sets], np.int64)
    found: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        found.append((min(i, j), max(i, j)))
        root[root == root[j]] = root[i]

    blank = np.flatnonzero(size == 0).tolist()  # alike
    for i in blank[1:]:
        for j in blank[:1] if every else [next((x for x in blank if side[x] != side[i]), i)]:
            if root[i] != root[j]:
                join(j, i)
    if not every and blank and (other := next((x for x in blank if side[x] != side[blank[0]]), None)) is not None and root[blank[0]] != root[other]:
        join(blank[0], other)
    token, own, place = prefixes(sets)
    cuts = np.flatnonzero(np.diff(token)) + 1
    tested: set[int] = set()
    for members, at in zip(np.split(own, cuts), np.split(place, cuts)):
        if (root[members] == root[members[:1]]).all():
            continue
        left = size[members] - at
        for k in range(len(members) - 1):
            i = int(members[k])
            js, more = members[k + 1 :], left[k + 1 :]
            s = size[js]
            least = np.ceil(SIMILARITY / (1 + SIMILARITY) * (s + size[i]) - 1e-9)
            fits = (root[js] != root[i]) & (np.minimum(s, size[i]) >= SIMILARITY * np.maximum(s, size[i]) - 1e-9) & (np.minimum(more, left[k]) >= least)
            if not every:
                fits &= side[js] != side[i]
            for j in js[fits].tolist():
                pair = min(i, j) * n + max(i, j)
                if root[i] == root[j] or pair in tested:
                    continue
                tested.add(pair)
                if compared is not None:
                    compared.append(1)
                if similar(sets[i], sets[j]):
                    join(i, j)
    return found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), "text")


def _compare(table: pa.Table) -> pa.Table:
    same = table.column("same").to_numpy()
    side, label = (table.column(c).to_pylist() for c in ("side", "label"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    found = links(sets, side, label) if any(side) else links(sets)
    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(same[found[:, 0]], pa.int64()), "b": pa.array(same[found[:, 1]], pa.int64())})


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of each hash among ``size`` bits, a power of two."""
    own = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes
    return [((own >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64) for shift in (0, 32)]


def marked(rows: DataFrame, column: str, most: int = FILTER_BITS) -> np.ndarray:
    """A filter of the column's hashes: FILTER_SHARE bits a row or more, but ``most`` bits at any size."""
    size = min(most, 1 << max(10, math.ceil(math.log2(max(1, rows.count()) * FILTER_SHARE))))
    places = F.explode(F.array(*[F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(size - 1)) for shift in (0, 32)])).alias("at")
    part = F.shiftright("at", 5)
    found = rows.select(places).groupBy(part.alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[found.column("part").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def passes(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter; all that are in it."""
    each = [(marks[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) for at in _bits(hashes, 32 * len(marks))]
    return (each[0] & each[1]).astype(bool)


def candidates(keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(same, k) of the texts that may be similar to others: k is their component. ``keys``: same, words (a sketch), keys."""
    words = [F.col("words")[i].alias(f"w{i}") for i in range(SKETCH_WORDS)]
    keyed = keys.select(F.col("same").alias("node"), *words, F.posexplode("keys").alias("t", "k"))
    return components(simhash.compared(keyed, sketch_links, near_pairs, block_rows)).select(F.col("node").alias("same"), F.col("component").alias("k"))


def linked(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between the hashes of texts."""
    spark = docs.sparkSession
    bits, tables = key_tables(docs.count())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_text")
        for b in batches:
            sizes, words, keys = [], [], []
            for t in utf8_texts(b.column(3)):
                own = shingles(t)
                word, key = sketch(own, bits, tables)
                sizes.append(len(own))
                words.append(word.view(np.int64).tolist())
                keys.append(key)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int32()))], ["same", "none", "id", "size", "words", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets of the texts that pass the filter."""
        hold("near_text")
        names = ["same", "row", "shingles"]
        for b in batches:
            b = b.filter(pa.array(passes(marks.value, b.column(1).to_numpy())))
            same, row, own = [], [], []
            for x, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8_texts(b.column(2))):
                same.append(x)
                row.append(y)
                own.append(shingles(t).tobytes())
                if sum(map(len, own[-64:])) > SENT or len(own) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), pa.array(row, pa.int64()), pa.array(own, pa.binary())], names)
                    same, row, own = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), pa.array(row, pa.int64()), pa.array(own, pa.binary())], names)

    named = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    texts = _texts(short_batches(docs)).select("same", *named, "text")
    # Of equal texts one is looked at again, that of the least id: a row's place doesn't depend on its text alone.
    first = F.min(F.struct("none", "id")).alias("first")
    own = texts.mapInArrow(sketched, "same long, none boolean, id long, size long, words array<long>, keys array<int>")
    keys = materialize(own.groupBy("same").agg(F.first("size").alias("size"), F.first("words").alias("words"), F.first("keys").alias("keys"), first))
    placed = materialize(candidates(keys, block_rows).join(keys.select("same", "size", "first.none", "first.id"), "same"))
    blocks = F.ceil(F.greatest(F.col("n") / block_rows, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("g")
    sizes = materialize(placed.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("same").alias("pivot")).select("k", "pivot", blocks))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    rows = materialize(join_unique(placed.select("same", "k"), sizes, "k").withColumn("x", F.pmod(F.xxhash64("same"), F.col("g")).cast("int")))
    # Only texts that have candidates are shuffled, and few others: a bounded filter tells, the join decides.
    wanted = placed.select("same", F.xxhash64("same", "none", "id").alias("row"))
    marks = spark.sparkContext.broadcast(marked(wanted, "row"))
    asked_for = short_batches(texts.select("same", F.xxhash64("same", "none", "id").alias("row"), "text"))
    passed = asked_for.mapInArrow(sets, "same long, row long, shingles binary").join(wanted.withColumnRenamed("row", "first"), "same")
    # Not a key of the join: sets are dealt by text once.
    content = passed.where(F.col("row").bitwiseXOR(F.col("first")) == 0).groupBy("same").agg(F.first("shingles").alias("shingles"))
    large = sizes.where("g > 1")
    several = large.limit(1).count() > 0
    content = materialize(content) if several else content

    def compared(asked: DataFrame) -> DataFrame:
        return asked.join(content, "same").groupBy("k", "x").applyInArrow(_compare, "a long, b long")

    plain = [F.lit(0).alias("side"), F.lit(0).cast("long").alias("label")]
    near = rows.select("same", "k", "x", *plain)
    if not several:
        return compared(near)
    near = near.unionByName(large.select(F.col("pivot").alias("same"), "k", every.alias("x"), *plain))
    edges = materialize(compared(near))
    # What is not in the largest component of its candidates visits the other blocks.
    groups = components(edges).select(F.col("node").alias("same"), "component")
    members = materialize(rows.where("g > 1").join(groups, "same", "left").withColumn("label", F.coalesce("component", "same")).select("same", "k", "g", "x", "label"))
    counts = members.groupBy("k", "label").agg(F.count("*").alias("n")).groupBy("k").agg(F.max_by("label", "n").alias("largest"), F.count("*").alias("n")).where("n > 1").select("k", "largest")
    left = materialize(members.join(counts, "k"))
    visits = left.where("label <> largest").withColumn("own", F.col("x")).withColumn("x", every).where("x <> own")
    columns = ["same", "k", "x", "side", "label"]
    more = compared(left.withColumn("side", F.lit(0)).select(*columns).unionByName(visits.withColumn("side", F.lit(1)).select(*columns)))
    return edges.unionByName(more)


def _classes(docs: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id and same of all rows; same, id of the class and the least row of its component)."""
    own = materialize(_texts(docs).select("doc_id", "same"))
    # Ids come before null.
    classes = materialize(own.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("first")))
    groups = components(linked(docs, block_rows)).select(F.col("node").alias("same"), "component")
    groups = materialize(groups.join(classes, "same"))
    least = groups.groupBy("component").agg(F.min("first").alias("least"))
    in_groups = join_unique(groups, least, "component").select("same", "least")
    return own, materialize(classes.join(in_groups, "same", "left").select("same", "first", F.coalesce("least", "first").alias("least")))


def near_copies(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of each row."""
    own, classes = _classes(docs, block_rows)
    return join_unique(own, classes.select("same", F.col("least")["doc_id"].alias("component_id")), "same").select("doc_id", "component_id")


def distinct(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of each component, all columns unchanged: that of the least doc_id; null ids come last."""
    own, classes = _classes(docs, block_rows)
    key = ["id", "none", "same"]
    named = lambda i: [F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none")]
    first = classes.where(F.col("first") == F.col("least")).select(*named(F.col("first")["doc_id"]), "same")
    rows = docs.select(*named(F.col("doc_id").cast("long")), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = rows.join(first.hint("shuffle_hash"), key, "left_semi")
    again = materialize(own.select(*named(F.col("doc_id")), "same").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    if again.limit(1).count():  # rows of one id and text: one of them
        once = kept.join(again, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        kept = kept.join(again, key, "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")
