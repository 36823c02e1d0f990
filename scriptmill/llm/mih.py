"""Approximate nearest neighbours by multi-index hashing.

Codes: the centred vectors are turned by several learned rotations (iterative quantisation, fitted on a
bounded sample) and each coordinate gives a bit. Index: a code is split into substrings, and each substring
has its own table of rows by value. Search: if two codes differ in at most R bits, then some substring j
differs in at most r_j, where the r_j + 1 add up to more than R; so probing every table within r_j finds all
rows within R. Those are reranked by exact distances.

Rows live in shards: those whose code is nearest to one of some centres, which come from the sample; a centre of
more than SHARD_ROWS rows has several shards. A query is asked twice. At home, in one shard of its centre, it
finds k rows and so a bound on the distance of its k-th neighbour. R follows from that bound: the radius that
holds the wanted share of neighbours at such distances, as the sample's neighbours in the whole table have them.
Then the query goes to the shards that may hold codes within R: others are left out by the triangle inequality
(distance to the centre less the largest distance of the centre's rows). Rows are never copied; a shard's rows
are held by one task while its queries stream by. Vectors that are equal are one row with its k + 1 least ids.

Edge cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite
components take no part, nor do rows with a null id; ties go to the smaller id; rows that repeat an id are
candidates each, but none that has the query's own id is, so a query whose id is repeated may get fewer than k;
it is answered once, for all of its vectors; fewer candidates than k give fewer rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.llm.common import hold, materialize

K = 10
#: Rows and queries of the bounded sample that the codes, centres and radii are fitted on.
SAMPLE_ROWS, SAMPLE_QUERIES = 4000, 200
ROTATIONS, STEPS, SUBSTRING = 4, 12, 16
WANTED = 0.97
SHARD_ROWS = 8192
#: Steps of distance that have a radius each.
LEVELS = 16


@dataclass(frozen=True)
class Codes:
    """Binary codes of 64 * n bits; radii by distance; centres of the shards."""

    mean: np.ndarray
    rotations: np.ndarray  # (dim, bits)
    edges: np.ndarray | None = None  # distances, rising
    radii: np.ndarray | None = None  # the radius up to each

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, bits / 64) words."""
        bits = ((x - self.mean) @ self.rotations > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def radius(self, distance: float) -> int:
        """What holds the wanted share of the neighbours at such a distance."""
        i = int(np.searchsorted(self.edges, distance))
        if i == len(self.edges):
            return min(self.bits, int(np.ceil(self.radii[-1] * distance / self.edges[-1])))
        # Bits that differ spread by about the root of their number, so the radius falls no faster.
        scale = np.sqrt(distance / self.edges[0]) if i == 0 and self.edges[0] > 0 else 1.0
        return int(np.ceil(self.radii[i] * scale))


def _itq(x: np.ndarray, bits: int, rng: np.random.Generator) -> np.ndarray:
    """A rotation of the principal directions that brings the turned vectors near the corners of a cube."""
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v = v[:bits].T
    y = x @ v
    r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
    for _ in range(STEPS):
        u, _, w = np.linalg.svd(y.T @ np.where(y @ r > 0, 1.0, -1.0))
        r = u @ w
    return v @ r


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(-1))


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(-1, dtype=np.int64)


def learn(x: np.ndarray, rotations: int = ROTATIONS) -> Codes:
    """Codes from a sample of vectors."""
    rng = np.random.default_rng(7)
    mean = x.mean(0)
    turn = np.concatenate([_itq(x - mean, x.shape[1], rng) for _ in range(rotations)], axis=1)
    spare = -turn.shape[1] % 64
    if spare:
        turn = np.concatenate([turn, rng.standard_normal((x.shape[1], spare))], axis=1)
    return Codes(mean, turn)


def with_radii(codes: Codes, far: np.ndarray, bits: np.ndarray, wanted: float = WANTED) -> Codes:
    """Radii by distance, from neighbours' distances and the bits in which they differ."""
    if not len(far):
        return Codes(codes.mean, codes.rotations, np.array([0.0]), np.array([codes.bits]))
    order = np.argsort(far, kind="stable")
    parts = np.array_split(order, min(LEVELS, max(1, len(order) // 20)))
    radii = np.maximum.accumulate([np.quantile(bits[p], wanted, method="higher") for p in parts])
    return Codes(codes.mean, codes.rotations, far[[p[-1] for p in parts]], radii)


def centres(codes: np.ndarray, count: int) -> np.ndarray:
    """Codes that many of the sample are near to: majority bits of groups, from some of its rows on."""
    rng = np.random.default_rng(5)
    distinct = np.unique(codes, axis=0)
    own = distinct[np.sort(rng.permutation(len(distinct))[:count])]
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    for _ in range(4):
        label = nearest(codes, own)
        for j in range(len(own)):
            if (m := label == j).any():
                own[j] = np.packbits(bits[m].mean(0) > 0.5, bitorder="little").view("<u8")
    return np.unique(own, axis=0)


def nearest(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The nearest centre of each code; the first of equals."""
    out = np.empty(len(codes), np.int64)
    step = max(1, (1 << 20) // max(1, len(own)))
    for lo in range(0, len(codes), step):
        out[lo : lo + step] = np.bitwise_count(codes[lo : lo + step, None] ^ own).sum(2, dtype=np.int64).argmin(1)
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint16)


_balls: dict[int, np.ndarray] = {}


def split_radii(radius: int, parts: int) -> list[int]:
    """r_j whose r_j + 1 add up to radius + 1."""
    return [(radius + 1) // parts + (j < (radius + 1) % parts) - 1 for j in range(parts)]


class Index:
    """The substring tables of some rows."""

    def __init__(self, codes: Codes, ids: list[list[int]], x: np.ndarray, own: np.ndarray | None = None):
        self.codes, self.x = codes, x
        self.least = np.array([i[0] for i in ids], np.int64)
        self.ids, self.copies = ids, np.array([len(i) for i in ids])
        self.own = codes.of(x) if own is None else own
        self.sub = self.own.view("<u2")
        self.order = np.argsort(self.sub, axis=0, kind="stable").T.copy()
        # Where the rows of each value begin in a table's order.
        self.starts = np.stack([np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << SUBSTRING))]) for s in self.sub.T]).astype(np.int32)
        self.probed = 0  # rows that tables have given, for measurements

    def candidates(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that agree with the code on some substring up to its share of the radius."""
        m = self.sub.shape[1]
        radii = split_radii(radius, m)
        most = radii[0]
        if most < 0:
            return np.zeros(0, np.int64)
        if most <= 3 and sum(len(_ball(r)) for r in radii if r >= 0) <= 2 * len(self.x):
            # Keys of each table are enumerated.
            hit = []
            for j, r in enumerate(radii):
                if r < 0:
                    continue
                keys = code.view("<u2")[j] ^ _ball(r)
                lo, n = self.starts[j][keys], self.starts[j][keys.astype(np.int64) + 1] - self.starts[j][keys]
                full = np.flatnonzero(n)
                for a, k in zip(lo[full].tolist(), n[full].tolist()):
                    hit.append(self.order[j][a : a + k])
            return np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
        # More keys than rows: substrings of half a code, and every row's key is tested.
        half = self.own.shape[1] // 2
        if not half:
            return np.flatnonzero(hamming(self.own, code) <= radius)
        one, two = split_radii(radius, 2)
        near = hamming(self.own[:, :half], code[:half]) <= one
        if two >= 0:
            near |= hamming(self.own[:, half:], code[half:]) <= two
        return np.flatnonzero(near)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius of the code."""
        rows = self.candidates(code, radius)
        self.probed += len(rows)
        return rows[hamming(self.own[rows], code) <= radius]

    def search(self, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the nearest rows within the radius that have k ids together, ties to the smaller id."""
        rows = self.within(code, radius)
        d = distances(self.x[rows], q)
        best = np.lexsort((self.least[rows], d))[:k]
        rows, d = rows[best], d[best]
        # Rows of equal distances hold their ids in turn, so all of them are told apart later.
        enough = np.searchsorted(np.cumsum(self.copies[rows]), k) + 1
        last = d[enough - 1] if enough <= len(d) else np.inf
        near = d <= last
        return rows[near], d[near]


def _ball(radius: int) -> np.ndarray:
    if radius not in _balls:
        _balls[radius] = ball(SUBSTRING, radius)
    return _balls[radius]


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and v (doubles) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.where(fine).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    dims = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    # -0.0 is 0.0, so that equal vectors are equal keys.
    return own.where(F.size("v") == (dims["d"] if dims else 0)).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def calibrated(rows: DataFrame, codes: Codes, queries: np.ndarray, k: int, wanted: float) -> Codes:
    """Radii from the sample's queries and their exact neighbours in the whole table: one pass, k rows a query and task."""
    asked = codes.of(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_h = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
        for b in batches:
            x = _matrix(b.column(0))
            for lo in range(0, len(x), 2048):
                part = x[lo : lo + 2048]
                d = np.sqrt(np.maximum((part**2).sum(1) - 2 * queries @ part.T + (queries**2).sum(1)[:, None], 0))
                d[d < 1e-6 * np.sqrt((queries**2).sum(1))[:, None]] = np.inf  # itself
                keep = np.argsort(d, axis=1, kind="stable")[:, :k]
                own = codes.of(part)
                h = np.stack([hamming(own[i], c) for i, c in zip(keep, asked)]) if len(part) else best_h
                both_d = np.concatenate([best_d, np.take_along_axis(d, keep, 1)], axis=1)
                both_h = np.concatenate([best_h, h], axis=1)
                order = np.argsort(both_d, axis=1, kind="stable")[:, :k]
                best_d, best_h = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_h, order, 1)
        q = np.repeat(np.arange(len(queries)), best_d.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best_d.ravel()), pa.array(best_h.ravel(), pa.int64())], ["q", "d", "h"])

    found = rows.select("v").mapInArrow(scan, "q long, d double, h long").where(F.col("d") < float("inf"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "h"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).toArrow()  # k rows a query
    return with_radii(codes, best.column("d").to_numpy(), best.column("h").to_numpy(), wanted)


_ROW = "cell int, part int, query boolean, id long, ids array<long>, v array<double>, radius int"


def _asked(table: DataFrame, codes: Codes, k: int, home: bool) -> DataFrame:
    """Rows and queries of a shard meet: a task streams them in order, rows first.

    home: each query's radius; else what it finds: id, ids and distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("mih")
        shard, parts, index = None, [], None
        for b in batches:
            cell, part, query = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:3])
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(query) != 0)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if hi == lo:
                    continue
                own = b.slice(lo, hi - lo)
                if (cell[lo], part[lo]) != shard:
                    shard, parts, index = (cell[lo], part[lo]), [], None
                if not query[lo]:
                    parts.append(own)
                    continue
                if index is None:
                    if not parts:
                        continue
                    ids = [i for p in parts for i in p.column(4).to_pylist()]
                    index = Index(codes, ids, np.concatenate([_matrix(p.column(5)) for p in parts]))
                    parts = []
                x = _matrix(own.column(5))
                for i, q, code, radius in zip(own.column(3).to_pylist(), x, codes.of(x), own.column(6).to_pylist()):
                    if home:
                        out.append((i, _home(index, i, q, code, k)))
                    else:
                        rows, d = index.search(q, code, radius, k + 1)
                        out += [(i, index.ids[r], float(y)) for r, y in zip(rows.tolist(), d)]
            kinds = {"id": pa.int64(), "radius": pa.int32()} if home else {"id": pa.int64(), "ids": pa.list_(pa.int64()), "d": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds.values())], list(kinds))

    near = table.repartition("cell", "part").sortWithinPartitions("cell", "part", "query")
    return near.mapInArrow(run, "id long, radius int" if home else "id long, ids array<long>, d double")


def _home(index: Index, own: int, q: np.ndarray, code: np.ndarray, k: int) -> int:
    """The radius to search, by the distance of the k-th id found in this shard; all bits if there are fewer."""
    radius = index.codes.radius(index.codes.edges[0])
    while True:
        rows = index.within(code, radius)
        d = distances(index.x[rows], q)
        n = index.copies[rows] - (index.least[rows] == own)
        order = np.argsort(d, kind="stable")
        at = int(np.searchsorted(np.cumsum(n[order]), k))
        if at < len(order):
            break
        if radius >= index.codes.bits:
            return index.codes.bits
        radius = min(index.codes.bits, 2 * radius + 1)
    bound = float(d[order[at]])
    # What has been found is found again.
    most = int(hamming(index.own[rows[order[: at + 1]]], code).max())
    return max(most, index.codes.radius(bound))


def search(vectors: DataFrame, is_query, id_column: str = "vec_id", column: str = "embedding", k: int = K, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id and score; ``is_query``: which rows are queries (a condition on ``id``)."""
    spark = vectors.sparkSession
    own = materialize(valid(vectors, id_column, column))
    # Equal vectors are one row; of their ids the least k + 1 may be found. Map tasks send no more of each.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = own.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    rows = materialize(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "v"))
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE_ROWS).select("v").toArrow()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(sample.column("v").combine_chunks()).astype(float)
    codes = learn(x)
    codes = calibrated(rows, codes, x[:SAMPLE_QUERIES], k, wanted)
    own_centres = centres(codes.of(x), -(-rows.count() // SHARD_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codes.of(_matrix(b.column(2)))
            cell = nearest(c, own_centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(np.bitwise_count(c ^ own_centres[cell]).sum(1, dtype=np.int32))], ["id", "ids", "v", "cell", "far"])

    placed = materialize(rows.select("id", "ids", "v").mapInArrow(place, "id long, ids array<long>, v array<double>, cell int, far int"))
    reach, parts = np.full(len(own_centres), -1), np.zeros(len(own_centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each centre
        reach[r["cell"]], parts[r["cell"]] = r["far"], -(-r["n"] // SHARD_ROWS)
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(int(max(1, p))) for p in parts]), F.col("cell") + 1)).cast("int")
    shards = placed.select("cell", part.alias("part"), F.lit(False).alias("query"), "id", "ids", "v", F.lit(0).alias("radius"))
    # Queries, as the rows that hold their vectors. A query's vector is in the same shard as its row.
    asks = own.where(is_query).select("id", "v").distinct()
    queries = materialize(asks.join(rows.select("v", F.col("id").alias("own")), "v").select("id", "own", "v"))
    classes = queries.select("own").distinct().join(shards.withColumnRenamed("id", "own"), "own").withColumn("query", F.lit(True)).withColumnRenamed("own", "id")
    names = shards.columns
    radii = materialize(_asked(shards.unionByName(classes.select(names)), codes, k, True))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once for each shard that may hold codes within its radius."""
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                own = b.slice(lo, 64)
                code = codes.of(_matrix(own.column(1)))
                far = np.bitwise_count(code[:, None] ^ own_centres).sum(2, dtype=np.int64)
                at, cell = np.nonzero((reach >= 0) & (far - reach <= own.column(2).to_numpy()[:, None]))
                n = parts[cell]
                at, cell = np.repeat(at, n), np.repeat(cell, n)
                part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                t = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(at), True)), t.column(0), pa.nulls(len(at), pa.list_(pa.int64())), t.column(1), t.column(2)], names)

    wide = radii.join(classes.select("id", "v"), "id").select("id", "v", "radius").mapInArrow(visit, _ROW)
    found = _asked(shards.unionByName(wide), codes, k, False)
    # k + 1 ids for each vector asked, then each query's own id goes.
    each = found.select(F.col("id").alias("own"), F.explode("ids").alias("vec_id"), F.col("d").alias("score"))
    first = F.row_number().over(Window.partitionBy("own").orderBy("score", "vec_id"))
    each = materialize(each.withColumn("rank", first).where(F.col("rank") <= k + 1).drop("rank"))
    near = queries.select(F.col("id").alias("query_id"), "own").join(each, "own").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
