import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import simhash as sh
from scriptmill.llm.components import components


def brute_fingerprint(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    own = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \n", "a", "A b", "a b c d", "É é x\x1cy z w v", "w " * 70000, "the cat " * 9]


def brute_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least: dict = {}
    for i in range(len(ids)):
        least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint():
    for t in TEXTS:
        assert sh.fingerprint((t or "").encode()) == brute_fingerprint(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 7), st.data())
def test_bit_sliced_distances(fps, radius, data):
    base = fps[0]
    fps += [base ^ (1 << data.draw(st.integers(0, 63))) ^ (1 << data.draw(st.integers(0, 63))) for _ in range(20)]
    mask = np.unpackbits(sh.near(base, sh.planes(np.array(fps, np.uint64)), radius).view(np.uint8), bitorder="little")[: len(fps)]
    assert mask.astype(bool).tolist() == [(base ^ f).bit_count() <= radius for f in fps]
    x = np.array(fps, np.uint64)
    assert sh.near_pairs(x, np.roll(x, 1), radius).tolist() == [(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(x, np.roll(x, 1))]


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 2**63, 6)]
    out = []
    for _ in range(n):
        f = centres[rng.integers(6)] if rng.random() < 0.8 else int(rng.integers(0, 2**63))
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return out


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_components_equal_brute_force(spark, block_rows):
    fps = list(dict.fromkeys(clustered(400, block_rows)))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.component for r in components(sh.linked(df, block_rows=block_rows)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute_components(signed, fps)
    assert [got.get(f, f) for f in signed] == want


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_documents(spark):
    rng = np.random.default_rng(5)
    texts = [*TEXTS, "", *[" ".join(rng.choice(list("abcdefgh"), 300)) for _ in range(20)]]
    texts += [t + " tail" for t in texts[-20:]]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, fp int, component_id int")
    got = sh.digest(docs).collect()
    assert len(got) == len(rows) + 3
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert sh.digest(docs.limit(0)).count() == 0


def test_a_dense_cluster_takes_no_square():
    import time

    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**63))
    fps = np.array(sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a in range(64) for b in range(64)}), np.uint64)
    seconds = []
    for m in (500, 2000):
        began = time.perf_counter()
        found = sh.links(fps[:m], None, 4)
        seconds.append(time.perf_counter() - began)
        assert len(found) == m - 1
    assert seconds[1] < 0.5
    mixed = np.concatenate([fps[:1000], rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    began = time.perf_counter()
    assert len(sh.links(mixed, None, 4)) == 999 and time.perf_counter() - began < 2


def test_work_is_counted_in_planes_read():
    """Of a square of probes and rows, abandoned words leave a fifth; a cluster that is one from its first probe takes no square."""
    rng = np.random.default_rng(6)
    apart = rng.integers(0, 2**63, 4096, dtype=np.uint64)
    read: list[int] = []
    assert sh.links(apart, None, 4, read) == []
    square = len(apart) * (len(apart) // 64) * 64  # words of all planes for all probes
    assert sum(read) < square / 4 and len(read) < 16 * (len(apart) / sh.PROBES + 10)  # calls: rounds for each group of probes
    near = np.array([int(apart[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)], np.uint64)
    read.clear()
    assert len(sh.links(np.concatenate([apart[:1], near]), None, 4, read)) == len(near)
    assert sum(read) <= 2 * 64 * (len(near) // 64 + 2)


def test_keys_grow_with_the_number_of_fingerprints():
    assert [sh.free_blocks(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [2, 2, 3, 4, 4]
    for free in sh.FREE_BLOCKS:
        masks = sh.tables(4, free)
        rng = np.random.default_rng(free)
        for _ in range(50):  # any four bits leave some table's key alone
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flip & m for m in masks)


@pytest.mark.parametrize("free", [3, 4])
def test_longer_keys_find_the_same(spark, free):
    fps = list(dict.fromkeys(clustered(200, free)))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in components(sh.linked(df, free=free)).collect()}
    assert [got.get(f, f) for f in signed] == brute_components(signed, fps)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from scriptmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(i, i) for i in range(60)] + [(None, 7)] * 20, "k long, x long")
    right = spark.createDataFrame([(i, 10 * i) for i in range(0, 60, 2)] + [(1, 10)], "k long, y long")
    assert set(common.hot_keys(left, "k")) == {1, None}
    got = sorted((tuple(r) for r in common.join_unique(left, right, "k").select("k", "x", "y").collect()), key=repr)
    assert got == sorted((tuple(r) for r in left.join(right, "k", "left").select("k", "x", "y").collect()), key=repr)
    edges = [(0, i) for i in range(1, 80)] + [(i, i + 1) for i in range(100, 140)]
    labels = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(80)} | {i: 100 for i in range(100, 141)}


def test_edges_that_differ_each_time_lose_no_link(spark):
    """Spanning forests depend on the order in which rows arrive; both directions come from one of them."""
    from pyspark.sql import functions as F

    # One of two forests over four nodes, another one whenever it is computed.
    forests = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (3, 2, 1), (2, 1, 1)], "a long, b long, forest int")

    @F.udf("int")
    def which(_):
        import time

        return time.time_ns() // 1000 % 2

    edges = spark.range(40).select(F.col("id").alias("g"), which.asNondeterministic()("id").alias("forest")).join(forests, "forest").select((F.col("a") + 4 * F.col("g")).alias("a"), (F.col("b") + 4 * F.col("g")).alias("b"))
    assert {r.node: r.component for r in components(edges).collect()} == {i: i // 4 * 4 for i in range(160)}


def _groups(nodes, edges):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return [top(n) for n in nodes]


def _asked(spark, fps, monkeypatch, block_rows):
    """Edges between fingerprints of one key, how many there are, and the rows that blocks were given."""
    given = []
    materialize = sh.materialize
    monkeypatch.setattr(sh, "materialize", lambda df: given.append(materialize(df)) or given[-1])
    keyed = spark.createDataFrame([(f, 0, 0) for f in fps], "node long, t int, k long").repartition(3)
    find = lambda x, y: sh.links(x, y, 4)
    return [tuple(r) for r in sh.compared(keyed, find, lambda x, y: sh.near_pairs(x, y, 4), block_rows).collect()], given


def test_near_copies_of_a_large_key_give_linearly_many_edges(spark, monkeypatch):
    """600 fingerprints around one, in 60 blocks of a key, and 20 others: pairs of blocks would give some 36,000 edges."""
    rng = np.random.default_rng(3)
    near = [1 << int(a) | 1 << int(b) for a, b in zip(rng.integers(0, 31, 2000), rng.integers(31, 62, 2000))]
    fps = sorted(set(near))[:600] + [int(x) for x in rng.integers(1 << 61, 1 << 62, 20)]
    edges, given = _asked(spark, fps, monkeypatch, 10)
    assert len(set(_groups(fps, edges))) == 21
    assert len(edges) < 4 * 600
    still = next(df for df in given if df.columns[-1] == "parts").collect()
    classes = next(df for df in given if df.columns[:2] == ["a", "b"]).where("t is not null").collect()
    assert len(classes) == 620 and sum(r.b != still[0].largest for r in classes) <= 20 + 60


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_a_large_key_lose_no_link(spark, monkeypatch, seed):
    """Some groups of one key, chains among them, against all pairs."""
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = set()
    for c in centres:
        x = c
        for _ in range(30):
            y = (x if rng.random() < 0.5 else c) ^ sum({1 << int(i) for i in rng.integers(0, 62, int(rng.integers(1, 4)))})
            x = y
            fps.add(y)
    fps = sorted(fps)
    edges, _ = _asked(spark, fps, monkeypatch, 7)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert {tuple(sorted(e)) for e in edges} <= {tuple(sorted(p)) for p in pairs}
    assert _groups(fps, edges) == _groups(fps, pairs)


def test_rounds_are_over_what_stars_leave(spark, monkeypatch):
    """Three hubs that share 100 leaves, and a chain: few edges come to the rounds, and none of stars alone."""
    from scriptmill.llm import components as co

    came = []
    rounds = co._rounds
    monkeypatch.setattr(co, "_rounds", lambda both: came.append(both.count()) or rounds(both))
    stars = [(hub, 10 + leaf) for hub in range(3) for leaf in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(3)
    found = {r.node: r.component for r in co.components(frame(stars)).collect()}
    assert len(found) == 103 and set(found.values()) == {0} and came in ([], [2], [4])
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    found = {r.node: r.component for r in co.components(frame([*stars, *chain, (5000, 5000)])).collect()}
    assert found == {n: 0 for n in [0, 1, 2, *range(10, 110)]} | {n: 1000 for n in range(1000, 1041)} | {5000: 5000}
