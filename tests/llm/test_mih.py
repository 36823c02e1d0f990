import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptmill.llm import mih


def brute(ids, x, k=10):
    out = {}
    for i, q in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            d[np.array(ids) == i] = np.inf
            best = np.lexsort((ids, d))[:k]
            out[i] = [(ids[j], d[j]) for j in best if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize(("n", "dim"), [(500, 24), (3000, 24), (500, 5)])
def test_every_code_within_the_radius(n, dim):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, dim))
    codes = mih.learn(x)
    index = mih.Index(codes, [[i] for i in range(n)], x)
    for r in (0, 3, 20, 31, 50, 63, codes.bits):
        for i in range(0, n, 50):
            d = np.bitwise_count(index.own ^ index.own[i]).sum(1)
            assert index.within(index.own[i], r).tolist() == np.flatnonzero(d <= r).tolist()


def clustered(n, seed=3):
    """Vectors around many centres, a third of them around one."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 25, 64))
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, len(centre), n))
    return centre[label] + 0.15 * rng.standard_normal((n, 64))


def measured(spark, df, want):
    """Recall; every result is checked for its rank and score."""
    got: dict = {}
    for r in mih.search(df, F.col("id") % 100 == 0, column="embedding").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == len(want[q]) for q, v in got.items())
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in got for i, s in got[q] if i in exact[q])
    recall = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    print("recall", recall)
    return recall


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_recall(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(mih, "SHARD_ROWS", shard_rows)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    assert measured(spark, e, want) >= 0.9


@pytest.mark.parametrize("shard_rows", [500, 8192])
def test_recall_on_clusters_and_copies(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(mih, "SHARD_ROWS", shard_rows)
    x = clustered(6000)
    x[::7] = x[1]  # a hot vector
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    assert measured(spark, df, brute(ids, x)) >= 0.9


def test_probing_prunes_clusters():
    """Rows that tables give and rows that are reranked, of one shard's."""
    x = clustered(20_000)
    codes = mih.learn(x[:4000])
    q = x[:200]
    d = np.sqrt(((q[:, None] - x[None, :4000]) ** 2).sum(-1))
    d[np.arange(200), np.arange(200)] = np.inf
    best = np.argsort(d, axis=1)[:, :10]
    own = codes.of(x)
    codes = mih.with_radii(codes, np.take_along_axis(d, best, 1).ravel(), np.concatenate([mih.hamming(own[b], own[i]) for i, b in enumerate(best)]))
    index = mih.Index(codes, [[i] for i in range(len(x))], x)
    reranked = hits = probed = asked = 0
    for i in range(0, len(x), 100):
        radius = mih._home(index, i, x[i], own[i], 10)
        index.probed = 0
        rows, _ = index.search(x[i], own[i], radius, 11)
        probed += index.probed
        reranked += len(index.within(own[i], radius))
        want = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:11]
        hits += len({*rows.tolist()} & {*want.tolist()})
        asked += 1
    print("recall", hits / asked / 11, "probed", probed / asked / len(x), "reranked", reranked / asked / len(x))
    assert hits >= 0.9 * 11 * asked and probed < 0.2 * asked * len(x) and reranked <= probed


def test_triangle_leaves_shards_out():
    x = clustered(6000)
    codes = mih.learn(x[:4000])
    own = codes.of(x)
    centre = mih.centres(own[:4000], 40)
    cell = mih.nearest(own, centre)
    reach = np.array([mih.hamming(own[cell == j], centre[j]).max(initial=-1000) for j in range(len(centre))])
    visited = []
    for i in range(0, 6000, 100):
        far = np.bitwise_count(centre ^ own[i]).sum(1).astype(int)
        visits = far - reach <= 40
        assert set(cell[mih.hamming(own, own[i]) <= 40].tolist()) <= set(np.flatnonzero(visits).tolist())
        visited.append(visits.mean())
    assert np.mean(visited) < 0.7


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 2.0]), (None, [1.0, 1.0]), (100, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in mih.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 8), (0, 4, 9), (0, 5, 100), (100, 1, 9), (100, 2, 0), (100, 3, 7), (100, 4, 8), (100, 5, 8)]
    assert got[3][3] == round(5**0.5, 9)
    assert mih.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert mih.search(df.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0
