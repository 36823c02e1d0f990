import zlib

import numpy as np

from scriptmill.llm import pairwise_quality as pq
from scriptmill.llm.common import utf8_view


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = pq.judge(d, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.99
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_newton_reaches_a_minimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, len(pq.NAMES)))
    good = x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(400) > -1
    r = pq.fit(x, good)
    assert r.w[0] > r.w[1] > max(abs(r.w[2:]))
    s = r.scores(x)
    assert (s < pq.CUT).sum() == (~good).sum()
    assert np.all((s >= 0) & (s <= 1))


def test_parts_of_a_long_text(monkeypatch):
    import pyarrow as pa

    body, at = utf8_view(pa.array(["Ab c\n\nd é 12!\n" * 200 + "x", None, ""]))
    whole = [pq.features(body[a:b]) for a, b in zip(at[:-1], at[1:])]
    monkeypatch.setattr(pq, "PART", 7)
    assert all(np.allclose(w, pq.features(body[a:b])) for w, a, b in zip(whole, at[:-1], at[1:]))
    assert np.allclose(whole[1], 0) and np.allclose(whole[2], 0)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 5000), (3, "x"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1.0, "q") for i, t in rows], "doc_id long, text string, score double, quality string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (9, None)], "doc_id long, quality int")
    out = pq.judge(docs, labels).collect()
    assert len(out) == 5 and all(abs(r.score - 0.3) < 1e-12 and r.predicted == 1 for r in out)
    assert pq.judge(docs.limit(0), labels).count() == 0
    assert pq.keep(docs, pq.learn(docs, labels)).count() == 5
    assert pq.keep(docs, pq.learn(docs, labels)).schema == docs.schema


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = pq.learn(d, labels), pq.learn(d, flipped)
    assert np.allclose(a.w, b.w) and a.cut == b.cut


def plain_features(text):
    """One byte, word and line at a time."""
    import math

    raw = (text or "").encode()
    blank = b" \t\n\x0b\x0c\r"
    groups = {}
    for c in raw:
        name = "upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122 else "digit" if 48 <= c <= 57 else "line" if c == 10 else "space" if c in blank else "high" if c >= 128 else "control" if c < 33 or c == 127 else chr(c)
        groups[name] = groups.get(name, 0) + 1
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out = [math.log(groups.get(g.removeprefix("share of "), 0) / max(1, len(raw)) + 1e-3) - math.log(1e-3) for g in pq.NAMES[:-5]]
    n, k = len(words), max(1, len(lines))
    return [*out, sum(map(len, words)) / max(1, n), math.log1p(n / k), 1 - len(set(lines)) / k if lines else 0.0, sum(len(x) < 40 for x in lines) / k, math.log1p(n)]


def test_features_and_scores_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = [None, "", " \n\x0b", "Aé!\x00\x7f 1\n\n1\n", "x" * 3000, *[r.text for r in d.collect()]]
    for t in texts:
        own = np.frombuffer((t or "").encode(), np.uint8)
        assert np.allclose(pq.features(own), plain_features(t)), t
    # The query's scores, from the ranking's weights by hand.
    r = pq.learn(d, labels)
    for row in pq.judge(d, labels).join(d, "doc_id").collect():
        z = sum(w * min(8, max(-8, (x - m) / s)) for w, x, m, s in zip(r.w, plain_features(row.text), r.mean, r.scale)) - r.cut
        assert abs(row.score - 1 / (1 + np.exp(-z) * 7 / 3)) < 1e-9


def test_columns_of_any_name(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "1 as __id", "2 as __q", "3 as x", "4 as score")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert pq.judge(d, labels).count() == d.count()
    assert pq.keep(d, pq.learn(d, labels)).schema == d.schema
