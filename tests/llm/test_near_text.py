import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

from scriptmill.llm import near_text


def brute(rows):
    def own(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = [own(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (len(a & b) >= 0.8 * len(a | b)):
                label = [label[j] if x == label[i] else x for x in label]
    return {d: min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i, (d, _) in enumerate(rows)}


def corpus():
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "a b", "A  b", "c d"]
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for e in range(6):  # e edits of 5 shingles each: similarity (196 - 5e) / (196 + 5e), 0.81 at 4
            own = list(words)
            for i in range(e):
                own[20 + 30 * i] = f"x{k}-{e}-{i}"
            texts.append(" ".join(own))
    return list(enumerate(texts))


@pytest.mark.parametrize("block_rows", [2048, 2])
def test_components_equal_brute_force(spark, block_rows):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_text.near_copies(docs, block_rows).collect()} == brute(rows)


def test_the_stage_removes_copies_of_similarity_above_080(spark):
    words = [f"w{i}" for i in range(200)]
    other = list(words)
    for i in (30, 80, 130):
        other[i] = "x"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_a_large_group_of_copies_takes_linear_work(spark, monkeypatch):
    """Blocks of a bucket share a pivot; rows of its one component don't visit other blocks."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in range(400)]
    rows = []
    for i in range(120):
        own = list(words)
        own[int(rng.integers(400))] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []
    materialize = near_text.materialize
    monkeypatch.setattr(near_text, "materialize", lambda df: made.append(materialize(df)) or made[-1])
    assert {r.component_id for r in near_text.near_copies(docs, 10).collect()} == {0}
    left = next(df for df in made if df.columns[-1] == "largest")
    assert left.count() == 0


def test_links_beyond_labels():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 2, 500, 502, 1000)]
    assert near_text.links(sets) == [(0, 1), (2, 3)]
    assert near_text.links(sets, [0, 0, 0, 1, 0]) == [(2, 3)]
    assert near_text.links(sets, [0, 1, 0, 1, 1], [7, 7, 8, 9, 10]) == [(2, 3)]


def test_exact_copies_in_large_buckets(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(i, words if i % 3 else words + f" e{i}") for i in range(60)] + [(None, words), (None, words), (70, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_text.distinct(docs, 5).collect()) == [0, 70]


def _alike(rng, n, share, own):
    """Sets that share ``share`` shingles and have ``own`` of their own."""
    common = rng.integers(1, 1 << 62, share, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, own, dtype=np.uint64)])) for _ in range(n)]


def test_texts_alike_below_the_threshold_are_not_compared():
    """2,000 sets of similarity 0.75 each to each: two million pairs."""
    rng = np.random.default_rng(4)
    sets = _alike(rng, 2000, 300, 50)
    assert not near_text.similar(sets[0], sets[1]) and near_text.similar(sets[0], sets[1], 0.74)
    compared: list[int] = []
    assert near_text.links(sets, None, None, compared) == [] and len(compared) == 0
    near = [np.unique(np.concatenate([sets[i][:-20], rng.integers(1, 1 << 62, 20, dtype=np.uint64)])) for i in range(0, 2000, 100)]
    found = near_text.links(sets + near, None, None, compared)
    assert sorted(found) == [(i * 100, 2000 + i) for i in range(20)] and len(compared) < 100


def test_copies_take_no_square():
    rng = np.random.default_rng(5)
    sets = [x for x in _alike(rng, 1500, 400, 8)]
    compared: list[int] = []
    assert len(near_text.links(sets, None, None, compared)) == 1499 and len(compared) < 1600


def test_links_equal_all_pairs():
    rng = np.random.default_rng(6)
    for trial in range(40):
        base = [rng.integers(1, 1 << 40, int(rng.integers(1, 60)), dtype=np.uint64) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 40))):
            x = base[rng.integers(4)]
            keep = x[rng.random(len(x)) > rng.choice([0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 40, int(rng.integers(0, 4)), dtype=np.uint64)])))
        sets += [np.zeros(0, np.uint64)] * int(rng.integers(0, 3))
        n = len(sets)
        side = None if trial % 2 else rng.integers(0, 2, n).tolist()
        label = None if trial % 3 else rng.integers(0, n, n).tolist()

        def components(edges):
            root = list(range(n)) if label is None else [label.index(x) for x in label]
            for a, b in edges:
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
            return root

        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (side is None or side[i] != side[j]) and near_text.similar(sets[i], sets[j])]
        found = near_text.links(sets, side, label)
        assert set(found) <= set(pairs)
        assert components(found) == components(pairs)
        assert len(found) == len(set(components([]))) - len(set(components(pairs)))  # a forest


def _sketches(rng, n):
    """Sketches around a few centres, up to more bits away than candidates may be."""
    centres = rng.integers(0, 2, (5, 256), dtype=np.uint8)
    bits = centres[rng.integers(5, size=n)] ^ (rng.random((n, 256)) < rng.choice([0.0, 0.05, 0.15, 0.3], (n, 1))).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _may_be_similar(a, b):
    far = np.bitwise_count(a ^ b)
    return bool(far[0] <= near_text.NEAR_BITS and far.sum() <= near_text.SKETCH_BITS)


@pytest.mark.parametrize("sides", [1, 2])
def test_bit_sliced_candidates_equal_all_pairs(sides):
    rng = np.random.default_rng(sides)
    left = _sketches(rng, 300)
    right = _sketches(rng, 150) if sides == 2 else None
    every = left if right is None else np.concatenate([left, right])
    n, m = len(every), len(left)
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if (right is None or i < m <= j) and _may_be_similar(every[i], every[j])}
    found = near_text.sketch_links(left, right)
    assert set(found) <= pairs

    def groups(edges):
        root = list(range(n))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert groups(found) == groups(pairs) and len(found) == n - len(set(groups(pairs)))  # a forest
    i, j = rng.integers(n, size=(2, 500))
    assert near_text.near_pairs(every[i], every[j]).tolist() == [_may_be_similar(a, b) for a, b in zip(every[i], every[j])]


@pytest.mark.parametrize("texts", [1000, 1_000_000])
def test_similar_texts_share_a_key_and_are_near(texts):
    """500 pairs of similarity 0.8."""
    rng = np.random.default_rng(9)
    bits, tables = near_text.key_tables(texts)
    missed = 0
    for size in [9, 90] * 250:
        x = rng.integers(1, 1 << 63, size + size // 9, dtype=np.uint64)
        one, other = (near_text.sketch(s, bits, tables) for s in (x[:size], np.concatenate([x[: size - size // 9], x[size:]])))
        missed += not (_may_be_similar(one[0], other[0]) and any(a == b for a, b in zip(one[1], other[1])))
    assert missed <= 1
    assert near_text.sketch(np.zeros(0, np.uint64), bits, tables)[1] == [0] * tables


def test_candidates_come_from_the_bit_sliced_comparison(spark, monkeypatch):
    """The stage's rows get there through simhash's comparison of sketches, by key."""
    from scriptmill.llm import simhash

    asked = []
    compared = simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda keyed, *rest: asked.append(sorted(keyed.columns)) or compared(keyed, *rest))
    rows = [(i, f"w{i} " + " ".join(f"w{x}" for x in range(100))) for i in range(3)] + [(9, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [0, 9]
    assert asked == [["k", "node", "t", "w0", "w1", "w2", "w3"]]


def test_blocks_of_long_texts_are_bounded_by_shingles(spark, monkeypatch):
    """40 near copies of 400 shingles: one block by their rows, many by their shingles."""
    rows = [(i, " ".join(f"w{x}" if x != 9 * i else f"x{i}" for x in range(404))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []
    materialize = near_text.materialize
    monkeypatch.setattr(near_text, "materialize", lambda df: made.append(materialize(df)) or made[-1])
    monkeypatch.setattr(near_text, "BLOCK_SHINGLES", 2000)
    assert [r.doc_id for r in near_text.distinct(docs).collect()] == [0]
    assert [r.g for df in made if df.columns[-1] == "g" for r in df.collect()] == [8]  # 16,000 shingles


def test_the_filter_has_all_its_rows_and_few_others(spark):
    """What the filter stops isn't shuffled; a filter that is too small stops less, but none of its own rows."""
    own = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 3000)
    rows = spark.createDataFrame([(int(x),) for x in own], "row long")
    others = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 100_000)
    marks = near_text.marked(rows, "row")
    assert near_text.passes(marks, own).all() and near_text.passes(marks, others).mean() < 0.03
    small = near_text.marked(rows, "row", 1 << 12)
    assert len(small) == 128 and near_text.passes(small, own).all()
    assert len(near_text.passes(near_text.marked(rows.limit(0), "row"), others)) == 100_000


def test_texts_without_candidates_are_not_read_again(spark, monkeypatch):
    """200 unrelated texts and 3 near copies: shingle sets of few more than those leave the workers."""
    rows = [(i, " ".join(f"t{i}-{x}" for x in range(60))) for i in range(200)] + [(200 + i, f"w{i} " + " ".join(f"w{x}" for x in range(100))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent = []
    arrow = type(docs).mapInArrow

    def watched(self, run, schema, *rest):
        out = arrow(self, run, schema, *rest)
        if "shingles" in str(schema):
            sent.append(out)
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    assert near_text.distinct(docs).count() == 201
    assert len(sent) == 1 and 3 <= sent[0].count() < 60
