import hashlib

import numpy as np
import pytest

from scriptmill.llm import suffix_dedup as sd


def brute(rows, length=100):
    """rows: (id, text) in the corpus' order -> list of removed masks."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mask[i : i + length] = True
            seen.add(w)
        out.append(mask)
    return out


def expected(rows):
    out = []
    for (d, t), mask in zip(rows, brute(rows)):
        b = np.frombuffer((t or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((d, len(b), int(mask.sum()), spans, hashlib.sha256(b[~mask].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary, n))


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefé"), rng.integers(1, 7))) for _ in range(60)]
    passages = [words(rng, int(rng.integers(8, 60)), vocabulary) for _ in range(6)] + ["x" * 150, "ab" * 90, "licence " * 5]
    texts = []
    for _ in range(n):
        parts = [words(rng, int(rng.integers(0, 40)), vocabulary)]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            cut = rng.integers(0, 30)
            parts += [p[cut : len(p) - rng.integers(0, 30)], words(rng, int(rng.integers(0, 30)), vocabulary)]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[5], texts[5] + "!", "", None, "short", "z" * 1000, "z" * 99, "z" * 100, "é" * 200, texts[7][1:]]
    return [(int(i), t) for i, t in zip(rng.permutation(1000)[: len(texts)], texts)]


def run(spark, rows, parts=5):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, covered string, id int, p int").repartition(parts)
    return sorted((tuple(r) for r in sd.digests(docs).collect()), key=repr)


@pytest.mark.parametrize(("seed", "bucket", "chunk", "segment"), [(1, 32 << 20, 8 << 20, 1 << 19), (2, 2000, 3000, 700), (3, 500, 400, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, bucket, chunk, segment):
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(sd, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(sd, "SEGMENT", segment)
    rows = sorted(corpus(seed))
    assert run(spark, rows) == expected(rows)


def test_anchors_across_segments(monkeypatch):
    rng = np.random.default_rng(0)
    body = rng.integers(97, 101, 5000).astype(np.uint8)
    at = np.array([0, 50, 50, 3000, 3101, 5000])
    whole = sd.anchors(body, at)
    monkeypatch.setattr(sd, "SEGMENT", 256)
    for a, b in zip(whole, sd.anchors(body, at)):
        assert (a == b).all()


def test_hot_leads_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET_BYTES", 3000)
    rng = np.random.default_rng(4)
    line = "a very common line that is shorter than a hundred bytes but holds a K-gram. "
    rows = [(i, line + "".join(rng.choice(list("abcdefgh"), 30)) + line * (i % 3) + ("A longer end that some of them have. " + line) * (i % 5 == 0)) for i in range(150)]
    assert run(spark, rows) == expected(rows)
    # Executors have the function by name; here it is asked directly whether leads are that frequent.
    splitters = np.sort(sd._leads(np.repeat(sd.tokens(np.frombuffer(line.encode(), np.uint8), np.arange(3), 2), 4, axis=1)))
    t = sd.tokens(np.frombuffer(line.encode(), np.uint8), np.arange(3), 2)
    assert sd.is_hot(t, splitters).all() and len(set(sd.bucket_of(np.repeat(t, 50, axis=1), sd.mix(np.arange(150, dtype=np.uint64)), splitters).tolist())) > 6


def test_classes_of_offsets_find_what_all_offsets_find():
    rng = np.random.default_rng(8)
    pool = rng.integers(97, 100, (6, sd.REACH + sd.LENGTH)).astype(np.uint8)
    context = pool[rng.integers(0, 6, 200)].copy()
    cut = rng.integers(0, 40, 200)
    for i, c in enumerate(cut):
        context[i, :c] = rng.integers(97, 123, c)
        context[i, sd.REACH + sd.LENGTH - c // 2 :] = rng.integers(97, 123, len(context[i]) - (sd.REACH + sd.LENGTH - c // 2))
    full = np.full(200, sd.LENGTH), np.full(200, sd.REACH)
    group = np.zeros(200, int)
    least, most = sd.repeated_windows(context, full[1], full[0], group, np.full(200, sd.ALL))
    found = [(np.full(200, 999), np.full(200, -1))]
    for first in range(0, sd.REACH + 1, sd.CLASS_OFFSETS):
        shared = sd._hash_columns(context, sd.REACH - first, sd.REACH + sd.LENGTH - min(first + sd.CLASS_OFFSETS - 1, sd.REACH))
        own = np.unique(shared, return_inverse=True)[1]
        a, b = sd.repeated_windows(context, full[1], full[0], own, np.full(200, first))
        found.append((np.where(b < 0, 999, a), b))
    assert (np.min([f[0] for f in found], axis=0) == np.where(most < 0, 999, least)).all()
    assert (np.max([f[1] for f in found], axis=0) == most).all()


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, k, 500) for k in (3, 2, 5, 4)]
    order = sd.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*[k.tolist() for k in keys]))
    assert len(sd.multikey_order([np.zeros(0, int)] * 2)) == 0


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(9)
    a, b = ("".join(rng.choice(list("abcdefgh"), 300)) for _ in range(2))
    rows = [(None, a), (1, a[:150]), (1, b), (1, b), (2, b[50:] + "q"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in sd.digests(docs).collect()), key=repr)
    assert got == expected(rows)


def test_removed_texts(spark):
    rows = sorted(corpus(6, 20))
    docs = spark.createDataFrame([(d, "en", t, 1.5) for d, t in rows], "doc_id long, lang string, text string, n double")
    out = sd.removed(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r.text for r in out.collect()}
    for (d, t), mask in zip(rows, brute(rows)):
        want = None if t is None else np.frombuffer(t.encode(), np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
        assert got[d] == want
    assert sd.digests(docs.limit(0)).count() == 0


def test_more_buckets_than_sampled_leads(spark, monkeypatch):
    """Buckets are dealt out again and again; a task's blobs and splitters are at most FAN at a time."""
    rows = sorted(corpus(11, 120))
    want = expected(rows)
    for name, value in (("FAN", 4), ("BUCKET_BYTES", 320), ("SAMPLE_DOCS", 3), ("CHUNK_BYTES", 4000)):
        monkeypatch.setattr(sd, name, value)
    assert run(spark, rows) == want
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = docs.selectExpr("coalesce(doc_id, -1) as id", "0L as again", "text")
    n_bytes = sum(len((t or "").encode()) for _, t in rows)
    blobs = sd.dealt(texts, n_bytes).where("p >= 0")
    sizes = [r.n for r in blobs.groupBy("p").sum("n").toDF("p", "n").collect()]
    assert len(sizes) > 30 > 3 * 3  # far more than the first step's FAN, and than the documents sampled
    assert max(sizes) < 0.2 * sum(sizes)
    assert blobs.selectExpr("max(p) as m").head().m >= 4**3


def test_more_tasks_than_the_fan_deal_again(spark, monkeypatch):
    """Blobs of one bucket go to several tasks, as many as the corpus asks for, and the buckets come out the same."""
    assert sd.dealers(100 << 40, sd.FAN) * sd.FAN > 90_000 and sd.dealers(100 << 30, sd.FAN) == 1
    texts = [f"{i} " + " ".join(f"word{(i * j) % 97}" for j in range(60)) for i in range(120)]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((tuple(r) for r in sd.digests(docs).collect()), key=repr)
    tasks = []
    for name, value in (("FAN", 4), ("BUCKET_BYTES", 2000), ("SAMPLE_DOCS", 20), ("CHUNK_BYTES", 4000), ("DEAL_BYTES", 1500)):
        monkeypatch.setattr(sd, name, value)
    spread = sd.dealers
    monkeypatch.setattr(sd, "dealers", lambda n, buckets: tasks.append(spread(n, buckets) * buckets) or spread(n, buckets))
    assert sorted((tuple(r) for r in sd.digests(docs).collect()), key=repr) == want
    assert tasks and tasks[0] > 4 * sd.FAN


def test_blobs_of_a_chunk_are_bounded():
    rng = np.random.default_rng(2)
    body = rng.integers(97, 123, 200_000).astype(np.uint8)
    at = np.arange(0, 200_001, 1000)
    place, _, _ = sd.anchors(body, at)
    splitters = np.sort(sd._leads(sd.tokens(body, place, 2)))[:: len(place) // 100]
    ids = np.arange(200)
    batch = sd._send(ids, ids * 0, body, at, splitters)
    assert batch.num_rows <= len(splitters) + 2 and sum(batch.column(1).to_pylist()) == len(place)
    own = [sd._unpack(b, sd._KINDS) for p, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if p >= 0]
    again = sd._deal(sd._joined([b for p, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if p >= 0]), splitters[::10], 70)
    assert set(again.column(0).to_pylist()) <= {-1, *range(70, 70 + 12)} and sum(again.column(1).to_pylist()) == sum(len(c[0]) for c in own)


def test_frequent_ids_are_numbered_without_a_window(spark):
    rows = [(None, f"t{i % 7}" * 60) for i in range(60)] + [(5, "x" * 120)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = sd._numbered(docs)
    got = own.collect()
    assert len({(r.id, r.again) for r in got}) == len(rows)
    texts = [r.row.text for r in sorted(got, key=lambda r: (r.id, r.again)) if r.id == sd.LEAST_ID]
    assert len({t for t, u in zip(texts, texts[1:]) if t == u}) == 7 and sum(t != u for t, u in zip(texts, texts[1:])) == 6
    assert "Window" not in docs.transform(sd.digests)._jdf.queryExecution().optimizedPlan().toString()


def test_columns_of_any_name(spark):
    names = ["__id", "__again", "__covered", "id", "again", "row", "p", "covered", "lo", "hi", "h", "salt", "blob"]
    rows = sorted(corpus(6, 20))
    docs = spark.createDataFrame([(d, t, *range(len(names))) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = sd.removed(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: tuple(r) for r in out.collect()}
    for (d, t), mask in zip(rows, brute(rows)):
        text = None if t is None else np.frombuffer(t.encode(), np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
        assert got[d] == (d, text, *range(len(names)))
    assert sd.digests(docs).count() == len(rows)
    assert sd.removed(docs.limit(0)).count() == 0
