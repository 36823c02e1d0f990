import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from scriptmill.llm import threshold_search as ts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "İx", "Ab", "ab", "漢字"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties beyond the kth place
    docs += [(500, None), (501, ""), (502, " -- "), (None, docs[7][1]), (7, docs[7][1]), (503, "w1-w2_w3`w4 w5 " * 9000), (504, "same " * 50)]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(25)] + [(90, None), (91, "?"), (92, "unknown terms"), (93, docs[7][1]), (94, "same same"), (None, "w3 w4"), (3, "w5"), (3, "w6 w5")]
    return docs, items, spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, score int, rank string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(corpus, monkeypatch):
    docs, items, d, i = corpus
    want = brute(docs, items)
    assert rows(ts.rank(d, i)) == want
    assert rows(ts.rank(d, i, terms_at_once=40)) == want  # several groups of items
    assert rows(ts.rank(d, i, top=3)) == brute(docs, items, 3)
    monkeypatch.setattr(ts, "BLOCK_DOCS", 1)  # every batch is a block
    assert rows(ts.rank(d, i)) == want


def test_equals_sql(corpus):
    docs, items, d, i = corpus
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(f"select item_id, rank, doc_id, score from ({ts.sql()})").fetchall(), key=repr) == rows(ts.rank(d, i))


def test_empty_tables(corpus):
    _, _, d, i = corpus
    assert ts.rank(d.limit(0), i).count() == ts.rank(d, i.limit(0)).count() == ts.rank(d.where("text is null"), i).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 22])
def test_long_texts_are_cut_between_terms(monkeypatch, piece):
    monkeypatch.setattr(ts, "PIECE", piece)
    for text in ("", "  ", "ab", "ab cd", " Ab,ab é-é\x85x  long0123456789 b ", "a" * 50 + " b"):
        assert ts.counted(text.encode()) == (len(terms(text)), Counter(t.encode() for t in terms(text)))


def test_stops_before_the_lists_end():
    """Many documents hold both terms seldom, few often: the few are found near the tops."""
    rng = np.random.default_rng(1)
    n = 20_000
    impacts = np.concatenate([rng.integers(100_000, 110_000, 2 * (n - 20)), rng.integers(800_000, 900_000, 40)])
    block = ts.Block(np.arange(n), np.zeros(n, np.int64), np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), impacts, 2)
    best, weights = ts.Best(10), np.array([3000, 2000])
    block.search(np.array([0, 1]), weights, best)
    whole = block.scores(np.arange(n), weights)
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert best.rows[2].tolist() == order.tolist() and best.rows[0].tolist() == whole[order].tolist()
    assert block.read < n / 50
    again = block.read
    block.search(np.array([0, 1]), weights, best)  # a block that can't better what is held costs a step at most
    assert block.read - again <= 2 * 3 * ts.FIRST_STEP * 8


def test_equal_scores_at_the_kth_place_are_all_read():
    """The threshold has to fall strictly below the kth score: a smaller id may come later in the list."""
    n = 500
    block = ts.Block(np.arange(n)[::-1].copy(), np.zeros(n, np.int64), np.arange(n + 1), np.zeros(n, np.int64), np.full(n, 7), 1)
    best = ts.Best(10)
    block.search(np.array([0]), np.array([5]), best)
    assert best.rows[2].tolist() == list(range(10))
