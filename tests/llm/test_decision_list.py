import re

import numpy as np
from pyspark.sql import functions as F

from scriptmill.llm import decision_list as dl

TEXTS = [None, "", " \t\n", "a b c a b c", "a b c d", "x " * 400, "L one\nL one\n\n \nL one", "é#ü$ 漢<字> &|%", "A\x0bB\x0cC\rD\x1cE", "w1 w2 w3 " * 30 + "tail end", "z" * 5000, "a b\nc a b\nc"]


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at: dict = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for own in at.values() if len(own) > 1 for i in own for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, n_words int")
    got = {r.doc_id: r for r in dl.statistics(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dl.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def rows(n=900):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeftionr"), rng.integers(2, 9)))
    out = []
    for i in range(n):
        w = [word() for _ in range(80)]
        bad = i % 4 == 0
        out.append((i, " ".join(x + "###" if bad and i % 8 == 0 else x.upper() + "!!" if bad else x for x in w), int(not bad)))
    return out


def test_learned_rules(spark):
    own = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in own if i < 700] + [(0, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rules = dl.learn(docs, labels)
    assert rules and all(1 <= len(r) <= dl.MAX_CONDITIONS for r in rules)
    kept = {r.doc_id: r.kept for r in dl.judge(docs, labels).collect()}
    assert np.mean([kept[i] == bool(q) for i, _, q in own]) > 0.9
    assert sum(not kept[i] for i, _, q in own if q) <= 10
    # The CASE expression says what the rules say.
    stats = dl.statistics(docs).select(dl.verdict(rules).alias("kept"), *[F.expr(e).cast("double").alias(f) for f, e in dl.FEATURES.items()]).collect()
    x = {f: np.array([r[f] for r in stats]) for f in dl.FEATURES}
    assert [r.kept for r in stats] == (~np.logical_or.reduce([dl.covers(r, x) for r in rules])).tolist()


def test_edges(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert dl.learn(docs, none) == []
    out = dl.judge(docs, none).collect()
    assert len(out) == len(TEXTS) + 1 and all(r.kept == (not r.base_failed) for r in out)
    assert dl.judge(docs.limit(0), none).count() == 0
    # A filter on a count doesn't drag the arrays into itself.
    plan = dl.statistics(docs).where("n_repeat_words > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1
    clashing = docs.selectExpr("doc_id", "text", "1 as __row", "2 as words", "3 as hashes", "4 as few", "5 as n_words", "6 as windows", "7 as quality", "8 as _h")
    kept = dl.keep(clashing, none)
    assert kept.schema == clashing.schema and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
