from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import token_rollup as tr

FIELDS = "source string, lang string, tokenizer_version string, n_tokens long, sign int"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_signed_batches_are_idempotent(spark, tmp_path):
    r = tr.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == {}
    one = spark.createDataFrame([("a", "en", "1", 5, 1), ("a", "en", "1", 7, 1), (None, None, "1", 3, None), ("b", "de", "1", None, 1)], FIELDS)
    assert r.commit("x", one) and not r.commit("x", one)
    assert totals(r) == {("a", "en", "1"): (2, 12), (None, None, "1"): (1, 3), ("b", "de", "1"): (1, 0)}
    revised = spark.createDataFrame([("a", "en", "1", 5, -1), ("a", "en", "1", 9, 1), ("b", "de", "1", None, -1)], FIELDS)
    assert r.commit("y", revised) and not r.commit("y", one)
    assert r.commit("z", one.limit(0))
    assert totals(r) == {("a", "en", "1"): (2, 16), (None, None, "1"): (1, 3)}
    assert r.batches() == ["x", "y", "z"]


@settings(max_examples=5, deadline=None)
@given(batches=st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 9), st.sampled_from([1, -1])), max_size=6), max_size=3))
def test_totals_equal_a_recount(spark, tmp_path_factory, batches):
    r = tr.Rollup(spark, f"file://{tmp_path_factory.mktemp('r')}/r")
    want_docs, want = Counter(), Counter()
    for i, b in enumerate(batches):
        df = spark.createDataFrame([(s, "en", "1", n, g) for s, n, g in b], FIELDS)
        for _ in range(2):
            r.commit(str(i), df)
        for s, n, g in b:
            want_docs[s] += g
            want[s] += n * g
    assert totals(r) == {(s, "en", "1"): (want_docs[s], want[s]) for s in want_docs if want_docs[s] or want[s]}


def test_history(spark):
    rows = [(1, "a b", "s", "en", 0), (2, "a b", "s", "en", 0), (3, None, "s", None, 0), (4, "", "t", None, 0), (5, "x.y z" * 2000, "t", "de", 0), (5, "q", "t", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, digest int")
    assert totals(tr.history(docs)) == {("s", "en", "words-1"): (1, 2), ("s", "en", "parts-2"): (1, 2), ("s", None, "words-1"): (1, 0), ("s", None, "parts-2"): (1, 0), ("t", "de", "words-1"): (2, 2002), ("t", "de", "parts-2"): (2, 6002)}
    assert totals(tr.history(docs.limit(0))) == {}


def test_history_equals_sql_with_null_ids(spark):
    import duckdb
    import pandas as pd

    rows = [(None, "a b", "s", "en"), (1, "a b", "t", "en"), (None, "c", "s", None), (None, "c", None, "de"), (2, None, "s", "en"), (3, "", "t", "en"), (3, "", "s", "en"), (4, "q!", "t", "de"), (4, "q!", "t", "de")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "lang"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = {r[:3]: r[3:] for r in duckdb.sql(tr.SQL).fetchall()}
    rollup = tr.history(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3))
    assert totals(rollup) == want
    # The last batch takes back the copies alone.
    last = spark.read.parquet(f"{rollup.path}/{rollup._read('batch-3-delete-copies')['data']}")
    assert last.where("tokenizer_version = 'words-1'").selectExpr("sum(n_docs) as n").head().n == -5  # 1 + 1 + 2 + 1


def test_counts_are_revised_by_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s", "en"), (2, "word word", "s", "en"), (3, "sixsix", "t", "en")], "doc_id long, text string, source string, lang string")
    rollup = tr.history(docs)
    read = lambda batch: {(r.source, r.n_docs, r.n_tokens) for r in spark.read.parquet(f"{rollup.path}/{rollup._read(batch)['data']}").collect()}
    assert read("batch-1-insert") == {("s", 2, 2), ("t", 1, 1)}  # 11 // 6 + 9 // 6, 6 // 6
    assert read("batch-1-revise") == {("s", 0, 6)}  # -1 - 1 + 6 + 2; what was estimated right isn't touched
    assert totals(rollup)["s", "en", "words-1"] == (2, 8)


def test_vacuum_deletes_what_nothing_names(spark, tmp_path):
    r = tr.Rollup(spark, f"file://{tmp_path}/r")
    assert r.vacuum(0) == 0
    for i in range(3):
        r.commit(str(i), spark.createDataFrame([("a", "en", "1", i, 1)], FIELDS))
    spark.createDataFrame([("a", "en", "1", 1, 9)], tr.SCHEMA).write.parquet(f"{r.path}/data/orphan")
    r.compact()
    before = totals(r)
    assert r.vacuum() == 0 and r.vacuum(0) == 4 and totals(r) == before == {("a", "en", "1"): (3, 3)}
    assert not r.commit("1", spark.createDataFrame([], FIELDS)) and r.commit("3", spark.createDataFrame([("a", "en", "1", 7, 1)], FIELDS)) and totals(r) == {("a", "en", "1"): (4, 10)}


def test_compaction_keeps_totals_and_commits(spark, tmp_path):
    r = tr.Rollup(spark, f"file://{tmp_path}/r")
    rows = [spark.createDataFrame([("a", "en", "1", i, 1)], FIELDS) for i in range(4)]
    assert not r.compact()
    for i in range(3):
        assert r.commit(f"b/{i}", rows[i])
    before = totals(r)
    assert r.compact() and totals(r) == before and not r.compact()
    assert not r.commit("b/1", rows[3]) and r.commit("b/3", rows[3])
    assert totals(r) == {("a", "en", "1"): (4, 6)} and r.compact() and totals(r) == {("a", "en", "1"): (4, 6)}
    assert r.batches() == [f"b/{i}" for i in range(4)] and len(r._tables()[0]) == 1


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    a, b = (tr.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    one, two = (spark.createDataFrame([("a", "en", "1", n, 1)], FIELDS) for n in (5, 7))
    monkeypatch.setattr(b, "committed", lambda batch_id: False)  # it looked before the first had finished
    assert a.commit("x", one) and not b.commit("x", two)
    assert totals(a) == totals(b) == {("a", "en", "1"): (1, 5)}
    assert len(list((tmp_path / "r" / "data").iterdir())) == 1


def test_public_tokenizers_as_versions(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    versions = {"pieces": public_tokenizers.path("piece_bpe_32k.model"), "bytes": public_tokenizers.path("byte_bpe_50k.json")}
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = d.select("doc_id", "text", "source", "lang").unionByName(spark.createDataFrame([(None, None, "s", None), (None, "a  b<|endoftext|>", "s", None)], "doc_id long, text string, source string, lang string"))
    pieces, own = sentencepiece.SentencePieceProcessor(model_file=versions["pieces"]), Tokenizer.from_file(versions["bytes"])
    own.encode_special_tokens = True
    want: Counter = Counter()
    n: Counter = Counter()
    seen = set()
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id)):
        t = r.text or ""
        if t not in seen:
            seen.add(t)
            for v, c in (("pieces", len(pieces.encode(t))), ("bytes", len(own.encode(t, add_special_tokens=False).ids))):
                want[r.source, r.lang, v] += c
                n[r.source, r.lang, v] += 1
    assert totals(tr.history(docs, versions=versions)) == {k: (n[k], want[k]) for k in n}
