import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp  # noqa: E402
from test_decision_list import brute as brute_statistics  # noqa: E402
from test_near_text import brute as brute_near  # noqa: E402
from test_suffix_dedup import brute as brute_removed  # noqa: E402

from scriptmill.llm import decision_list as dl
from scriptmill.llm import pairwise_quality as pq

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "passage_dedup", "packing"]
    # quality rules
    rules = dl.learn(docs, labels)
    x = {r.doc_id: r for r in dl.statistics(docs).selectExpr("*", *[f"cast({e} as double) as {f}" for f, e in dl.FEATURES.items()]).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for d, r in rows.items():
        n, _, _, _, repeat = brute_statistics(r.text)
        own = {f: np.array([x[d][f]]) for f in dl.FEATURES}
        if n >= 50 and 100 * repeat <= 50 * n and not any(dl.covers(rule, own)[0] for rule in rules):
            kept[d] = r
    one = cp.materialize(cp.quality_rules(spark, docs, SF))
    assert one.schema == docs.schema and {r.doc_id: r for r in one.collect()} == kept
    # classifier
    ranking = pq.learn(docs, labels)
    kept = {d: r for d, r in kept.items() if ranking.scores(pq.features(np.frombuffer((r.text or "").encode(), np.uint8))[None])[0] >= 0.3}
    two = cp.materialize(cp.quality_classifier(spark, one, SF))
    assert two.schema == docs.schema and {r.doc_id: r for r in two.collect()} == kept
    # near-dedup
    first = brute_near([(d, kept[d].text) for d in sorted(kept)])  # five words, similarity 0.8
    kept = {d: r for d, r in kept.items() if first[d] == d}
    three = cp.materialize(cp.near_dedup(spark, two, SF))
    assert three.schema == docs.schema and {r.doc_id: r for r in three.collect()} == kept
    # passage dedup
    ids = sorted(kept)
    masks = brute_removed([(d, kept[d].text) for d in ids])
    texts = {d: np.frombuffer(kept[d].text.encode(), np.uint8)[~m].tobytes().decode("utf-8", "ignore") for d, m in zip(ids, masks)}
    four = cp.materialize(cp.passage_dedup(spark, three, SF))
    assert four.schema == docs.schema and {r.doc_id: (r.text, r.n_chars, r.source) for r in four.collect()} == {d: (t, len(t), kept[d].source) for d, t in texts.items()}
    # packing, and the whole run
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text in texts.items():
        own = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, s, len(own[s : s + 2048]), zlib.crc32(own[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(own), 2048))]
    out = cp.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    ends: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "c d"), (1, "c d"), (2, None), (None, "e f"), (None, "e f"), (3, "g h"), (3, "g h")]
    docs = spark.createDataFrame([(i, t, None, "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_dedup(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("1", "a b"), ("1", "c d"), ("2", None), ("3", "g h"), ("None", "e f")]


CLASHING = ["__id", "__q", "__row", "__again", "__covered", "id", "again", "row", "p", "same", "none", "fp", "node", "component", "component_id", "words", "hashes", "n_words", "few", "quality", "score", "first", "least", "covered", "piece", "length", "task", "rank"]


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_stages_take_any_rows_and_columns(spark, name, stage):
    """Clashing columns, null ids and texts, empty and long texts, repeats, and no rows."""
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60).drop("n_chars")
    odd = spark.createDataFrame([(None, "word " * 90, "en", "s"), (None, None, None, None), (7, "", "en", "s"), (7, "", "en", "s"), (9000, "long " * 60_000, "en", "s"), (9001, "x" * 300_000, "en", "s")], own.schema)
    docs = own.unionByName(odd).selectExpr("*", "length(text) as n_chars", *[f"{i} as {c}" for i, c in enumerate(CLASHING)])
    out = cp.materialize(stage(spark, docs, SF))
    if name != "packing":
        assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING))
    assert out.count() > 0
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == out.columns
