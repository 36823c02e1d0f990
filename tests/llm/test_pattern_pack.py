import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptmill.llm import pattern_pack as pp

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a\x1cb", "é ̈x", "x y z", "it's 'S 12 ab--c", "<|endoftext|> <|x", "İSTANBUL ΣΑΣ", "😀 漢字\n\n\tz", "a" * 5000, "▁ b", "A  B", "l'été d's 'tis x'll've ÿ×÷ß ÀÉ 3rd---x2", "a''s ''re'", "µª º"]


def test_ids_equal_the_library():
    t = Tokenizer.from_file(PATH)
    got = pp.encode_texts([x.encode() for x in ODD], PATH)
    for x, ids in zip(ODD, got):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n'steéÉ×ß1<|-.À\u0301"), max_size=24))
def test_ids_equal_the_library_on_any_text(x):
    want = LIBRARY
    assert np.frombuffer(pp.encode_texts([x.encode()], PATH)[0], "<u4").tolist() == want.encode(x, add_special_tokens=False).ids


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(1)
    for lengths in ([2048] * 3, [1] * 5000, rng.integers(1, 2049, 5000), [1500] * 40 + [3] * 7):
        h = np.bincount(lengths, minlength=2049)
        groups = pp.plan(h)
        used = np.zeros_like(h)
        for own, n in groups:
            assert sum(own) <= 2048 and n > 0
            for v in own:
                used[v] += n
        assert (used == h).all()
    assert sum(n for _, n in pp.plan(np.bincount(rng.integers(1, 900, 20000), minlength=2049))) <= 1.01 * 20000 * 450 / 2048
    assert pp.plan(np.zeros(2049, int)) == []


def test_pack(spark):
    t = Tokenizer.from_file(PATH)
    texts = [*ODD, None, "same text", "same text", "word " * 7000]
    rows = [(i, x, "clash", 5) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, piece int").repartition(3)
    out = pp.pack(docs, PATH).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert own == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert pp.pack(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_get_whole_texts():
    assert pp.Encoder(PATH).by_words
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, library = pp.Encoder(path), Tokenizer.from_file(path)
    assert not other.by_words
    for x, ids in zip(ODD, other.encode([x.encode() for x in ODD])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, x


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, "c " * 5000), (1, "c " * 5000)]
    out = pp.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.length) for r in out), key=repr) == sorted([(None, 0, 3), (None, 0, 3), (1, 0, 1), *[(1, k, n) for k, n in enumerate((2048, 2048, 905))] * 2], key=repr)
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert len({p[:2] for p in places}) == len(out) and all(o + n <= 2048 for _, o, n in places)
