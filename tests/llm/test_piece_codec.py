import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import piece_codec as pc

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "\n", " \n ", "a\nb  c\n", "▁x▁▁y ▁", "é 😀 漢字 \t z", "<s> </s> <0x0A>", "w" * 3000, "\x00 a", "ﬁ ½ Å", "a b", "x " * 3000]
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts):
    for t, (ids, decoded) in zip(texts, pc.codec(PATH).encode([t.encode() for t in texts])):
        want = SP.encode(t)
        assert list(map(int, ids.split())) == want, repr(t)
        assert decoded.decode() == SP.decode(want), repr(t)


def test_equals_the_library():
    assert pc.codec(PATH).table_is_exact()
    check(ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t▁aébthe.😀́"), max_size=30))
def test_equals_the_library_on_any_text(t):
    check([t])


def test_table_overflow(monkeypatch):
    monkeypatch.setattr(pc, "TABLE_ENTRIES", 3)
    check(ODD)
    check(["a b c d e f", "g h a b"])


def test_query_columns(spark):
    rows = [(i, t, "c") for i, t in enumerate([*ODD, None, "a  b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in pc.digests(docs, PATH).collect()}
    for i, t, _ in rows:
        ids = [*SP.encode(t or ""), 2]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in pc.encode(docs, PATH).collect()}
    assert all(full[i].ids == [*SP.encode(t or ""), 2] for i, t, _ in rows)
    assert pc.digests(docs.limit(0), PATH).count() == 0


def test_models_that_fail_the_check_get_whole_texts(monkeypatch):
    c = pc.Codec(PATH)
    assert c.exact
    monkeypatch.setattr(pc.Codec, "chunks", staticmethod(lambda text: text.split(b"b")))  # as if it marked something else
    other = pc.Codec(PATH)
    assert not other.exact
    assert other.encode([t.encode() for t in ODD]) == [(" ".join(map(str, SP.encode(t))).encode(), SP.decode(SP.encode(t)).encode()) for t in ODD]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (3, "x"), (3, "x"), (3, "y")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens) for r in pc.digests(docs, PATH).collect()), key=repr)
    assert got == sorted([(d, len(SP.encode(t or "")) + 1) for d, t in ((None, "a b"), (None, None), (3, "x"), (3, "x"), (3, "y"))], key=repr)
