import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "\n\t ", "a", " a", "a ", " a  b\n", "é 漢字 😀 x", "a<P>b", "<S>", "x <M", "M> y", "a\x85b c", "w" * 300, "ab c " * 200, "a\x0bb\x1cc", " " * 200, "<P" + " " * 60 + "<S>", "a" * 63 + "<M>" + "b c " * 40]


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50
    form = "plain" if plain else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, n, form, None if plain else len(p), None if plain else len(m), out


def test_rows_and_digests_equal_brute_force(spark):
    texts = [*TEXTS, None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts * 8)] + [(None, "a b c", "x", 1), (3, "a", "y", 2), (3, "a", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, uid int").repartition(3)
    want = sorted((brute(i, t) for i, t, _, _ in rows), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    for chunk in (1 << 16, 64, 7):  # all in one chunk, some over several, nearly all over many
        assert sorted((tuple(r) for r in fm.transform(docs, chunk).collect()), key=repr) == want
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        got = sorted((tuple(r) for r in fm.digests(docs, chunk).collect()), key=repr)
        texts_of = sorted(((*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t, _, _ in rows), key=repr)
        assert got == texts_of
    assert fm.digests(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n<PSM>aé"), max_size=60), st.integers(1, 9), st.integers(0, 5))
def test_composed_chunks_equal_a_serial_run(text, size, start):
    """From every start state, and however the text is cut."""
    raw = text.encode()
    state, ends, found = start, 0, False
    for b in raw:
        c = fm.CLASS[b]
        state, ends, found = fm.THEN[state, c], ends + fm.ENDS[state, c], found | fm.FOUND[state, c]
    f = fm.scan(b"")
    for lo in range(0, len(raw), size):
        f = tuple(x[0] for x in fm.compose(tuple(x[None] for x in f), tuple(x[None] for x in fm.scan(raw[lo : lo + size]))))
    assert (f[0][start], f[1][start], f[2][start]) == (state, ends, found)


def test_a_giant_text_is_scanned_by_many_tasks(spark):
    text = ("lorem ipsum é " * 40_000).strip()
    giants = spark.createDataFrame([(1, text)], "uid long, text string")
    functions = fm.chunk_functions(giants, 1 << 12).collect()
    assert len(functions) == -(-len(text.encode()) // (1 << 12)) and all(len(r.then) == fm.STATES for r in functions)
    got = fm.transform(giants.select(giants.uid.alias("doc_id"), "text"), 1 << 12).collect()
    assert [tuple(r) for r in got] == [brute(1, text)]


def test_restore_inverts_join():
    rng = np.random.default_rng(1)
    for form in ("psm", "spm", "plain"):
        for _ in range(50):
            text = bytes(rng.choice(list(b"ab <P> \xc3\xa9"[:3]), 20).tolist())
            a, b = sorted(rng.integers(0, 21, 2).tolist())
            assert fm.restore(fm.join(text, a, b, form), form) == text
