import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptmill.llm import personal_data as pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    count = lambda s: len(re.sub("[^0-9]", "", s))
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= count(m[0]) <= 19 and checksum(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= count(m[0]) <= 15]
    return sorted(out)


TEXTS = ["", "a", "x y.b-9@ho-st.c.d, a@b", "a@b.c%d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.1.2.3 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 555-0100 +12345", "1.2.3.4111111111111111", "é@b.cd é1.2.3.4😀 +1.2.3.4.5.6.7.8.9.0", "@" * 50, "a" * 5000 + "@b", "." .join(["7"] * 4000), "+" * 99 + "1" * 12, "1" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a1.5@-+ (%é0"), max_size=40))
def test_patterns_on_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_derivatives():
    m = {k: v.astype(np.float64) for k, v in pii.new_model(3).items()}
    m["moves"] = np.random.default_rng(1).normal(0, 0.3, m["moves"].shape)
    rng = np.random.default_rng(2)
    signs, tags = rng.integers(0, pii.N_SIGNS, (7, 3)).astype(np.uint8), rng.integers(0, pii.TAGS, (7, 3))
    value, d = pii.loss(m, signs, tags)
    for k in m:
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in m[k].shape)
            if k == "embed":
                at = (at[0], int(signs[rng.integers(7), 0]))
            kept = m[k][at]
            m[k][at] = kept + 1e-3
            up = pii.loss(m, signs, tags)[0]
            m[k][at] = kept - 1e-3
            down = pii.loss(m, signs, tags)[0]
            m[k][at] = kept
            n = 3 if k in ("ahead", "back", "embed") else 1  # the batch's mean is taken in d_e, which all derivatives use
            assert abs((up - down) / 2e-3 - d[k][at]) < 2e-3 * max(1, n), k


def test_decoding_and_its_bound():
    rng = np.random.default_rng(4)
    moves = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    e = rng.normal(0, 1, (4, pii.TAGS, 6)).astype(np.float32)
    lengths = np.array([4, 4, 4, 3, 2, 1])
    tags = pii.viterbi(e, moves, lengths)
    for j, n in enumerate(lengths):
        score = lambda p: sum(e[t, p[t], j] for t in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(pii.TAGS), repeat=int(n)), key=score)
        assert abs(score(best) - score(tags[:n, j])) < 1e-4 and not tags[n:, j].any()
    proved = 0
    for scale in (0.5, 1, 2):
        for _ in range(30):
            moves = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
            moves[0, 0] += 3
            e = rng.normal(0, scale, (9, pii.TAGS, 40)).astype(np.float32)
            e[:, 0] += 3 + 4 * rng.random()
            size = np.sort(rng.integers(1, 10, 40))[::-1]
            some = pii.may_have_spans(e, moves, size)
            assert not pii.viterbi(e, moves, size)[:, ~some].any()
            proved += (~some).sum()
    assert proved > 500


def test_windows_are_reconciled():
    r = pii.reconcile
    assert r([(10, 0, 20, 5.0, False, False), (10, 0, 20, 5.1, False, False)]) == [(10, 0, 20)]
    assert r([(10, 0, 30, 5.0, False, True), (20, 0, 40, 4.0, True, False)]) == [(10, 0, 40)]  # a border cut it twice
    assert r([(10, 0, 20, 5.0, False, False), (15, 3, 30, 6.0, False, False), (30, 1, 40, 1.0, False, False)]) == [(15, 3, 30), (30, 1, 40)]
    assert r([(0, 0, 5, 3.0, False, False), (3, 1, 9, 5.0, False, False), (8, 2, 12, 3.0, False, False)]) == [(0, 0, 5), (8, 2, 12)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstué"), rng.integers(2, 9)))
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        c = "4" + d(14)
        return c + next(x for x in "0123456789" if checksum(c + x))

    data = [lambda: f"{word()}.{d(2)}@mail{d(1)}.example.com".replace("é", "e"), lambda: ".".join(str(int(x)) for x in rng.integers(1, 255, 4)), card, lambda: f"+1 ({d(3)}) 555-{d(4)}"]
    texts = []
    for i in range(700):
        words = [word() for _ in range(int(rng.integers(5, 90)))]
        if i % 4:
            words.insert(int(rng.integers(0, len(words))), data[i % 16 // 4]())
        texts.append(" ".join(words))
    return texts


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame([(t,) for t in corpus[:500]], "text string").repartition(3)
    own = pii.lessons(docs, 60)
    assert own == pii.lessons(docs.repartition(7), 60)  # the sample doesn't depend on partitions
    assert len(own) <= 60 * 5
    return pii.train(own, 220)


def test_the_model_finds_what_is_spelled_otherwise(corpus, model):
    """On held-out texts: most of what is respelled, next to nothing in clean ones."""
    rng = np.random.default_rng(7)
    texts, want, clean = [], [], []
    for t in corpus[500:]:
        spans = pii.base_spans(t)
        if not spans:
            clean.append(t)
        elif len(spans) == 1:
            (a, k, b) = spans[0]
            new = t[:a] + (s := pii.respell(rng, k, t[a:b])) + t[b:]
            if not pii.base_spans(new):
                texts.append(new)
                want.append((a, k, a + len(s)))
    found = pii.added_spans(model, texts, [[] for _ in texts])
    hits = sum(any(f[1] == k and f[0] < b and f[2] > a for f in own) for own, (a, k, b) in zip(found, want))
    assert hits >= 0.6 * len(want)
    assert sum(map(len, pii.added_spans(model, clean, [[] for _ in clean]))) <= 0.02 * len(clean)


def test_long_texts_are_read_whole_and_alone(corpus, model):
    """A text's spans don't depend on the texts that are read with it, and those far from each other don't either."""
    filler = " ".join(t for t in corpus if not pii.base_spans(t))[:40_000]
    secret = " mail ann.42 (at) mail3 (dot) example (dot) com now "
    long = filler[:399] + secret + filler[399:20_000] + secret + filler[20_000:]
    texts = [long, secret, "", *corpus[:50]]
    together = pii.model_spans(model, texts)
    assert [pii.model_spans(model, [t])[0] for t in texts] == together
    assert {s[0] // 10_000 for s in together[0]} >= {0, 2} or not together[1]


def test_query(spark, corpus):
    rows = [(i, t, "x", 1) for i, t in enumerate([*corpus[:120], *TEXTS, None])] + [(None, corpus[1], "x", 1), (5, corpus[1], "x", 1), (5, corpus[1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int").repartition(3)
    got = pii.digest(docs, 40, 30).collect()
    listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert len(got) == len(rows)
    want = sorted(((i, *(sum(s[1] == k for s in brute(t or "")) for k in range(4)), hashlib.sha256(listed(brute(t or "")).encode()).hexdigest()) for i, t, _, _ in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    known = {i: brute(t or "") for i, t, _, _ in rows if i != 5}
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        own = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in spans]
        assert own == sorted(own) and len(own) == sum(r[1:5]) + r.n_added
        assert r.doc_id in (5, None) or set(known[r.doc_id]) <= set(own)
    assert pii.digest(docs.limit(0), 5, 2).count() == 0
    none = pii.digest(docs.where("text = 'a'"), 5, 2).collect()
    assert len(none) == 1 and none[0].n_added == 0 and none[0].spans == ""


def test_find_and_redact(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4!"), (2, None), (3, "+1.2.3.4.5.6.7.8.9.0")], "doc_id long, text string")
    assert [(r.doc_id, r.kind, r.start, r.end, r.added, r.span) for r in pii.find(docs, None).orderBy("doc_id", "start", "kind").collect()] == [(1, "email", 2, 8, False, "a@b.cd"), (1, "ip", 10, 17, False, "1.2.3.4"), (3, "phone", 0, 20, False, "+1.2.3.4.5.6.7.8.9.0"), (3, "ip", 1, 8, False, "1.2.3.4"), (3, "ip", 9, 16, False, "5.6.7.8")]
    assert {r.doc_id: r.text for r in pii.redact(docs, None).collect()} == {1: "é [EMAIL], [IP]!", 2: "", 3: "[PHONE]"}
