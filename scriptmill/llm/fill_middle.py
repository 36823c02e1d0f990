"""Fill-in-the-middle rows by a parallel scan of an automaton.

A text is cut into tokens (blanks and the word after them; blanks at the end are a token of their own), and two of the
tokens' ends become the cuts. The automaton reads bytes: it knows whether it is in a word and how much of a sentinel it
has seen, and says when a word ends and when a sentinel is complete. A chunk of a text emits, for every state in which
it could be entered, the state it is left in, the words that end in it and whether a sentinel does; such functions
compose associatively, so chunks of a giant text are scanned wherever Spark puts them, their composition gives each
chunk's entry state and the words before it, and a cut is looked for in the one chunk that holds it. A text of one
chunk enters in the first state, which is the same scan with one function.

Edge cases: a null text is empty; an empty text has n = 0, is plain and stays empty; a text of blanks alone is one
token; texts that hold a sentinel are plain, so that every output can be taken apart again; a null doc_id counts as
empty text in the hash and rows of null or repeated ids are rows of their own; very long texts are cut into chunks and
never shortened; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import SPACES, hold, materialize, short_batches, utf8_texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk; texts of more than one chunk are scanned apart.
CHUNK = 1 << 16
#: Shares, of 100: rows that are transformed, and those of them whose suffix comes first.
FIM_SHARE, SPM_SHARE = 50, 80
SEED = 42

# Classes of bytes: other, blank, and the characters of sentinels. States: 3 * (in a word) + sentinel characters seen.
OTHER, BLANK, OPEN, LETTER, CLOSE = range(5)
STATES = 6
CLASS = np.zeros(256, np.uint8)
CLASS[list(SPACES.encode())] = BLANK
CLASS[ord("<")], CLASS[ord(">")] = OPEN, CLOSE
CLASS[list(b"PSM")] = LETTER


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, words that end, sentinels that end) by state and class."""
    then, ends, found = np.zeros((STATES, 5), np.uint8), np.zeros((STATES, 5), np.int64), np.zeros((STATES, 5), bool)
    for state in range(STATES):
        word, seen = divmod(state, 3)
        for c in range(5):
            now = 1 if c == OPEN else 2 if c == LETTER and seen == 1 else 0
            then[state, c] = 3 * (c != BLANK) + now
            ends[state, c] = word and c == BLANK
            found[state, c] = seen == 2 and c == CLOSE
    return then, ends, found


THEN, ENDS, FOUND = _automaton()


def compose(first: tuple, second: tuple) -> tuple:
    """The function of two neighbours, for arrays of functions (rows) by start state (columns)."""
    state = first[0].astype(np.intp)
    at = lambda x: np.take_along_axis(x, state, 1)
    return at(second[0]), first[1] + at(second[1]), first[2] | at(second[2])


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's function: bytes are functions, and neighbours are composed pairwise until one is left."""
    classes = CLASS[np.frombuffer(text, np.uint8)]
    f = (THEN.T[classes], ENDS.T[classes], FOUND.T[classes])
    if not len(classes):
        return np.arange(STATES, dtype=np.uint8), np.zeros(STATES, np.int64), np.zeros(STATES, bool)
    while len(f[0]) > 1:
        odd = tuple(x[-1:] for x in f) if len(f[0]) % 2 else None
        f = compose(tuple(x[0 : len(x) - len(x) % 2 : 2] for x in f), tuple(x[1::2] for x in f))
        if odd:
            f = tuple(np.concatenate([x, y]) for x, y in zip(f, odd))
    return tuple(x[0] for x in f)


def word_ends(text: bytes, inside: bool) -> np.ndarray:
    """Places of the blanks that end a word, for a text entered in a word or outside."""
    blank = CLASS[np.frombuffer(text, np.uint8)] == BLANK
    before = np.concatenate([[inside], ~blank[:-1]]) if len(blank) else blank
    return np.flatnonzero(blank & before)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide a document's cuts and form."""
    h = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut_counts(doc_id: int | None, n: int) -> tuple[int, int]:
    """Tokens before the two cuts."""
    a, b, _, _ = draws(doc_id)
    return tuple(sorted((a % (n + 1), b % (n + 1))))


def form_of(doc_id: int | None, plain: bool) -> str:
    _, _, c, d = draws(doc_id)
    return "plain" if plain or c % 100 >= FIM_SHARE else "spm" if d % 100 < SPM_SHARE else "psm"


def join(text: bytes, a: int, b: int, form: str) -> bytes:
    """The output of a text that is cut at bytes a and b."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    head, middle = output[len(PREFIX) :].split(MIDDLE)
    first, second = head.split(SUFFIX if form == "psm" else PREFIX)
    return b"".join((first, middle, second) if form == "psm" else (second, middle, first))


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _row(doc_id: int | None, text: bytes, n: int, a: int, b: int, marked: bool) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    form = form_of(doc_id, marked or not text)
    plain = form == "plain"
    return n, form, None if plain else code_points(text[:a]), None if plain else code_points(text[a:b]), join(text, a, b, form)


def cut(doc_id: int | None, text: bytes) -> tuple:
    """The row of a text of one chunk."""
    ends = word_ends(text, False)
    n = len(ends) + bool(text)
    a, b = (0 if not k else len(text) if k > len(ends) else int(ends[k - 1]) for k in cut_counts(doc_id, n))
    return _row(doc_id, text, n, a, b, any(s in text for s in (PREFIX, SUFFIX, MIDDLE)))


_ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _batch(ids: pa.Array, rows: list[tuple], digest: bool) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    if digest:
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        columns += [sha(r[4] for r in rows), sha(restore(r[4], r[1]) for r in rows)]
        names += ["output_sha256", "restored_sha256"]
    else:
        columns.append(pa.array([r[4].decode("utf-8", "replace") for r in rows], pa.string()))
        names.append("output")
    return pa.RecordBatch.from_arrays([ids, *columns], names)


def _schema(digest: bool) -> str:
    return _ROW + (", output_sha256 string, restored_sha256 string" if digest else ", output string")


def _small(docs: DataFrame, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("fill_middle")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield _batch(part.column(0), [cut(i, t) for i, t in zip(part.column(0).to_pylist(), utf8_texts(part.column(1)))], digest)

    return docs.mapInArrow(run, _schema(digest))


def chunk_functions(giants: DataFrame, chunk: int) -> DataFrame:
    """(uid, place, then, ends, found) of each chunk of the texts of (uid, text): chunks of one text go to many tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), utf8_texts(b.column(1))):
                for lo in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([lo // chunk], pa.int32()), pa.array([text[lo : lo + chunk]], pa.binary())], ["uid", "place", "part"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [scan(t) for t in b.column(2).to_pylist()]
            lists = [pa.array([x[i].tolist() for x in f], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["uid", "place", "then", "ends", "found"])

    parts = giants.select("uid", "text").mapInArrow(split, "uid long, place int, part binary").repartition("uid", "place")
    return parts.mapInArrow(scanned, "uid long, place int, then array<int>, ends array<bigint>, found array<boolean>")


def _resolve(functions: DataFrame) -> DataFrame:
    """For each text of (uid, doc_id, place, then, ends, found): its tokens, whether it holds a sentinel, and for both cuts the
    chunk, the state in which that is entered, and the words that end in it up to the cut. A value of Spark has at most 2^31
    bytes, so a group has at most 2^31 / CHUNK rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        doc_id = None if pd.isna(group.doc_id.iloc[0]) else int(group.doc_id.iloc[0])
        state, words, marked, entry, before = 0, 0, False, [], []
        for then, ends, found in zip(group.then, group.ends, group.found):
            entry.append(state)
            before.append(words)
            words += int(ends[state])
            marked |= bool(found[state])
            state = int(then[state])
        n = words + 1
        out = {"uid": [int(group.uid.iloc[0])], "n": [n], "marked": [marked]}
        for name, k in zip("ab", cut_counts(doc_id, n)):
            at = int(np.searchsorted(before, k, "left")) - 1 if k else 0  # the last chunk with fewer words before it
            out |= {f"{name}_place": [at], f"{name}_state": [entry[at]], f"{name}_left": [-1 if k > words else k - before[at]]}
        return pd.DataFrame(out)

    # Ids travel as text: pandas would make floats of a column with nulls.
    return functions.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("uid").applyInPandas(run, "uid long, n long, marked boolean, a_place int, a_state int, a_left long, b_place int, b_state int, b_left long")


def _large(docs: DataFrame, digest: bool, chunk: int) -> DataFrame:
    giants = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"))
    functions = chunk_functions(giants, chunk).join(giants.select("uid", "doc_id"), "uid")
    cuts = materialize(_resolve(functions))

    def place(text: bytes, at: int, state: int, left: int) -> int:
        if left <= 0:
            return 0 if left == 0 else len(text)
        return at * chunk + int(word_ends(text[at * chunk : (at + 1) * chunk], state >= 3)[left - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8_texts(b.column(1))
            for i, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), texts)):
                n, marked, *own = (c[i].as_py() for c in b.columns[2:])
                yield _batch(b.column(0).slice(i, 1), [_row(doc_id, text, n, place(text, *own[:3]), place(text, *own[3:]), marked)], digest)

    both = giants.join(cuts, "uid").select("doc_id", "text", "n", "marked", "a_place", "a_state", "a_left", "b_place", "b_state", "b_left")
    return both.mapInArrow(run, _schema(digest))


def _run(docs: DataFrame, digest: bool, chunk: int) -> DataFrame:
    docs = short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    giant = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    return _small(docs.where(~giant), digest).unionByName(_large(docs.where(giant), digest, chunk))


def transform(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    return _run(docs, False, chunk)


def digests(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Like transform, but with the sha256 of the output and of the text restored from it."""
    return _run(docs, True, chunk)
