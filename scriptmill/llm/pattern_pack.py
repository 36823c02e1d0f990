"""Best-fit packing of token sequences by length patterns.

Documents become pieces of at most ``capacity`` tokens. The lengths' histogram (at most ``capacity``
bins, so its size is bounded) goes to the driver, where patterns of one to three lengths that nearly
fill a sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and what is left is packed best-fit into the patterns' free space and new sequences.
The plan has one slot range for each (pattern, position); it says which ranks of a length go where, so
that each executor places its own pieces from their ranks. No piece travels to the driver.

Edge cases: a null or empty text is one piece that holds the end id alone; a text of any length is cut into as
many pieces as it needs; rows of a null or repeated doc_id are packed each for itself; pieces of one length are
dealt in the order of their tasks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.llm.common import hold, materialize, short_batches, uncollected, utf8_texts

CAPACITY = 2048
END_ID = 0
#: Entries of a worker's table of encoded chunks, and the longest chunk it keeps.
TABLE_ENTRIES, TABLE_CHUNK = 600_000, 64
#: Partner lengths tried with each length when patterns of three are enumerated.
TRIPLES = 10
FIT_STEPS = 150

_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Texts of ASCII and Latin-1 letters alone are split here as the tokenizer's own pattern splits them.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\s]+")

#: Texts that tell tokenizers apart: cases, blanks, digits, marks, endings, special tokens, other letters.
PROBES = ["Aa bB  c\n\td", "it's 'S we'll I'd x've", "a1b 22 333 4-5", "x.y, z!? (a) [b] {c} a--b ...", "ÀÉ çß ÿ×÷ no\u0308 ﬁ ½", "<|endoftext|> <|x", "漢字 😀 ǅ Σ", "end", "", " ", "a\x0bb\x0cc\rd", "supercalifragilistic Expialidocious"]

_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer with tables of what it has encoded.

    This tokenizer drops white space and no merge crosses a word, so each distinct word is encoded once and
    its ids are joined by position. New words go to the library many at a time; a word's last id has the
    end-of-word mark. Texts with other letters than the plain ones have their chunks between blanks for words.
    PROBES check once for each tokenizer that it is such a one; texts go to any other as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.words: dict[str | bytes, bytes] = {}
        self.by_words = True
        texts = [t.encode() for t in PROBES]
        self.by_words = bool(ends.any()) and self.encode(texts) == [self.whole(t).tobytes() for t in PROBES]

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str | bytes]) -> None:
        for c in (w for w in words if type(w) is bytes):
            self.words[c] = self.whole(c.decode("utf-8", "replace")).tobytes()
        plain = [w for w in words if type(w) is str]
        for lo in range(0, len(plain), 5000):
            part = plain[lo : lo + 5000]
            ids = self.whole(" ".join(part))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self.words.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                self.words.update((w, self.whole(w).tobytes()) for w in part)

    def split(self, text: bytes) -> list[str | bytes]:
        s = text.decode("utf-8", "replace")
        if _PLAIN.fullmatch(s) and "<|" not in s:  # else it may hold a special token
            return _WORDS.findall(s.lower())
        return text.translate(_TO_SPACE).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            return [self.whole(t.decode("utf-8", "replace")).tobytes() for t in texts]
        split = [self.split(t) for t in texts]
        ids = [list(map(self.words.get, w)) for w in split]
        holes = [list(compress(range(len(v)), map(not_, v))) if None in v else [] for v in ids]
        missing = {w[i] for w, own in zip(split, holes) for i in own}
        if len(self.words) + len(missing) > TABLE_ENTRIES:
            self.words.clear()
        self.learn(list(missing))
        for w, v, own in zip(split, ids, holes):
            for i in own:
                v[i] = self.words[w[i]]
        for w in missing:
            if len(w) > TABLE_CHUNK:
                del self.words[w]
        return [b"".join(v) for v in ids]


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with the task that made it and its rank among that task's pieces of its length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    @uncollected  # nothing here is cyclic
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, end = TaskContext.get().partitionId(), Counter(), np.asarray([end_id], "<u4").tobytes()
        hold("pattern_pack", _encoders.clear)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows: list[list] = [[] for _ in schema]
                for doc, ids in zip(part.column(0).to_pylist(), encode_texts(list(utf8_texts(part.column(1))), tokenizer_path)):
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        for column, x in zip(rows, (doc, k, start, n, zlib.crc32(own), task, seen[n])):
                            column.append(x)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), longest first, whose sum is as near the capacity as the lengths allow."""
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    found = {(int(a), 0, 0) for a in present}

    def largest(room: np.ndarray | int) -> np.ndarray:
        """The largest length present that is no larger; 0 if none."""
        i = np.searchsorted(present, room, "right")
        return np.where(i > 0, present[np.maximum(i - 1, 0)], 0)

    common = present[np.argsort(-histogram[present], kind="stable")][:TRIPLES]
    for a in present:
        b = int(largest(capacity - a))
        if b:
            found.add((*sorted((int(a), b), reverse=True), 0))
            spread = present[present < capacity - a]
            spread = spread[np.linspace(0, len(spread) - 1, min(TRIPLES, len(spread))).astype(int)] if len(spread) else spread
            for m in {*map(int, common), *map(int, spread)}:
                if m < capacity - a and (c := int(largest(capacity - a - m))):
                    found.add(tuple(sorted((int(a), m, c), reverse=True)))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def fit(histogram: np.ndarray, found: np.ndarray, capacity: int) -> np.ndarray:
    """Repeat counts by non-negative least squares: multiplicative steps on || A x - h ||^2, weighted by use of space."""
    keep = found.sum(1) >= 0.97 * capacity
    x = np.where(keep, 1.0, 0.0)
    if not keep.any():
        return x
    h, p = histogram.astype(float), found[keep]
    weight = np.sqrt(np.arange(len(h)) / capacity)
    w2 = weight**2
    w2[0] = 0
    up = (w2 * h)[p].sum(1)
    y = np.maximum(h[p[:, 0]], 1) / max(1, len(p))
    for _ in range(FIT_STEPS):
        made = np.bincount(p.ravel(), np.repeat(y, 3), len(h))
        y *= up / np.maximum((w2 * made)[p].sum(1), 1e-12)
    x[keep] = y
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths in order, number of sequences) that use up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    if not left.any():
        return groups
    found = patterns(left, capacity)
    x = fit(left, found, capacity)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        own = Counter(int(v) for v in found[i] if v)
        n = min(int(x[i]), *(int(left[v]) // k for v, k in own.items()))
        if n > 0:
            groups.append((tuple(int(v) for v in found[i] if v), n))
            for v, k in own.items():
                left[v] -= n * k
    # Residuals, longest first, each into the least free space that holds it; equal bins move together.
    room: dict[int, list[list]] = {}
    for lengths, n in groups:
        room.setdefault(capacity - sum(lengths), []).append([lengths, n])
    for v in np.flatnonzero(left)[::-1].tolist():
        c = int(left[v])
        while c:
            s = min((s for s in room if s >= v), default=None)
            if s is None:
                m = min(capacity // v, c)
                bins, lengths = c // m, (v,) * m
                room.setdefault(capacity - v * m, []).append([lengths, bins])
                c -= bins * m
                continue
            group = room[s][-1]
            m = min(s // v, c)
            bins = min(group[1], c // m)
            group[1] -= bins
            if not group[1]:
                room[s].pop()
                if not room[s]:
                    del room[s]
            room.setdefault(s - v * m, []).append([group[0] + (v,) * m, bins])
            c -= bins * m
    merged: Counter = Counter()
    for own in room.values():
        for lengths, n in own:
            merged[lengths] += n
    return sorted(merged.items(), key=lambda g: (-sum(g[0]), g[0]))


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence numbers and offsets of its slot ranges."""
    out: dict[int, list[list[int]]] = {}
    used: Counter = Counter()
    base = 0
    for lengths, n in groups:
        at = 0
        for v in lengths:
            own = out.setdefault(v, [[], [], []])
            for column, x in zip(own, (used[v], base, at)):
                column.append(x)
            used[v] += n
            at += v
        base += n
    return {v: tuple(np.array(c, np.int64) for c in own) for v, own in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    own = materialize(pieces(docs, tokenizer_path, capacity, end_id))
    by_task = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    table = slots(plan(histogram, capacity))
    # A row for each (length, task): a hot length has as many as there are tasks, however many its pieces.
    first = by_task.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select("length", "task", F.coalesce("first", F.lit(0)).alias("first"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                firsts, bases, offsets = table[int(v)]
                at = np.flatnonzero(length == v)
                i = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at], offset[at] = bases[i] + rank[at] - firsts[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    ranked = own.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
