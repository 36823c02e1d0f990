"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

A first pass counts what weights need from all documents (how many there are, their terms, the documents of each term)
and writes a forward index: for each document its length and, for the terms of the items, how often they occur. A
second pass reads that index in blocks. A block has a list for each term, sorted by impact, and its rows of the forward
index; for each item the lists are read round-robin from their tops, every document met there is scored whole by its
forward row, and an item is done with a block when the impacts at the depth read so far, which no unread document can
exceed, add up to strictly less than its kth score, of all blocks that the task has read. Depth grows by doubling steps,
so an item reads at most about twice what single steps would. Tasks give each item's best, and the best of those remain.

Items go out to the tasks in groups of about TERMS_AT_ONCE terms; however many groups there are, each meets every block.

Edge cases: null and empty texts and those without a term count for nothing; an item without terms has no rows, and
terms that nearly all documents hold weigh 0; equal scores go by doc_id, null last; each row of items is an item and
each row of documents a document, whatever its id; very long texts are read whole, a piece at a time; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.llm.common import LOWER, UPPER, hold, scratch_path, short_batches, utf8_texts

TOP = 10
#: Terms of the items that are looked up in one pass, about: what tasks are sent.
TERMS_AT_ONCE = 500_000
#: Postings and documents of a block: what a task holds.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 1 << 14
#: Entries of each list that are read before the threshold is looked at for the first time; then twice as many, and so on.
FIRST_STEP, LAST_STEP = 8, 1 << 10
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 22
#: Groups by doc_id in which the tasks' candidates of an item meet first.
SPREAD = 16

#: Characters that are in no term (fixed values); all others are, A-Z as a-z.
APART = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if i in set(APART) else i + 32 if chr(i) in UPPER else i for i in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def counted(text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and how often each; a long text is cut between terms, so that its terms are never all held."""
    n, counts, lo = 0, Counter(), 0
    plain = text.translate(_TABLE)
    while lo < len(plain):
        hi = plain.find(b" ", lo + PIECE)
        hi = len(plain) if hi < 0 else hi
        own = plain[lo:hi].split()
        n += len(own)
        counts.update(own)
        lo = hi
    return n, counts


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _items(items: DataFrame) -> DataFrame:
    """item_id and its different terms, for items that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [list(dict.fromkeys(t.decode("utf-8", "replace") for t in terms_of(x))) for x in utf8_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<string>").where(F.size("terms") > 0)


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The forward index (counts: false), and one row a task with its documents, terms and documents of each term (true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("threshold_search")
        documents, length, holding = 0, 0, np.zeros(len(vocabulary), np.int64)
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))
        names = ["counts", "doc_id", "n", "terms", "tfs"]
        for b in batches:
            rows, ns, at, ids, tfs = [], [], [0], [], []
            for i, text in enumerate(utf8_texts(b.column(1))):
                n, own = counted(text)
                if not n:
                    continue
                documents += 1
                length += n
                found = [(vocabulary[t], c) for t, c in own.items() if t in vocabulary]
                if found:
                    rows.append(i)
                    ns.append(n)
                    ids += [t for t, _ in found]
                    tfs += [c for _, c in found]
                    at.append(len(ids))
            holding += np.bincount(np.array(ids, np.int64), minlength=len(vocabulary))
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(rows), pa.bool_()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), lists(at, ids), lists(at, tfs)], names)
        met = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([documents], pa.int64()), pa.array([length], pa.int64()), lists([0, len(met)], met), lists([0, len(met)], holding[met])], names)

    return docs.mapInArrow(run, "counts boolean, doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """An item's best documents so far: scores, whether the id is null, and ids, best first."""

    def __init__(self, top: int):
        self.top = top
        self.rows = np.zeros((3, 0), np.int64)

    def least(self) -> int | None:
        """The kth score, if there are k."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.top else None

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= (self.least() or 1)  # scores above 0 alone
        if keep.any():
            rows = np.concatenate([self.rows, np.stack([scores[keep], null[keep], ids[keep]])], axis=1)
            self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.top]]


class Block:
    """Some documents' rows of the forward index, and their terms' lists in the order of impact."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, at: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.ids, self.null, self.at, self.terms, self.impacts = ids, null, at, terms, impacts
        order = np.lexsort((-impacts, terms))
        self.list_docs = np.repeat(np.arange(len(ids)), np.diff(at))[order]
        self.list_impacts = impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.read = 0

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores by random lookups of forward rows; weights are 0 for terms that aren't the item's."""
        sizes = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(self.at[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.terms[place]] * self.impacts[place], ends - sizes)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Read the terms' lists until no unread document can be among the best."""
        terms = terms[(weights[terms] > 0) & (self.starts[terms + 1] > self.starts[terms])]
        if not len(terms):
            return
        lo, hi, w = self.starts[terms], self.starts[terms + 1], weights[terms]
        seen = np.zeros(len(self.ids), bool)
        depth, step = 0, FIRST_STEP
        while True:
            # An unread document is at most as good as the entries at this depth; a list that is read through has none.
            here = lo + depth
            left = here < hi
            bound = int((w * np.where(left, self.list_impacts[np.minimum(here, hi - 1)], 0)).sum())
            if not left.any() or (least := best.least()) is not None and bound < least:
                return
            sizes = np.minimum(hi - here, step)[left]
            ends = np.cumsum(sizes)
            met = self.list_docs[np.arange(ends[-1]) + np.repeat(here[left] - (ends - sizes), sizes)]
            self.read += len(met)
            new = np.unique(met[~seen[met]])
            if len(new):
                seen[new] = True
                best.add(self.scores(new, weights), self.null[new], self.ids[new])
            depth += step
            step = min(2 * step, LAST_STEP)


def _search(forward: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """Each task's best documents of each item: (item, doc_id, score)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held: list[tuple] = []
        rows = postings = 0

        def block() -> Block:
            ids, null, ns, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at = np.concatenate([[0], np.cumsum(sizes)])
            m = 100 - 90 + 90 * ns * documents // length
            return Block(ids, null, at, terms, 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes)), len(weights))

        for b in batches:
            if not b.num_rows:
                continue
            ids, ns, terms, tfs = b.columns
            flat = lambda x: x.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ns.to_numpy(), sizes, flat(terms), flat(tfs)))
            rows, postings = rows + b.num_rows, postings + int(sizes.sum())
            if rows >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield block()
                rows = postings = 0
        if held:
            yield block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("threshold_search")
        best = [Best(top) for _ in items]
        own = np.zeros_like(weights)
        for b in blocks(batches):
            for terms, found in zip(items, best):
                own[terms] = weights[terms]
                b.search(terms, own, found)
                own[terms] = 0
        for i, found in enumerate(best):
            if n := found.rows.shape[1]:
                scores, null, ids = found.rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return forward.mapInArrow(run, "item int, doc_id long, score long")


def _group(docs: DataFrame, items: list, top: int) -> DataFrame:
    """The rows of a group of items, each with its terms."""
    spark = docs.sparkSession
    vocabulary = {t.encode(): i for i, t in enumerate(dict.fromkeys(t for r in items for t in r.terms))}
    path = scratch_path(spark)
    _forward(docs, vocabulary).write.partitionBy("counts").option("compression", "zstd").parquet(path)
    index = spark.read.schema("doc_id long, n long, terms array<int>, tfs array<int>, counts boolean").parquet(path)
    counts, forward = index.where("counts"), index.where("not counts").drop("counts")
    documents, length = counts.agg(F.sum("doc_id"), F.sum("n")).head()
    pairs = counts.select(F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.tfs")).collect()  # at most the vocabulary
    weights = np.zeros(len(vocabulary), np.int64)
    for term, holding in pairs:
        weights[term] = weight(documents, holding)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    if not pairs:
        return names.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).where("false")
    found = _search(forward, [np.array([vocabulary[t.encode()] for t in r.terms]) for r in items], weights, documents, length, top)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for key in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))], ["item"]):  # tasks' candidates meet in two steps
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``top`` best documents."""
    docs = short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    own = _items(items)
    groups = max(1, math.ceil((own.agg(F.sum(F.size("terms"))).head()[0] or 0) / terms_at_once))
    out = None
    for g in range(groups):
        part = own.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(groups)) == g) if groups > 1 else own
        if rows := part.collect():  # about terms_at_once terms
            found = _group(docs, rows, top)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def sql() -> str:
    """DuckDB's SQL for the ten best documents of each item."""
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')"
    return f"""
with d as (select row_number() over () as u, doc_id, {terms} as ts from documents where text is not null),
whole as (select count(*) as nd, sum(len(ts))::bigint as l from d where len(ts) > 0),
tf as (select u, doc_id, n, term, count(*) as tf from (select u, doc_id, len(ts) as n, unnest(ts) as term from d) group by all),
df as (select term, floor(1000 * ln((2.0 * any_value(nd) + 2) / (2 * count(*) + 1)))::bigint as w from tf, whole group by term),
item as (select i, item_id, unnest(list_distinct({terms})) as term from (select row_number() over () as i, * from benchmark)),
scored as (select i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))))::bigint as score
  from item join tf using (term) join df using (term), whole group by i, item_id, u, doc_id),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as r from scored where score > 0)
select item_id, r::int as rank, doc_id, score from ranked where r <= {TOP}"""
