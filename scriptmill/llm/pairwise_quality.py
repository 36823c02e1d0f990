"""Quality scores by Bradley-Terry pairwise ranking.

Features are statistics of the text's bytes, words and lines. A preference pair is a document of label 1 and
one of label 0; the score is linear, s(x) = w . f(x), and w minimises the logistic loss of the features'
differences, -log sigmoid(w . (f(better) - f(worse))), with a small ridge, by Newton's steps. Only differences
matter to the loss, so the cut comes from the scores themselves: the quantile at the share of label 0 among
the sample. The published score is sigmoid(s - cut + logit(CUT)), so that CUT is where the quantile lies.

Pairs come from at most ``SAMPLE_ROWS`` labelled documents (those with the least hashes of their ids) outside
the held-out fold; every document is scored over its whole text, in one pass without a shuffle.

Edge cases: a null or empty text has features of 0 and a finite score; a null doc_id is scored like any other,
counts as the empty id for the fold and is never learned from; documents with contradictory labels aren't learned
from; without labels of both kinds every score is CUT; rows that repeat a doc_id are scored each for itself; an
empty table gives an empty result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import crc_mod, hold, short_batches, utf8_view

FOLDS = 5
CUT = 0.3
SAMPLE_ROWS = 20_000
PAIRS_EACH = 8  # a sample has at most 8 * SAMPLE_ROWS pairs
RIDGE, STEPS = 1e-3, 12
#: Bytes read at a time, so that a long text needs no more memory than a short one.
PART = 1 << 22

_GROUPS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9, 11, 12, 13),
    "line": (10,),
    "high": range(128, 256),
    "control": (*range(9), *range(14, 32), 127),
    **{chr(c): (c,) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))},
}
_OF_BYTE = np.zeros(256, np.intp)
for _i, _g in enumerate(_GROUPS.values()):
    _OF_BYTE[list(_g)] = _i
NAMES = [*(f"share of {g}" for g in _GROUPS), "bytes in a word", "words in a line", "share of repeated lines", "share of short lines", "log of words"]


def features(text: np.ndarray) -> np.ndarray:
    """Statistics of one text's bytes."""
    by_byte = np.zeros(256)
    words = 0
    before = True
    for lo in range(0, len(text), PART):
        part = text[lo : lo + PART]
        by_byte += np.bincount(part, minlength=256)
        blank = _BLANK[part]
        starts = ~blank & np.concatenate([[before], blank[:-1]])
        words += int(starts.sum())
        before = bool(blank[-1])
    raw = text.tobytes()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n = max(1.0, by_byte.sum())
    shares = np.log(np.bincount(_OF_BYTE, by_byte, len(_GROUPS)) / n + 1e-3) - np.log(1e-3)
    word_bytes = by_byte.sum() - by_byte[_BLANK].sum()
    count = max(1, len(lines))
    rest = [word_bytes / max(1, words), np.log1p(words / count), 1 - len(set(lines)) / count if lines else 0.0, sum(len(x) < 40 for x in lines) / count, np.log1p(words)]
    return np.concatenate([shares, rest])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _all_features(b: pa.RecordBatch, k: int) -> np.ndarray:
    body, at = utf8_view(b.column(k))
    return np.array([features(body[x:y]) for x, y in zip(at[:-1], at[1:])]).reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray) -> Ranking:
    """A ranking from features and labels."""
    if not good.any() or good.all():
        return Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0)
    rng = np.random.default_rng(11)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = PAIRS_EACH * max(len(better), len(worse))
    d = z[rng.choice(better, n)] - z[rng.choice(worse, n)]
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + RIDGE * (w @ w) / 2
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = -(d * p[:, None]).mean(0) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step, t, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-4:
            t /= 2
        w = w - t * step
    # The ends of the two kinds around the quantile: the cut lies in their middle.
    raw = np.sort(z @ w)
    k = len(worse)
    return Ranking(mean, scale, w, float((raw[k - 1] + raw[k]) / 2))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """From at most ``sample_rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__q"), F.max("quality").alias("__most"))
    sample = known.where((F.col("__q") == F.col("__most")) & (crc_mod("__id", FOLDS) != 0)).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).select("__id", "__q")
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(sample), "__id").select("__id", "__q", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pairwise_quality")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(_all_features(b, 2)), pa.list_(pa.float64()))], ["id", "q", "x"])

    own = rows.mapInArrow(run, "id long, q int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(2 * sample_rows).collect()
    x = np.array([r["x"] for r in own], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["q"] == 1 for r in own], bool))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The documents' doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                s = ranking.scores(_all_features(part, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The documents that score CUT or more, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield part.filter(pa.array(ranking.scores(_all_features(part, part.schema.get_field_index("text"))) >= CUT))

    return short_batches(docs).mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, learn(docs, labels, sample_rows))
