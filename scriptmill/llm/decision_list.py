"""Quality rules as learned decision lists.

Statistics of each text are DataFrame expressions. Rules are conjunctions of thresholds on them, found by
sequential covering: grow a conjunction on two thirds of the labelled rows, prune it on
the other third, keep it if it is precise there, take the rows it covers away, and go on. The list becomes
one ordered CASE expression; what no rule covers is kept.

The learner sees at most ``SAMPLE_ROWS`` labelled rows (those with the least hashes of their ids, so that
every size is treated alike); everything else runs on all rows. Only the sample's statistics reach the driver.

Edge cases: a null or empty text has all statistics 0 and fails the base rules; a null doc_id is judged like any
other and never learned from; documents with contradictory labels aren't learned from; without labels of both
kinds the list is empty; rows that repeat a doc_id are judged each for itself; an empty table gives an empty
result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import LOWER, SPACE_CLASS, SPACES, UPPER

SAMPLE_ROWS = 20_000
#: Quantiles tried as thresholds: even steps and both tails.
THRESHOLDS = sorted({*np.linspace(0, 1, 25), *(1 - 0.2 * 0.8 ** np.arange(25)), *(0.2 * 0.8 ** np.arange(25))})
PRECISION_POWER = 8
MAX_CONDITIONS, MAX_RULES = 3, 12
MIN_PRECISION, MIN_COVERED = 0.97, 5
SYMBOLS = "#*$%&|<>"

#: Statistics that the learner may use: shares, so that a rule means the same for short and long texts.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "pipe_share": "n_pipes / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _count(text: Column, characters: str) -> Column:
    """Code points of the text that are among the characters."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and counts of each text. No shuffle, no Python: arrays and higher-order functions.

    carry: the whole row comes along as ``__row``.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("__row")] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.ltrim(x, F.lit(SPACES))) > 0)
    # One pass leaves the few characters that are counted; the counts read those only.
    few = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), lines.alias("lines"), F.length(text).alias("chars"), F.translate(text, LOWER, "").alias("few"))
    few = few.select("*", F.length("few").alias("n_few"), F.translate("few", SPACES, "").alias("marks"))
    one = few.select(
        *["__row"] * carry,
        "doc_id",
        "words",
        "lines",
        (F.col("chars") - F.col("n_few") + F.length("marks")).cast("long").alias("word_chars"),
        _count(F.col("marks"), SYMBOLS).alias("n_symbols"),
        _count(F.col("marks"), UPPER).alias("n_upper"),
        _count(F.col("marks"), "0123456789").alias("n_digits"),
        _count(F.col("marks"), "!?").alias("n_bangs"),
        _count(F.col("marks"), "|").alias("n_pipes"),
        _count(F.col("marks"), ".").alias("n_stops"),
        # Windows' hashes. In most texts they are all different.
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("hashes"),
    )
    n = F.size("words")
    # An expression that isn't deterministic: filters on the counts stay above it, and its arrays are computed once.
    once = lambda x: F.when(F.monotonically_increasing_id() >= 0, x)
    # Else a hash with its place; equal hashes are neighbours once sorted.
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    two = one.select("*", once(F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed)).alias("windows"))
    h = lambda j: F.get("windows", j)["h"]
    twice = F.filter("windows", lambda x, j: (x["h"] == h(j + 1)) | ((j > 0) & (x["h"] == h(F.greatest(j - 1, F.lit(0))))))
    three = two.select("*", once(twice).alias("twice"))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return three.select(
        *["__row"] * carry,
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("twice").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_digits",
        "n_bangs",
        "n_pipes",
        "n_stops",
        F.size("lines").cast("long").alias("n_lines"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature <= threshold
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, candidates: list[Condition]) -> Rule:
    """Conditions that raise coverage times a power of precision, so that rules get precise before they get wide."""
    rule: Rule = ()
    inside, worth = np.ones(len(bad), bool), bad.sum() * bad.mean() ** PRECISION_POWER if len(bad) else 0.0
    for _ in range(MAX_CONDITIONS):
        best = None
        for c in candidates:
            own = inside & c.holds(x)
            p, all_of = int((own & bad).sum()), int(own.sum())
            if p >= MIN_COVERED and (g := p * (p / all_of) ** PRECISION_POWER) > worth * 1.001:
                best, worth = c, g
        if best is None:
            break
        rule = tuple(c for c in rule if (c.feature, c.above) != (best.feature, best.above)) + (best,)
        inside &= best.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """Precision (one error more than seen) and rows covered."""
    own = covers(rule, x)
    return (own & bad).sum() / max(1, own.sum() + 0.5), int(own.sum())


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, for_growth: np.ndarray) -> list[Rule]:
    """Rules that reject, in order."""
    rules: list[Rule] = []
    candidates = [Condition(f, above, float(t)) for f, v in x.items() for t in np.unique(np.quantile(v, THRESHOLDS)) for above in (True, False)] if len(bad) else []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, p = left & for_growth, left & ~for_growth
        part = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grow(part(g), bad[g], candidates)
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (round(_worth(r, part(p), bad[p])[0], 3), -len(r)))
        precision, covered = _worth(rule, part(p), bad[p])
        if precision < MIN_PRECISION - 0.5 / max(1, covered) or covered < MIN_COVERED:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled documents."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    sample = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(sample_rows)
    own = docs.join(F.broadcast(sample), docs["doc_id"].cast("long") == sample["doc_id"]).select(sample["doc_id"], docs["text"])
    rows = statistics(own).join(F.broadcast(sample), "doc_id").select("quality", "_h", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]).orderBy("_h").limit(2 * sample_rows).collect()
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    bad = np.array([r["quality"] == 0 for r in rows], bool)
    if not bad.any() or bad.all():
        return []
    return learn_rules(x, bad, np.array([r["_h"] % 3 != 0 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """The ordered CASE expression: false at the first rule that holds, true if none does."""
    out = F
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def keep(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are kept, all columns unchanged."""
    fine = ~F.expr(FAILED) & verdict(learn(docs, labels, sample_rows))
    return statistics(docs, carry=True).where(fine).select("__row.*")


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the five counts, base_failed and kept."""
    failed = F.expr(FAILED)
    own = statistics(docs).withColumn("base_failed", failed)
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & verdict(learn(docs, labels, sample_rows))).alias("kept"))
