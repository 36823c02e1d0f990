"""Licence scans: spans of a text compared to licence templates by Dice coefficient over word bigrams.

A text is normalised as a whole (A-Z lowered, anything but a-z and 0-9 becomes a blank), so that line ends and
layout don't matter. A span is as many bigrams in a row as the template has, or fewer at the text's end; its set of
bigrams B is compared to the template's set T by 2 |B & T| / (|B| + |T|). All spans that begin with a bigram
of the template are looked at. A coefficient of t or more needs |B & T| >= |T| t / (2 - t) (the size bound: B
alone can't be smaller), so a template is left out unless that many of the text's places hold its bigrams, and a
span unless that many lie in it. Bigrams are compared by 64-bit hashes. All of it is higher-order functions on one
row's arrays: no shuffle, no Python.

Edge cases: a null or empty text, or one of a single word, has no spans; ties between templates go to the one listed
first; a null doc_id is scanned like any other; rows that repeat a doc_id are scanned each for itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import LOWER, UPPER
from scriptmill.llm.licence_texts import TEMPLATES

THRESHOLD = 0.7


def words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def bigrams(text: str) -> list[str]:
    """A text's distinct bigrams."""
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def _hashes(grams: list[str]) -> list[int]:
    """As Spark's xxhash64 of two words."""
    from xxhash import xxh64_intdigest

    unsigned = [xxh64_intdigest(b, xxh64_intdigest(a, 42)) for a, b in (g.encode().split(b" ") for g in grams)]
    return [h - (1 << 64) if h >> 63 else h for h in unsigned]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_found (templates that the text holds), licence (of the best span, null if none) and dice (0 if none)."""
    own = [(name, len(words(text)) - 1, _hashes(bigrams(text))) for name, text in (TEMPLATES if templates is None else templates)]
    bound = lambda t: math.ceil(len(t) * threshold / (2 - threshold) - 1e-9)
    gram = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))
    last = F.size("w") - 2

    def best(k: int, places: int, t: list[int]) -> Column:
        """(dice, -k) of the template's best span; null below the threshold."""

        def dice(i: Column) -> Column:
            span = F.array_distinct(F.transform(F.sequence(i, F.least(i + (places - 1), last)), gram))
            return _let(span, lambda b: F.lit(2.0) * F.size(F.filter(b, lambda h: h.isin(t))) / (F.size(b) + len(t)))

        # Places of the template's bigrams, in order; a span that holds enough of them begins at one.
        enough = lambda at: F.filter(at, lambda i, j: F.get(at, j + (bound(t) - 1)) - i < places)
        top = _let(F.filter("at", lambda i: gram(i).isin(t)), lambda at: F.array_max(F.transform(enough(at), dice)))
        top = F.when(F.size("at") >= bound(t), top)
        return F.filter(F.array(F.struct(top.alias("dice"), F.lit(-k).alias("k"))), lambda x: x["dice"] >= threshold)

    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split(lowered, "[^a-z0-9]+", -1), "").alias("w"))
    every = sorted({h for _, _, t in own for h in t})
    placed = split.select("doc_id", "w", F.when(F.size("w") > 1, F.filter(F.sequence(F.lit(0), last), lambda i: gram(i).isin(every))).alias("at"))
    found = F.when(F.size("at") >= min(bound(t) for _, _, t in own), F.flatten(F.array(*[best(k, places, t) for k, (_, places, t) in enumerate(own)])))
    out = placed.select("doc_id", F.coalesce(found, F.array().cast("array<struct<dice:double,k:int>>")).alias("found"))
    names = F.array(*[F.lit(name) for name, _, _ in own])
    top = F.array_max("found")
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), F.when(F.size("found") > 0, F.get(names, -top["k"])).alias("licence"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"))


def sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB's SQL: every span that begins with a template's bigram, without bounds."""
    own = TEMPLATES if templates is None else templates
    rows = ", ".join(f"({k}, '{name}', {len(words(text)) - 1}, {bigrams(text)!r})" for k, (name, text) in enumerate(own))
    return f"""
with t(k, licence, places, b) as (values {rows}),
tg as (select k, unnest(b) as g from t),
split as (
  select row_number() over () as r, doc_id, list_filter(string_split(trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') as w
  from documents
),
grams as (select r, unnest(range(1, len(w))) as i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from split),
starts as (select r, i, k, places, len(b) as n from grams join tg using (g) join t using (k)),
spans as (
  select s.r, s.k, s.i, s.n, count(distinct grams.g) as nb, count(distinct tg.g) as shared
  from starts s join grams on grams.r = s.r and grams.i between s.i and s.i + s.places - 1 left join tg on tg.k = s.k and tg.g = grams.g
  group by all
),
best as (select r, k, max(2.0::double * shared / (nb + n)) as dice from spans group by all having max(2.0::double * shared / (nb + n)) >= {threshold}),
found as (select r, count(*) as n_found, max(struct_pack(dice := dice, k := -k)) as m from best group by r)
select d.doc_id, coalesce(n_found, 0) as n_found, t.licence, coalesce(m.dice, 0.0)::double as dice
from split d left join found using (r) left join t on t.k = -m.k
"""
