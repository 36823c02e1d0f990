import re
import textwrap

import duckdb
import pandas as pd

from scriptmill.llm import licences
from scriptmill.llm.licence_texts import NOTICES, TEMPLATES, TEXTS

MIT = dict(TEXTS[:1])["MIT"]
GPL = dict(NOTICES)["GPL-3.0"]
FLAT = lambda t: " ".join(t.split())
TEXTS_OF = {
    "null": None,
    "empty": "",
    "blank": "\n\n",
    "word": "x",
    "sentence": "Released under the MIT License.",
    "in a line": "Some words. Released under the MIT License. And more of them on the same line.",
    "two": "a\nRELEASED under the -- mit license!\nLicensed under CC BY-NC 4.0.\nz",
    "three": "Licensed under CC BY-NC 4.0.\n" * 3,
    "long": "Released under the MIT License. " + "w " * 3000,
    "repeats": "mit license " * 2000,
    "other letters": "é Released ünder the MIT License",
    "mit wrapped": "Copyright (c) 2020 A\n\n" + textwrap.fill(FLAT(MIT), 40) + "\n\ncode()",
    "mit in a line": FLAT(MIT),
    "mit opening": FLAT(MIT).split(":")[0] + ":",
    "gpl comment": "\n".join(" * " + x for x in textwrap.wrap(FLAT(GPL), 70)),
    "gpl cut": FLAT(GPL)[: len(FLAT(GPL)) // 2] + " but then the text goes on about something else entirely. " * 5,
    "prose": "permission is what the software of any kind without the other " * 40,
}


def brute(text, templates, threshold=licences.THRESHOLD):
    w = licences.words(text or "")
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    found = []
    for k, (name, template) in enumerate(templates):
        t, places = set(licences.bigrams(template)), len(licences.words(template)) - 1
        best = max((2 * len(set(b) & t) / (len(set(b)) + len(t)) for b in (grams[i : i + places] for i in range(len(grams)) if grams[i] in t)), default=0)
        if best >= threshold:
            found.append((best, -k, name))
    return (len(found), max(found)[2], max(found)[0]) if found else (0, None, 0.0)


def test_scan_equals_sql_and_brute_force(spark):
    rows = [(i, t, "c", "d") for i, t in enumerate(TEXTS_OF.values())] + [(None, "Released under the MIT License.", "c", "d"), (0, "x y", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string, w string")
    got = sorted(((r.doc_id, r.n_found, r.licence, r.dice) for r in licences.scan(docs).collect()), key=repr)
    assert got == sorted(((d, *brute(t, TEMPLATES)) for d, t, _, _ in rows), key=repr)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "licence", "w"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    assert sorted(duckdb.sql(licences.sql()).fetchall(), key=repr) == got
    by_id = {g[0]: g[2] for g in got if g[0]}
    at = list(TEXTS_OF)
    want = {"sentence": "MIT", "in a line": "MIT", "three": "CC-BY-NC-4.0", "long": "MIT", "mit wrapped": "MIT", "mit in a line": "MIT", "mit opening": "MIT", "gpl comment": "GPL-3.0", "prose": None, "word": None}
    assert {k: by_id[at.index(k)] for k in want} == want


def test_every_template_is_found_in_its_text(spark):
    rows = [(i, "some words before it\n" + re.sub(r"\s+", "\n", t) + "\nand after it") for i, (_, t) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(TEMPLATES):
        assert got[i].licence == name and got[i].dice > 0.97, name


def test_native_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")] * 2, "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert licences.scan(docs).count() == 2 and licences.scan(docs.limit(0)).count() == 0
