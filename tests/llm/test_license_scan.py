import re

import numpy as np
import pytest

from linkweave.llm import license_scan as ls

from . import helpers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    lines = [words(x) for x in (text or "").split("\n") if words(x)]
    found, longest = {}, max(len(t.split()) for _, t in ls.TEMPLATES)
    for i in range(len(lines)):
        n = 3
        while i + n < len(lines) and sum(map(len, lines[i + 1 : i + n])) < longest:
            n += 1
        b = set().union(*lines[i : i + n])
        for label, t in ls.TEMPLATES:
            t = set(t.split())
            if len(t & b) >= 0.8 * len(t) - 1e-9:
                found[label] = max(found.get(label, 0), len(t & b) / len(t))
    starts = [i for i, _ in places]
    base = ",".join(sorted({x for _, x in places}))
    score = 1.0 if places else max(found.values(), default=0.0)
    return len(w), len(places), min(starts, default=None), max(starts, default=None), base, ",".join(sorted({x for _, x in places} | set(found))), round(score, 9)


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)


def test_query_equals_brute_force(spark):
    rows = ls.op5_license_scan(spark, helpers.SF).collect()
    want = {d: brute(t) for d, t in helpers.documents()}
    assert {r.doc_id: row(r) for r in rows} == want and len(rows) == len(want)
    assert sum(w[1] for w in want.values()) >= 3 and any(w[5] != w[4] for w in want.values())


ODD_TEXTS = [
    "under the MIT license under the mit LICENSE",
    "cc by nc by nc cc-by-nc, CC BY\nNC",
    "Licensed under the\nApache License,\nVersion 2.0",
    "This work is licensed under GNU General Public License 3",
    "under the mit licenses; sunder the mit license",
    "cc\x00by\x7fnc 1",
    "Éapache license version 2",
    "all rights",
]


def test_odd_texts(spark):
    docs = list(helpers.ODD) + [(100 + i, t, "en", "s", 1, 0.1, "u") for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(docs, helpers.DOCS)
    got = ls.scan(df).collect()
    by = sorted(((r.doc_id, r.n_words, len(r.places)) for r in got), key=str)
    assert by == sorted(((d[0], *brute(d[1])[:2]) for d in docs), key=str)
    assert ls.scan(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_filters_lose_no_match(threshold):
    rng = np.random.default_rng(int(threshold * 10))
    vocabulary = [f"w{i}".encode() for i in range(30)]
    known = [ls.Template(str(k), frozenset(rng.choice(vocabulary, rng.integers(2, 9)).tolist())) for k in range(25)]
    index = ls.Index(known, {w: int(rng.integers(0, 50)) for w in vocabulary}, threshold)
    for _ in range(500):
        block = frozenset(rng.choice(vocabulary, rng.integers(0, 25)).tolist())
        want = {k: len(t.words & block) / len(t.words) for k, t in enumerate(known) if len(t.words & block) >= threshold * len(t.words) - 1e-9}
        assert dict(index.matches(block)) == want


@pytest.mark.parametrize("width", [1, 2, 4, 9])
@pytest.mark.parametrize("between", ["\n", "\n\n", "\n# \n#\t\n * "])
def test_wrapped_and_spaced_notices_are_found(spark, width, between):
    rows = []
    for i, (_, text) in enumerate(ls.TEMPLATES):
        w = ("some code that stands before " + text + " and some that follows it in this file").split()
        rows.append((i, between.join(" ".join(w[k : k + width]) for k in range(0, len(w), width)), i, i))
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, places int")
    got = {r.doc_id: {f.template for f in r.found if f.containment == 1.0} for r in ls.scan(df).collect()}
    assert all(i in got[i] for i in range(len(ls.TEMPLATES)))
