import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import quality_rules as q

from . import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def test_query_equals_brute_force(spark):
    rows = q.op7_quality_rules(spark, helpers.SF).collect()
    want = {d: brute(t) for d, t in helpers.documents()}
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\xa0#é\x1c", max_size=120))
def test_measures_equal_brute_force(text):
    m = q.measures(text)
    assert (m[0], m[1], m[2], m[4], m[5]) == brute(text)[:5]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_repeated_windows(ids):
    assert q.repeated_words(np.array(ids, np.int64)) == brute(" ".join(map(str, ids)))[4]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, 0, 1), (8, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = q.judge(helpers.odd(spark), labels).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in helpers.ODD), key=str)
    none = labels.limit(0)
    assert q.judge(helpers.empty(spark), none).count() == 0
    assert all(r.kept != r.base_failed for r in q.judge(helpers.odd(spark), none).collect())


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 40, 0.2), (39, 40, 0.5), (40, 40, 0.5), (5, 2000, 0.005)])
def test_binomial_tail(k, n, p):
    assert math.isclose(q.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_certified_steps_keep_the_risk():
    """Where every step has a risk just above the limit, one is certified in at most about delta of the draws."""
    rng, alpha, delta, wrong = np.random.default_rng(3), 0.05, 0.1, 0
    for _ in range(400):
        n = 500
        good = np.full(30, rng.binomial(n, alpha * 1.001))
        wrong += q.choose(good, np.full(30, n), n, n, alpha, delta) is not None
    assert wrong <= 0.15 * 400
    assert q.choose(np.zeros(48), np.arange(48), 5000, 48, 0.01, 0.01) == 47
    assert q.choose(np.zeros(48), np.arange(48), 20, 48, 0.01, 0.01) is None
    for k, n, d in ((0, 150, 0.0125), (3, 400, 0.05)):
        assert math.isclose(q.binomial_tail(k, n, q.upper_bound(k, n, d)), d, rel_tol=1e-6)


def test_path_takes_cheap_steps_first_and_none_without_bad_documents():
    places = len(q.GRID) + 1
    bad, other = np.zeros((6, places)), np.zeros((6, places))
    bad[:, -1], other[:, -1] = 10, 100
    bad[0, [10, 20, -1]], bad[3, [5, -1]] = (2, 3, 5), (4, 6)
    other[3, [5, -1]] = 50, 50
    assert q.path(bad, other, 90) == [(0, 10), (0, 20), (3, 5)]
    assert q.path(bad, other * 0, 90) == [(3, 5), (0, 10), (0, 20)]
    assert q.path(bad * 0, other, 90) == []


def measured_rows(spark, seed):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for d in range(1800):
        lang, good = ("en", "fr", "de")[int(rng.integers(0, 10)) // 4 if d % 7 else 2], bool(rng.random() < 0.8)
        upper = int(rng.integers(0, 40) if good else rng.integers(20, 100))
        marks = int(rng.integers(0, 10) if good else rng.integers(0, 60))
        rows.append((d, lang, 100, 500, 0, 5, 0, 0, upper * 5, marks, 3))
        if d % 2:
            labels.append((d, int(good)))
    found = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in q.COLUMNS))
    return rows, dict(labels), found, spark.createDataFrame(labels, "doc_id long, quality int")


def test_thresholds_and_verdicts_equal_brute_force(spark):
    """The path, its exact counts, the tests and the choice, over again in plain Python."""
    rows, truth, found, labels = measured_rows(spark, 5)
    names = list(q.ratios())
    want = {}

    def shares(r):
        n_words, word_chars, n_symbols, n_lines, n_dup, n_rep, n_upper, n_marks, n_top = r[2:]
        return [n_symbols / word_chars, n_dup / n_lines, n_rep / n_words, n_upper / word_chars, n_marks / n_words, n_top / n_words]

    strata = {r[1] for r in rows}
    for lang in strata:
        own = [(truth.get(r[0]), shares(r)) for r in rows if r[1] == lang]
        good, bad, other = ([x for t, x in own if t == v] for v in (1, 0, None))
        steps = []
        for r in range(6):
            worst, before = 0.0, 0
            for k, c in enumerate(q.GRID):
                caught = sum(x[r] > c for x in bad)
                cost = sum(x[r] > c for x in other) / len(other) - caught / (len(bad) + len(good))
                worst = max(worst, cost)
                if caught > before:
                    steps.append((round(worst, 9), k, r))
                before = caught
        cuts, best, chosen = {}, 0.0, {}
        for _, k, r in sorted(steps):
            cuts[r] = q.GRID[k]
            lost, caught = (sum(any(x[i] > c for i, c in cuts.items()) for x in part) for part in (good, bad))
            tail = sum(math.comb(len(good), i) * q.ALPHA**i * (1 - q.ALPHA) ** (len(good) - i) for i in range(lost + 1))
            if lost > q.ALPHA * len(good) or tail > q.DELTA / len(strata):
                break
            gain = caught / len(bad) - q.CARE * lost / len(good)
            if gain > best + 1e-12:
                best, chosen = gain, dict(cuts)
        want |= {(lang, names[r]): c for r, c in chosen.items()}
    got = q.thresholds(found, labels).collect()
    assert want and {(x.stratum, x.rule): x.cutoff for x in got} == want
    assert all(x.good_lost <= q.ALPHA * x.n_good and x.risk <= q.ALPHA for x in got)


def test_a_stratum_of_150_good_labels_gets_rules(spark):
    rows, labels = [], []
    for s, lang in enumerate(("en", "fr", "de", "es")):
        for i in range(250):
            d, good = s * 1000 + i, i < 170
            rows.append((d, " ".join((f"word{d}x{k}" if good else f"W{d}{k}##$$%%") for k in range(40)), lang))
            if i < 150 or 170 <= i < 200:
                labels.append((d, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {x.stratum for x in q.thresholds(q.measured(docs), marks).collect()} == {"en", "fr", "de", "es"}
    assert all(x.kept == (x.doc_id % 1000 < 170) for x in q.judge(docs.withColumns({c: docs.doc_id for c in ("kept", "stratum", "good", "levels", "n_words")}), marks).collect())


def test_rules_catch_what_labels_call_bad(spark):
    good = [(i, f"en words of text number {i} " + " ".join(f"w{(i * 7 + k) % 997}" for k in range(40)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"W{i}{k}###$$$" for k in range(40)), "en") for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good] + [(d, 0) for d, *_ in bad[:30]], "doc_id long, quality int")
    rows = q.judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id < 5000) for r in rows)
