"""Operator 7, quality rules with risk-controlled thresholds.

A pass over the texts takes measures of every document. A rule rejects what is above its cutoff in a ratio made of
them. Every stratum (language) walks one path of joint rule sets: each step makes one rule's cutoff one place of a fixed
grid stricter, or more where nothing bad lies between. The path is laid by documents that are not tested on it: what a
cutoff drops of the stratum's unlabelled documents, less the share of bad ones it should hold by the bad labels, is its
cost, and cheap steps come first. The good labelled documents of the stratum are the holdout. A step is certified while
the exact binomial test rejects that its rules together drop more than ALPHA of the good documents, and the walk ends at
the first that fails (fixed-sequence testing, so the walk needs no correction). Strata are corrected by Bonferroni, so
that with confidence 1 - DELTA no stratum loses more than ALPHA. Among certified steps the one is used that best parts
bad from good; without one the rules reject nothing. Four strata need some 144 good labels in each for that.

Labels are grouped by doc_id (the lowest quality counts) and only counts by stratum, rule and grid place, or by stratum
and step, are gathered.
Defined results: null text has no words and fails the base; a null language is a stratum of its own; repeated rows
are judged each for itself; steps of equal cost go by the grid's place, then the rule's name; without unlabelled documents
all cost the same; without labels only the base rejects; a text of any length is measured whole; other columns stay out;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common, simhash

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ALPHA, DELTA = 0.03, 0.05
#: Good documents lost weigh this much more than bad ones caught where a cutoff is picked among the certified.
CARE = 5.0
#: Cutoffs from lenient to strict.
GRID = [round(0.96 - 0.02 * k, 2) for k in range(48)]
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
_UPPER = bytes(range(65, 91))
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _places(words: list[bytes]) -> np.ndarray:
    places: dict[bytes, int] = {}
    return np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Places in windows (a power of two of words) that occur twice or more; `ids` numbers equal words alike."""
    if len(ids) <= window:
        return 0
    n = len(ids) - window + 1
    code = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += code[k : k + n] * _MIX[k]
    by_hash = np.sort(mixed)
    if not (by_hash[1:] == by_hash[:-1]).any():  # equal windows have equal hashes
        return 0
    key, width = ids, 1
    while width < window:  # windows of twice the width, numbered exactly
        key = np.unique(key[:-width] * (int(key.max()) + 1) + key[width:], return_inverse=True)[1]
        width *= 2
    again = np.bincount(key)[key] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks, n_top_word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    ids = _places(words)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(raw) - len(raw.translate(None, _UPPER)),
        text.count("!"),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_top_word")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the measures of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"))

    def run(batch):
        found = np.array([measures(t) for t in common.texts_of(batch)], np.int64)
        return common.rebatch(doc_id=batch.column(0), stratum=batch.column(2), **{c: pa.array(found[:, k]) for k, c in enumerate(COLUMNS)})

    return common.map_batches(rows, run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COLUMNS))


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def ratios() -> dict:
    """What the rules hold against their cutoffs."""
    return {
        "symbols": _ratio("n_symbols", "word_chars"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "repeat_words": _ratio("n_repeat_words", "n_words"),
        "upper": _ratio("n_upper", "word_chars"),
        "marks": _ratio("n_marks", "n_words"),
        "top_word": _ratio("n_top_word", "n_words"),
    }


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest share that k of n does not speak against at level `delta`, by bisection of the exact tail."""
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def path(bad: np.ndarray, other: np.ndarray, n_good: int) -> list[tuple[int, int]]:
    """Steps (rule, grid place) of a stratum in the order they are taken.

    bad[r, k] and other[r, k] are the bad and the unlabelled documents whose first cutoff of rule r that rejects them is
    GRID[k]; the last column counts those that none does.
    """
    n_bad, n_other = int(bad[0].sum()), int(other[0].sum())
    if not n_bad:
        return []
    bad_share = np.cumsum(bad, 1) / n_bad
    share = np.cumsum(other, 1) / max(1, n_other) - bad_share * n_bad / (n_bad + n_good)
    cost = np.maximum.accumulate(np.maximum(share, 0.0), 1) * (n_other > 0)
    steps = [(round(float(cost[r, k]), 9), k, r) for r, k in np.argwhere(bad[:, : len(GRID)] > 0).tolist()]
    return [(r, k) for _, k, r in sorted(steps)]


def choose(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int, alpha: float, delta: float) -> int | None:
    """The step whose rule set is used: good[i], bad[i] documents are rejected by step i or one before it."""
    best, step = 0.0, None
    for i in range(len(good)):
        if not n_good or good[i] > alpha * n_good or binomial_tail(int(good[i]), n_good, alpha) > delta:
            break
        gain = bad[i] / max(1, n_bad) - CARE * good[i] / n_good
        if gain > best + 1e-12:
            best, step = gain, i
    return step


def thresholds(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule and cutoff of the chosen rule sets, with the labels each set was certified by.

    n_good and good_lost, n_bad and bad_caught are of the whole set; risk is the upper bound of its share of good ones.
    """
    rules, places = ratios(), len(GRID)
    names = list(rules)
    truth = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    level = lambda r: F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: c >= r))
    judged = found.where(~base_failed()).select("doc_id", "stratum", F.array(*map(level, rules.values())).alias("levels")).join(truth, "doc_id", "left")
    judged = common.materialize(judged.select("stratum", "good", "levels"), "levels")
    each = judged.select("stratum", "good", F.posexplode("levels").alias("rule", "place")).groupBy("stratum", "good", "rule", "place").agg(F.count("*").alias("n"))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        bad, other, n_good = np.zeros((len(names), places + 1)), np.zeros((len(names), places + 1)), 0
        for good, rule, place, n in zip(pdf["good"], pdf["rule"], pdf["place"], pdf["n"], strict=True):
            if pd.isna(good):
                other[rule, place] += n
            elif not good:
                bad[rule, place] += n
            elif rule == 0:
                n_good += n
        steps = path(bad, other, int(n_good))
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "steps": [[r * places + k for r, k in steps]]}, dtype=object)

    paths = each.groupBy("stratum").applyInPandas(lay, "stratum string, steps array<int>").where("size(steps) > 0")
    paths = common.materialize(paths, "paths")
    tests = max(1, paths.count())
    # the step that rejects a document is the first one at a place no laxer than the document's own; a last one catches the rest
    taken = f"transform(steps, y -> element_at(levels, int(y / {places}) + 1) <= y % {places})"
    first = F.array_position(F.concat(F.expr(taken), F.array(F.lit(True))), True) - 1
    counts = judged.where("good is not null").join(paths, "stratum").groupBy("stratum", "steps", "good", first.alias("step")).agg(F.count("*").alias("n"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = [divmod(int(x), places) for x in pdf["steps"].iloc[0]]
        lost, caught = np.zeros(len(steps) + 1, np.int64), np.zeros(len(steps) + 1, np.int64)
        for good, step, n in zip(pdf["good"], pdf["step"], pdf["n"], strict=True):
            (lost if good else caught)[step] += n
        n_good, n_bad = int(lost.sum()), int(caught.sum())
        lost, caught = np.cumsum(lost)[:-1], np.cumsum(caught)[:-1]
        i = choose(lost, caught, n_good, n_bad, alpha, delta / tests)
        strictest = dict(steps[: i + 1]) if i is not None else {}
        out = pd.DataFrame({"rule": [names[r] for r in strictest], "cutoff": [GRID[k] for k in strictest.values()]}, columns=["rule", "cutoff"]).astype({"rule": object, "cutoff": float})
        own = (n_good, int(lost[i]), n_bad, int(caught[i]), upper_bound(int(lost[i]), n_good, delta / tests)) if strictest else (0, 0, 0, 0, 0.0)
        return out.assign(stratum=pd.Series([pdf["stratum"].iloc[0]] * len(out), dtype=object), n_good=own[0], good_lost=own[1], n_bad=own[2], bad_caught=own[3], risk=own[4])

    return counts.groupBy("stratum").applyInPandas(pick, "stratum string, rule string, cutoff double, n_good long, good_lost long, n_bad long, bad_caught long, risk double")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, the measures, base_failed, failed (names of the rules that reject) and kept of every row."""
    rules = ratios()
    found = common.materialize(measured(docs), "measures")
    cutoffs = thresholds(found, labels, alpha, delta)
    wide = common.materialize(cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in rules]), "cutoffs")
    both = found.join(simhash.few_or_shuffled(wide), "stratum", "left")
    failed = F.filter(F.array(*[F.when(r > F.col(f"cut_{name}"), F.lit(name)) for name, r in rules.items()]), lambda x: x.isNotNull())
    out = both.withColumn("base_failed", base_failed()).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select("doc_id", "stratum", *COLUMNS, "base_failed", "failed", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
