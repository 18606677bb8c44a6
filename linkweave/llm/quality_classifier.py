"""Operator 2, quality classifier: document evidence under hierarchical empirical Bayes priors of sites.

Evidence: a logistic regression on measures of the text, fitted on at most SAMPLE distinct labelled rows (numbers only, weighted by copies), gives
p, the chance that a document is good. Sites: `source` is the host and `lang` the section below it, since documents
have no URL. Grouped sums of p give each host a mean that is shrunk to the mean of all, and each section one that is
shrunk to its host's; how strongly is estimated by moments (variance within groups over variance between them), so a
sparse site follows its parent and a rich one its own documents. A document's own p is left out of its section's sum.
The section's odds replace the odds of all documents as its prior: logit(score) = logit(p) + logit(section) -
logit(all). Documents with a score below THRESHOLD are rejected.

Defined results: null and empty texts have all measures zero; null hosts or sections are one of their own; a doc_id
with several labels is good if all say so; repeated rows count each for itself; without labels of both kinds p is 0.5
and all are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common, quality_rules, simhash
from linkweave.llm.toxicity import fit_logistic

SAMPLE = 50_000
THRESHOLD = 0.5
#: Prior strengths are held in these bounds, in documents.
STRENGTH = (2.0, 1e6)
EDGE = 1e-4
M = "__linkweave_m"


def with_measures(docs: DataFrame) -> DataFrame:
    """`docs` with the struct M of measures of its text."""
    @F.pandas_udf(", ".join(f"{c} long" for c in quality_rules.COLUMNS))
    def take(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([quality_rules.measures(t or "") for t in text], columns=list(quality_rules.COLUMNS), dtype="int64")

    return docs.withColumn(M, take(F.col("text").cast("string")))


def features() -> list:
    def ratio(a: str, b: str):
        return F.col(f"{M}.{a}") / F.greatest(F.col(f"{M}.{b}"), F.lit(1))

    words = F.col(f"{M}.n_words")
    return [
        ratio("n_symbols", "word_chars"),
        F.least(ratio("n_symbols", "n_words"), F.lit(3.0)),
        ratio("n_dup_lines", "n_lines"),
        ratio("n_repeat_words", "n_words"),
        ratio("n_upper", "word_chars"),
        F.least(ratio("n_marks", "n_words"), F.lit(3.0)),
        ratio("n_top_word", "n_words"),
        F.least(ratio("word_chars", "n_words"), F.lit(40.0)),
        F.log1p(words.cast("double")),
        (words < 20).cast("double"),
    ]


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the features and the intercept; None without labels of both kinds. `rows` has doc_id and M."""
    truth = labels.select(F.col("doc_id").cast("long").alias("__linkweave_id"), F.col("quality").cast("int").alias("__linkweave_y")).dropna()
    truth = truth.groupBy("__linkweave_id").agg(F.min("__linkweave_y").alias("__linkweave_y"))
    if truth.count() <= simhash.BROADCAST_ROWS:
        truth = F.broadcast(truth)
    own = rows.select(F.col("doc_id").cast("long").alias("__linkweave_id"), *[f.cast("double").alias(f"f{k}") for k, f in enumerate(features())])
    names = [f"f{k}" for k in range(len(features()))]
    found = common.sample_rows(own.join(truth, "__linkweave_id").select(*names, "__linkweave_y"), sample)
    x = np.array([list(map(float, r)) for r in found]).reshape(-1, len(names) + 2)
    x, y, copies = x[:, :-2], x[:, -2], x[:, -1]
    if not len(y) or y.min() == y.max():
        return None
    mean = np.average(x, 0, copies)
    spread = np.sqrt(np.average((x - mean) ** 2, 0, copies)) + 1e-9
    w = fit_logistic((x - mean) / spread, y, copies)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def evidence(weights: np.ndarray | None):
    """The column p: chance that a document is good, by its text alone."""
    if weights is None:
        return F.lit(0.5)
    logit = sum((f * float(v) for f, v in zip(features(), weights, strict=False)), F.lit(float(weights[-1])))
    return F.greatest(F.least(1 / (1 + F.exp(-logit)), F.lit(1 - EDGE)), F.lit(EDGE))


def strength(within: float, between: float) -> float:
    return float(np.clip(within / max(between, 1e-12), *STRENGTH))


def _moments(groups: DataFrame, parent, n, s, q) -> tuple[float, float]:
    """Variance of p within groups, and of groups' means around their parent's mean beyond what that explains."""
    mean = s / n
    r = groups.agg(F.sum(n), F.sum(q - n * mean * mean), F.count("*"), F.sum(n * (mean - parent) ** 2), F.sum(n * n)).first()
    total, inside, count, outside, squares = (float(x or 0) for x in r)
    within = max(inside, 0.0) / max(total - count, 1.0)
    return max(within, 1e-9), (outside - count * within) / max(total - squares / max(total, 1.0), 1.0)


def sites(rows: DataFrame) -> tuple[DataFrame, float, float]:
    """host, section, their sums, and the host's shrunk mean of every section; the mean of all; the sections' strength.

    `rows` has host, section and p.
    """
    sections = rows.groupBy("host", "section").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    sections = common.materialize(sections, "sections")
    hosts = sections.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    n, s = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    overall = float(s / n) if n else 0.5
    k_host = strength(*_moments(hosts, F.lit(overall), F.col("hn"), F.col("hs"), F.col("hq")))
    hosts = hosts.select("host", ((k_host * overall + F.col("hs")) / (k_host + F.col("hn"))).alias("host_rate"))
    both = common.materialize(sections.join(hosts, "host"), "sites")
    k_section = strength(*_moments(both, F.col("host_rate"), F.col("n"), F.col("s"), F.col("q")))
    return both.select("host", "section", "n", "s", "host_rate"), overall, k_section


def _logit(p):
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of `docs`, which has neither host nor section, but for M, with p, host_rate, section_rate, score and kept in the struct M."""
    rows = common.materialize(with_measures(docs), "measured")
    p = evidence(fit(rows, labels))
    host, section = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang"))
    known, overall, k = sites(rows.select(host.alias("host"), section.alias("section"), p.alias("p")))
    own = rows.withColumn("__linkweave_p", p).withColumn("__linkweave_host", host).withColumn("__linkweave_section", section)
    known = known.select(*[F.col(c).alias(f"__linkweave_{c}") for c in known.columns])
    if known.count() <= simhash.BROADCAST_ROWS // 10:
        known = F.broadcast(known)
    both = own.join(known, ["__linkweave_host", "__linkweave_section"])
    p, n, s, rate = (F.col(f"__linkweave_{c}") for c in ("p", "n", "s", "host_rate"))
    section_rate = F.greatest(F.least((k * rate + s - p) / (k + n - 1), F.lit(1 - EDGE)), F.lit(EDGE))
    overall = float(np.clip(overall, EDGE, 1 - EDGE))
    score = 1 / (1 + F.exp(-(_logit(p) + _logit(section_rate) - float(np.log(overall / (1 - overall))))))
    judged = F.struct(p.alias("evidence"), rate.alias("host_rate"), section_rate.alias("section_rate"), score.alias("score"), (score >= THRESHOLD).alias("kept"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], judged.alias(M))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, all columns kept."""
    return judge(docs, labels).where(F.col(f"{M}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = judge(docs, common.read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("section"), f"{M}.evidence", f"{M}.host_rate", f"{M}.section_rate", f"{M}.score", f"{M}.kept")
