import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from linkweave.llm import quality_classifier as qc

from . import helpers


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = pq.read_table(f"{sf}/labels.parquet")
    truth = dict(zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist(), strict=True))
    rows = qc.op2_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth]) > 0.95


def brute(rows):
    """Hierarchical shrinkage of (host, section, p) rows, and the scores."""
    p = np.array([r[2] for r in rows])
    overall = p.mean()

    def moments(groups, parents):
        n = np.array([len(g) for g in groups])
        mean = np.array([np.mean(g) for g in groups])
        within = max(sum(((np.array(g) - m) ** 2).sum() for g, m in zip(groups, mean, strict=True)) / max(n.sum() - len(n), 1), 1e-9)
        between = ((n * (mean - parents) ** 2).sum() - len(n) * within) / max(n.sum() - (n**2).sum() / n.sum(), 1)
        return qc.strength(within, between)

    hosts, sections = {}, {}
    for h, s, x in rows:
        hosts.setdefault(h, []).append(x)
        sections.setdefault((h, s), []).append(x)
    k = moments(list(hosts.values()), overall)
    rate = {h: (k * overall + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    k2 = moments(list(sections.values()), np.array([rate[h] for h, _ in sections]))
    logit = lambda x: np.log(x / (1 - x))
    out = []
    for h, s, x in rows:
        v = sections[h, s]
        own = np.clip((k2 * rate[h] + sum(v) - x) / (k2 + len(v) - 1), qc.EDGE, 1 - qc.EDGE)
        out.append(1 / (1 + np.exp(-(logit(x) + logit(own) - logit(overall)))))
    return out


def test_shrinkage_equals_brute_force(spark):
    rows = qc.op2_quality_classifier(spark, helpers.SF).collect()
    want = brute([(r.host, r.section, r.evidence) for r in rows])
    assert np.allclose([r.score for r in rows], want, atol=1e-9)


def test_sparse_sites_follow_their_parents(spark):
    rng = np.random.default_rng(4)
    rows = [(h, "s", float(np.clip(rng.normal(0.9 if h != "bad" else 0.2, 0.05), 0.01, 0.99))) for h in ["a", "b", "bad"] for _ in range(200)]
    rows += [("tiny", "s", 0.2)]
    known, overall, _ = qc.sites(spark.createDataFrame(rows, "host string, section string, p double"))
    rate = {r.host: r.host_rate for r in known.collect()}
    assert abs(rate["bad"] - 0.2) < 0.03 and abs(rate["a"] - 0.9) < 0.03
    assert abs(rate["tiny"] - overall) < abs(0.2 - overall)


def test_odd_rows_and_clashing_columns(spark):
    labels = spark.createDataFrame([(5, 0), (8, 1), (9, None), (None, 1), (10, 1)], "doc_id long, quality int")
    docs = helpers.odd(spark).withColumn("kept", F.lit(1)).withColumn("p", F.lit(2)).withColumn("section", F.lit("x"))
    for own in (labels, labels.limit(0)):
        kept = qc.keep_good(docs, own)
        assert kept.columns == docs.columns and kept.count() <= len(helpers.ODD)
        judged = qc.judge(docs, own)
        assert judged.count() == len(helpers.ODD)
    assert qc.keep_good(docs, labels.limit(0)).count() == len(helpers.ODD)
    assert qc.keep_good(helpers.empty(spark), labels).count() == 0
