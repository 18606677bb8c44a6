"""Queries over scored pairs: decoding, tuning, metrics, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators import decode, metrics, sampling
from linkweave.plans import fixtures as fx

CUT, FLOOR = 0.5, 0.55


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def exclusive_assign(spark, sf):
    return _rounded(decode.exclusive(fx.scored_pairs(spark, sf)), "prob").select("s1_id", "cand_id", "source", "prob")


def threshold_select(spark, sf):
    return _rounded(decode.select_threshold(fx.scored_pairs(spark, sf), CUT), "prob").select("s1_id", "cand_id", "prob")


def expected_f_select(spark, sf):
    return _long(_rounded(decode.select_expected_f(fx.scored_pairs(spark, sf), FLOOR), "prob"), "k").select("s1_id", "cand_id", "prob", "k")


def match_lists(spark, sf):
    lists = decode.match_lists(decode.select_threshold(fx.scored_pairs(spark, sf), CUT))
    return lists.select("s1_id", F.array_join("matches", ",").alias("matches"))


def _scores(spark, sf, decoder="threshold", cut=CUT):
    pairs = fx.scored_pairs(spark, sf)
    return decode.per_entity(fx.entities(spark, sf), fx.truth(pairs), decode.select_with(pairs, decoder, cut))


def f05_per_entity(spark, sf):
    return _rounded(_scores(spark, sf), "f05").select("s1_id", "n_true", "n_pred", "tp", "f05")


def macro_f05_by_country(spark, sf):
    return _rounded(metrics.by_country(_scores(spark, sf), fx.entities(spark, sf)), "f05")


def expected_f_macro(spark, sf):
    return _rounded(metrics.by_country(_scores(spark, sf, "expected_f", FLOOR), fx.entities(spark, sf)), "f05")


def _grid(spark, sf, kept, grid):
    pairs = fx.scored_pairs(spark, sf)
    return decode.grid_scores(fx.entities(spark, sf), fx.truth(pairs), kept(pairs), grid)


def tune_threshold_grid(spark, sf):
    return _long(_rounded(_grid(spark, sf, decode.exclusive, decode.THRESHOLD_GRID), "f05"), "point")


def tune_expected_f_grid(spark, sf):
    return _long(_rounded(_grid(spark, sf, decode.expected_f_pairs, decode.FLOOR_GRID), "f05"), "point")


def plateau_middle(spark, sf):
    return _long(_rounded(decode.plateau_middle(_grid(spark, sf, decode.exclusive, decode.THRESHOLD_GRID)), "f05"), "point")


def blocking_report(spark, sf):
    pairs = fx.scored_pairs(spark, sf)
    report = metrics.blocking_report(fx.entities(spark, sf), fx.truth(pairs), pairs.where("prob >= 0.3"), fx.targets(spark, sf).count())
    return _rounded(_long(report, "n_pairs"), "pair_recall", "f05_ceiling", "avg_candidates", "reduction_ratio")


def output_check(spark, sf):
    """Matches are taken with parts and orders missing and a cut below the candidates', so that rules are broken."""
    pairs = fx.scored_pairs(spark, sf)
    known = fx.entities(spark, sf).where("s1_id % 97 <> 0")
    return metrics.output_check(known, fx.targets(spark, sf).where("cand_id % 89 <> 0"), pairs.where("prob >= 0.45"), pairs.where("prob >= 0.5"))


def write_pairs_rows(spark, sf):
    from linkweave.sources.tsv import pair_rows

    return pair_rows(fx.entities(spark, sf).select("s1_id"), decode.select_threshold(fx.scored_pairs(spark, sf), CUT), "matched_entity_ids")


def error_dump(spark, sf):
    pairs = fx.scored_pairs(spark, sf)
    scored = pairs.where("prob >= 0.2")
    return _rounded(metrics.error_dump(fx.truth(pairs), decode.select_threshold(scored, CUT), scored), "prob")


def match_summary(spark, sf):
    chosen = decode.select_threshold(fx.scored_pairs(spark, sf), CUT)
    return _rounded(metrics.match_summary(fx.entities(spark, sf), chosen), "share_matched", "mean_matches")


def baseline_delta(spark, sf):
    return _rounded(metrics.baseline_delta(_scores(spark, sf), _scores(spark, sf, cut=0.6), fx.entities(spark, sf)), "gain")


def bootstrap_gain(spark, sf):
    mean, low, high = metrics.paired_bootstrap(_scores(spark, sf, cut=0.6), _scores(spark, sf))
    return spark.createDataFrame([(mean, low, high)], "gain double, low double, high double")


def links_histogram(spark, sf):
    return _long(metrics.links_histogram(fx.entities(spark, sf), fx.truth(fx.scored_pairs(spark, sf))), "links", "n")


def truth_report(spark, sf):
    pairs = fx.scored_pairs(spark, sf)
    report = metrics.truth_report(fx.entities(spark, sf), fx.targets(spark, sf), fx.truth(pairs))
    return _rounded(report, "singletons", "mean_links", "targets_linked")


def binary_report(spark, sf):
    return _rounded(metrics.binary_report(fx.scored_pairs(spark, sf)), "log_loss", "accuracy", "auc")


def fold_assign(spark, sf):
    return sampling.assign_folds(fx.entities(spark, sf).select("s1_id"))


def disjoint_samples(spark, sf):
    ids = fx.entities(spark, sf).select("s1_id")
    return sampling.disjoint_samples(ids, {"A": 100, "B": 300, "C": 200}).where("sample is not null")


def hide_fraction(spark, sf):
    pairs, n = fx.scored_pairs(spark, sf), fx.entities(spark, sf).count()
    h = sampling.hide_fraction(n, pairs.where("source = 2").count(), n, pairs.count())
    return spark.createDataFrame([(round(h, 6),)], "hide_fraction double")


def hide_entities(spark, sf):
    ids = fx.entities(spark, sf)
    hidden = sampling.disjoint_samples(ids.select("s1_id"), {"seen": 100, "hidden": 50}).where("sample = 'hidden'")
    return sampling.hide(ids, hidden)


def logit_mean(spark, sf):
    from linkweave.plans.models import logit, mean_probability

    pairs = fx.scored_pairs(spark, sf).withColumn("p2", F.col("prob") * F.col("prob"))
    mean = mean_probability(["prob", "p2"])
    return pairs.select("s1_id", "cand_id", F.round(logit(F.col("prob")), 6).alias("logit"), F.round(mean, 6).alias("mean"))


def band_mask(spark, sf):
    from linkweave.plans.models import in_band

    pairs = fx.scored_pairs(spark, sf)
    return pairs.select("s1_id", "cand_id", in_band(F.col("prob"), 0.1, 0.9).alias("scored"))


def incremental_score(spark, sf):
    from linkweave.plans.models import score_missing

    pairs = fx.scored_pairs(spark, sf).select("s1_id", "cand_id", "prob")
    old = pairs.where("cand_id % 3 = 0").select("s1_id", "cand_id", (F.col("prob") + 1).alias("ce"))
    out = score_missing(pairs, old, lambda df: df.select("s1_id", "cand_id", (-F.col("prob")).alias("ce")), "ce", 0.1, 0.9)
    return _rounded(out, "ce").select("s1_id", "cand_id", "ce")


QUERIES = {f.__name__: f for f in (exclusive_assign, threshold_select, expected_f_select, match_lists, f05_per_entity, macro_f05_by_country, expected_f_macro, tune_threshold_grid, tune_expected_f_grid, plateau_middle, blocking_report, output_check, write_pairs_rows, error_dump, match_summary, baseline_delta, bootstrap_gain, links_histogram, truth_report, binary_report, fold_assign, disjoint_samples, hide_fraction, hide_entities, logit_mean, band_mask, incremental_score)}

_E = f"WITH {fx.PAIRS_SQL}, {fx.EXCLUSIVE_SQL}"
_SEL = "sel AS (SELECT * FROM excl WHERE prob >= 0.5)"
_C = f"{_E}, {_SEL}, {fx.counts_sql('c', 'sel')}"
_BY = "GROUP BY ROLLUP (country)"
_HASH = "CAST(('0x' || SUBSTR(MD5('42|' || CAST(s1_id AS VARCHAR)), 1, 8)) AS BIGINT)"


def _grid_sql(base: str, points: int, first: float, step: float) -> str:
    return f"""grid AS (SELECT i + 1 AS point, CAST(ROUND({first} + {step} * i, 2) AS DOUBLE) AS cut FROM RANGE({points}) t(i)),
g AS (SELECT point, cut, s1_id, COUNT(*) AS n, COUNT(u.cand_id) AS tp FROM grid JOIN {base} q ON q.prob >= cut
  LEFT JOIN truth u USING (s1_id, cand_id) GROUP BY 1, 2, 3),
nt AS (SELECT e.s1_id, COUNT(t.cand_id) AS n_true FROM entities e LEFT JOIN truth t USING (s1_id) GROUP BY 1),
scores AS (SELECT point, cut, AVG(CASE WHEN n_true = 0 AND n IS NULL THEN 1.0 WHEN COALESCE(tp, 0) = 0 THEN 0.0
  ELSE 1.25 * tp / (0.25 * n_true + n) END) AS f05
  FROM (SELECT grid.point, grid.cut, nt.s1_id, n_true, n, tp FROM grid CROSS JOIN nt LEFT JOIN g ON g.point = grid.point AND g.s1_id = nt.s1_id) GROUP BY 1, 2)"""


ORACLE_SQL = {
    "exclusive_assign": f"{_E} SELECT s1_id, cand_id, source, ROUND(prob, 6) AS prob FROM excl",
    "threshold_select": f"{_E} SELECT s1_id, cand_id, ROUND(prob, 6) AS prob FROM excl WHERE prob >= 0.5",
    "expected_f_select": f"{_E}, {fx.EXPECTED_SQL} SELECT s1_id, cand_id, ROUND(prob, 6) AS prob, k FROM ef WHERE prob >= 0.55",
    "match_lists": f"{_E} SELECT s1_id, STRING_AGG(CAST(cand_id AS VARCHAR), ',' ORDER BY prob DESC, cand_id) AS matches FROM excl WHERE prob >= 0.5 GROUP BY 1",
    "f05_per_entity": f"{_C} SELECT s1_id, n_true, n_pred, tp, ROUND(f05, 6) AS f05 FROM c",
    "macro_f05_by_country": f"{_C} SELECT country, COUNT(*) AS n, ROUND(AVG(f05), 6) AS f05 FROM c {_BY}",
    "expected_f_macro": f"{_E}, {fx.EXPECTED_SQL}, sel AS (SELECT * FROM ef WHERE prob >= 0.55), {fx.counts_sql('c', 'sel')} SELECT country, COUNT(*) AS n, ROUND(AVG(f05), 6) AS f05 FROM c {_BY}",
    "tune_threshold_grid": f"{_E}, {_grid_sql('excl', 91, 0.05, 0.01)} SELECT point, cut, ROUND(f05, 6) AS f05 FROM scores",
    "tune_expected_f_grid": f"{_E}, {fx.EXPECTED_SQL}, {_grid_sql('ef', 13, 0.30, 0.05)} SELECT point, cut, ROUND(f05, 6) AS f05 FROM scores",
    "plateau_middle": f"""{_E}, {_grid_sql('excl', 91, 0.05, 0.01)}, near AS (SELECT *, ROW_NUMBER() OVER (ORDER BY point) - 1 AS pos, COUNT(*) OVER () AS n
      FROM scores WHERE f05 >= (SELECT MAX(f05) FROM scores) - 1e-6) SELECT point, cut, ROUND(f05, 6) AS f05 FROM near WHERE pos = n // 2""",
    "blocking_report": f"""WITH {fx.PAIRS_SQL}, cand AS (SELECT * FROM pairs WHERE prob >= 0.3), {fx.counts_sql('c', 'cand')}
      SELECT ROUND(SUM(tp) / SUM(n_true), 6) AS pair_recall, ROUND(AVG(CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + tp) END), 6) AS f05_ceiling,
      ROUND(AVG(n_pred), 6) AS avg_candidates, CAST(SUM(n_pred) AS BIGINT) AS n_pairs,
      ROUND(1 - SUM(n_pred) / (COUNT(*) * (SELECT COUNT(*) FROM part)), 6) AS reduction_ratio FROM c""",
    "output_check": f"""WITH {fx.PAIRS_SQL}, e AS (SELECT s1_id FROM entities WHERE s1_id % 97 <> 0), t AS (SELECT p_partkey AS cand_id FROM part WHERE p_partkey % 89 <> 0),
      m AS (SELECT * FROM pairs WHERE prob >= 0.45), c AS (SELECT * FROM pairs WHERE prob >= 0.5)
      SELECT 'duplicate_s1' AS rule, COUNT(*) AS n FROM (SELECT s1_id FROM e GROUP BY 1 HAVING COUNT(*) > 1)
      UNION ALL SELECT 'match_unknown_s1', COUNT(*) FROM m WHERE s1_id NOT IN (SELECT s1_id FROM e)
      UNION ALL SELECT 'match_unknown_target', COUNT(*) FROM m WHERE cand_id NOT IN (SELECT cand_id FROM t)
      UNION ALL SELECT 'candidate_unknown_s1', COUNT(*) FROM c WHERE s1_id NOT IN (SELECT s1_id FROM e)
      UNION ALL SELECT 'candidate_unknown_target', COUNT(*) FROM c WHERE cand_id NOT IN (SELECT cand_id FROM t)
      UNION ALL SELECT 'match_not_candidate', COUNT(*) FROM m ANTI JOIN c USING (s1_id, cand_id)""",
    "write_pairs_rows": f"""{_E}, {_SEL} SELECT e.s1_id, COALESCE(STRING_AGG(CAST(cand_id AS VARCHAR), ',' ORDER BY prob DESC, cand_id), '') AS matched_entity_ids
      FROM entities e LEFT JOIN sel USING (s1_id) GROUP BY 1""",
    "error_dump": f"""WITH {fx.PAIRS_SQL.replace('), \ntruth', '),\ntruth')}, scored AS (SELECT * FROM pairs WHERE prob >= 0.2),
      sel AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM scored) WHERE rk = 1 AND prob >= 0.5),
      err AS (SELECT s1_id, cand_id, 'FP' AS type FROM sel ANTI JOIN truth USING (s1_id, cand_id) UNION ALL SELECT s1_id, cand_id, 'FN' FROM truth ANTI JOIN sel USING (s1_id, cand_id))
      SELECT s1_id, cand_id, type, ROUND(prob, 6) AS prob FROM err LEFT JOIN scored USING (s1_id, cand_id)""",
    "match_summary": f"{_C} SELECT country, COUNT(*) AS entities, ROUND(AVG(CASE WHEN n_pred > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_matched, ROUND(AVG(n_pred), 6) AS mean_matches FROM c GROUP BY 1",
    "baseline_delta": f"""{_C}, sel2 AS (SELECT * FROM excl WHERE prob >= 0.6), {fx.counts_sql('d', 'sel2')}
      SELECT c.country, COUNT(*) AS n, ROUND(AVG(c.f05 - d.f05), 6) AS gain FROM c JOIN d USING (s1_id) GROUP BY ROLLUP (c.country)""",
    "links_histogram": f"WITH {fx.PAIRS_SQL} SELECT links, COUNT(*) AS n FROM (SELECT e.s1_id, COUNT(t.cand_id) AS links FROM entities e LEFT JOIN truth t USING (s1_id) GROUP BY 1) GROUP BY 1",
    "truth_report": f"""WITH {fx.PAIRS_SQL}, per AS (SELECT e.s1_id, COUNT(t.cand_id) AS m FROM entities e LEFT JOIN truth t USING (s1_id) GROUP BY 1),
      tw AS (SELECT p_partkey, COUNT(t.cand_id) AS m FROM part LEFT JOIN truth t ON p_partkey = t.cand_id GROUP BY 1)
      SELECT CAST((SELECT SUM(m) FROM per) AS BIGINT) AS links, ROUND((SELECT AVG(CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END) FROM per), 6) AS singletons,
      ROUND((SELECT AVG(m) FROM per), 6) AS mean_links, (SELECT MAX(m) FROM per) AS max_links, (SELECT COUNT(*) FROM tw WHERE m > 1) AS linked_twice,
      ROUND((SELECT AVG(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) FROM tw), 6) AS targets_linked""",
    "binary_report": f"""WITH {fx.PAIRS_SQL}, q AS (SELECT y, prob, LEAST(GREATEST(prob, 1e-6), 1 - 1e-6) AS p FROM pairs),
      r AS (SELECT prob, SUM(y) AS pos, SUM(1 - y) AS neg FROM q GROUP BY 1), s AS (SELECT pos, neg, SUM(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM r)
      SELECT COUNT(*) AS n, ROUND(AVG(-(y * LN(p) + (1 - y) * LN(1 - p))), 6) AS log_loss, ROUND(AVG(CASE WHEN (prob >= 0.5) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      ROUND((SELECT SUM(pos * (COALESCE(below, 0) + neg / 2)) / (SUM(pos) * SUM(neg)) FROM s), 6) AS auc FROM q""",
    "fold_assign": f"WITH {fx.PAIRS_SQL} SELECT s1_id, {_HASH} % 4 AS fold FROM entities",
    "disjoint_samples": f"""WITH {fx.PAIRS_SQL}, o AS (SELECT s1_id, ROW_NUMBER() OVER (ORDER BY {_HASH}, s1_id) AS n FROM entities)
      SELECT s1_id, CASE WHEN n <= 100 THEN 'A' WHEN n <= 400 THEN 'B' ELSE 'C' END AS sample FROM o WHERE n <= 600""",
    "hide_fraction": f"WITH {fx.PAIRS_SQL} SELECT ROUND(LEAST(GREATEST(1 - SUM(CASE WHEN source = 2 THEN 1 ELSE 0 END) / COUNT(*), 0.0), 0.5), 6) AS hide_fraction FROM pairs",
    "hide_entities": f"""WITH {fx.PAIRS_SQL}, o AS (SELECT s1_id, country, ROW_NUMBER() OVER (ORDER BY {_HASH}, s1_id) AS n FROM entities)
      SELECT s1_id, country FROM o WHERE n <= 100 OR n > 150""",
    "logit_mean": f"""WITH {fx.PAIRS_SQL}, q AS (SELECT s1_id, cand_id, LEAST(GREATEST(prob, 1e-6), 1 - 1e-6) AS a, LEAST(GREATEST(prob * prob, 1e-6), 1 - 1e-6) AS b FROM pairs)
      SELECT s1_id, cand_id, ROUND(LN(a) - LN(1 - a), 6) AS logit, ROUND(1 / (1 + EXP(-((LN(a) - LN(1 - a) + LN(b) - LN(1 - b)) / 2))), 6) AS mean FROM q""",
    "band_mask": f"WITH {fx.PAIRS_SQL} SELECT s1_id, cand_id, prob BETWEEN 0.1 AND 0.9 AS scored FROM pairs",
    "incremental_score": f"WITH {fx.PAIRS_SQL} SELECT s1_id, cand_id, ROUND(CASE WHEN cand_id % 3 = 0 THEN prob + 1 WHEN prob BETWEEN 0.1 AND 0.9 THEN -prob END, 6) AS ce FROM pairs",
}
