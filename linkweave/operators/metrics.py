"""Blocking quality, output checks, reports and comparisons between runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.decode import f_score, per_entity


def macro_f05(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return per_entity(entities, truth, predicted).agg(F.avg("f05").alias("f05"))


def by_country(scores: DataFrame, countries: DataFrame) -> DataFrame:
    """country (null: all), n and f05; `scores` has s1_id and f05, `countries` s1_id and country."""
    return scores.join(countries, "s1_id").rollup("country").agg(F.count("*").alias("n"), F.avg("f05").alias("f05"))


def blocking_report(entities: DataFrame, truth: DataFrame, candidates: DataFrame, n_targets: int) -> DataFrame:
    """pair_recall, f05_ceiling, avg_candidates, n_pairs and reduction_ratio of a candidate set."""
    counts = per_entity(entities, truth, candidates)
    tp, n_true, n_pred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    sums = counts.agg(
        F.try_divide(F.sum(tp), F.sum(n_true)).alias("pair_recall"),
        F.avg(f_score(tp, tp, n_true)).alias("f05_ceiling"),
        F.avg(n_pred).alias("avg_candidates"),
        F.coalesce(F.sum(n_pred), F.lit(0)).alias("n_pairs"),
        F.count("*").alias("n"),
    )
    ratio = 1 - F.col("n_pairs") / F.greatest(F.col("n") * F.lit(n_targets), F.lit(1))
    return sums.withColumn("reduction_ratio", ratio).drop("n")


def output_check(entities: DataFrame, targets: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """rule and n: how often each rule of an output is broken; rules that hold have 0."""
    ids, known = entities.select("s1_id"), targets.select("cand_id")
    pair = ["s1_id", "cand_id"]
    found = {
        "duplicate_s1": ids.groupBy("s1_id").count().where("count > 1"),
        "match_unknown_s1": matches.join(ids.distinct(), "s1_id", "left_anti"),
        "match_unknown_target": matches.join(known.distinct(), "cand_id", "left_anti"),
        "candidate_unknown_s1": candidates.join(ids.distinct(), "s1_id", "left_anti"),
        "candidate_unknown_target": candidates.join(known.distinct(), "cand_id", "left_anti"),
        "match_not_candidate": matches.join(candidates.select(*pair).distinct(), pair, "left_anti"),
    }
    parts = [df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n")) for rule, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_dump(truth: DataFrame, predicted: DataFrame, scored: DataFrame) -> DataFrame:
    """s1_id, cand_id, type (FP or FN) and prob, null where blocking lost the pair."""
    pair = ["s1_id", "cand_id"]
    wrong = predicted.select(*pair).join(truth.select(*pair), pair, "left_anti").withColumn("type", F.lit("FP"))
    missed = truth.select(*pair).join(predicted.select(*pair), pair, "left_anti").withColumn("type", F.lit("FN"))
    return wrong.unionByName(missed).join(scored.select(*pair, "prob"), pair, "left")


def match_summary(entities: DataFrame, predicted: DataFrame) -> DataFrame:
    """country, entities, share with a match and mean matches; `entities` has s1_id and country."""
    n = predicted.groupBy("s1_id").agg(F.count("*").alias("m"))
    rows = entities.join(n, "s1_id", "left").na.fill(0, ["m"])
    return rows.groupBy("country").agg(F.count("*").alias("entities"), F.avg((F.col("m") > 0).cast("double")).alias("share_matched"), F.avg("m").alias("mean_matches"))


def baseline_delta(scores: DataFrame, baseline: DataFrame, countries: DataFrame) -> DataFrame:
    """country (null: all), n and mean gain over the entities that both runs scored."""
    both = scores.select("s1_id", "f05").join(baseline.select("s1_id", F.col("f05").alias("base")), "s1_id")
    return both.join(countries, "s1_id").rollup("country").agg(F.count("*").alias("n"), F.avg(F.col("f05") - F.col("base")).alias("gain"))


def paired_bootstrap(scores: DataFrame, baseline: DataFrame, draws: int = 1000, seed: int = 0) -> tuple[float, float, float]:
    """Mean gain and its 95 % interval over resampled entities.

    Gains take few distinct values, so entities are resampled as a multinomial over value counts (rounded to 1e-12).
    """
    both = scores.select("s1_id", "f05").join(baseline.select("s1_id", F.col("f05").alias("base")), "s1_id")
    counts = both.groupBy(F.round(F.col("f05") - F.col("base"), 12).alias("d")).count().orderBy("d").collect()
    if not counts:
        return float("nan"), float("nan"), float("nan")
    d, n = np.array([r["d"] for r in counts]), np.array([r["count"] for r in counts])
    means = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), draws) @ d / n.sum()
    low, high = np.percentile(means, [2.5, 97.5])
    return float((d * n).sum() / n.sum()), float(low), float(high)


def accepts(scores: DataFrame, baseline: DataFrame, countries: DataFrame) -> bool:
    """A change counts if the interval of its gain is above zero and no country loses."""
    _, low, _ = paired_bootstrap(scores, baseline)
    worst = baseline_delta(scores, baseline, countries).where("country is not null").agg(F.min("gain")).first()[0]
    return low > 0 and (worst or 0) >= 0


def links_histogram(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """links and n: how many entities have so many links, singletons included."""
    n = truth.groupBy("s1_id").agg(F.count("*").alias("links"))
    return entities.select("s1_id").join(n, "s1_id", "left").na.fill(0, ["links"]).groupBy("links").agg(F.count("*").alias("n"))


def record_counts(records: DataFrame) -> DataFrame:
    """source, country, records, and shares of empty addresses, non-Latin names and postal codes."""
    share = lambda c: F.avg(c.cast("double"))
    return records.groupBy("source", "country").agg(F.count("*").alias("records"), share(F.col("addr_clean") == "").alias("empty_address"), share(F.col("name_nonlatin")).alias("nonlatin_name"), share(F.col("postal") != "").alias("with_postal"))


def truth_report(entities: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: links, share of singletons, mean and largest number of links, candidates linked twice, share linked."""
    per = entities.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("m")), "s1_id", "left").na.fill(0, ["m"])
    a = per.agg(F.sum("m").alias("links"), F.avg((F.col("m") == 0).cast("double")).alias("singletons"), F.avg("m").alias("mean_links"), F.max("m").alias("max_links"))
    twice = truth.groupBy("cand_id").agg(F.count("*").alias("m"))
    b = targets.select("cand_id").join(twice, "cand_id", "left").agg(F.sum((F.col("m") > 1).cast("long")).alias("linked_twice"), F.avg(F.col("m").isNotNull().cast("double")).alias("targets_linked"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def agreement(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Over true pairs: how often country and name_core agree, both have a postal code, and those agree."""
    a = left.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in ("country", "name_core", "postal")])
    b = right.select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"b_{c}") for c in ("country", "name_core", "postal")])
    rows = truth.join(a, "s1_id").join(b, "cand_id")
    both = (F.col("a_postal") != "") & (F.col("b_postal") != "")
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(F.count("*").alias("pairs"), share(F.col("a_country") == F.col("b_country")).alias("same_country"), share(F.col("a_name_core") == F.col("b_name_core")).alias("same_name"), share(both).alias("both_postal"), share(F.when(both, F.col("a_postal") == F.col("b_postal"))).alias("same_postal"))


def binary_report(scored: DataFrame) -> DataFrame:
    """n, log_loss, accuracy and auc of prob against y; ties count half in the area, computed from rank sums per prob."""
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col("y").cast("double")
    per = scored.groupBy("prob").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum(-(y * F.log(p) + (1 - y) * F.log1p(-p))).alias("loss"), F.sum(((F.col("prob") >= 0.5) == (F.col("y") > 0)).cast("double")).alias("right"))
    # ranges of prob are summed first, so that no single window holds every distinct value
    span = F.floor(F.col("prob") * 4096).cast("int")
    from pyspark.sql import Window

    ranges = per.groupBy(span.alias("span")).agg(F.sum("neg").alias("n"))
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("span", F.coalesce(F.sum("n").over(upto), F.lit(0.0)).alias("below"))
    inside = Window.partitionBy("span").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumn("span", span).join(F.broadcast(ranges), "span")
    wins = F.col("pos") * (F.col("below") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0)) + F.col("neg") / 2)
    s = rows.withColumn("wins", wins).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "loss", "right", "wins")])
    n = F.col("pos") + F.col("neg")
    return s.select(n.cast("long").alias("n"), F.try_divide(F.col("loss"), n).alias("log_loss"), F.try_divide(F.col("right"), n).alias("accuracy"), F.try_divide(F.col("wins"), F.col("pos") * F.col("neg")).alias("auc"))
