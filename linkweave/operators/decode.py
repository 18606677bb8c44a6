"""From scored pairs to match lists: exclusive assignment, threshold and expected-F decoding, and tuning.

A pair frame has s1_id, cand_id and prob (and more); no pair occurs twice. Ties in prob go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: F-beta weights recall by beta squared; beta is 0.5.
BETA2 = 0.25
EDGE = 1e-6
TIE = 1e-12
PLATEAU = 1e-6
THRESHOLD_GRID = [round(0.05 + 0.01 * k, 2) for k in range(91)]
FLOOR_GRID = [round(0.30 + 0.05 * k, 2) for k in range(13)]


def exclusive(pairs: DataFrame) -> DataFrame:
    """Each candidate stays with the entity that scores it highest."""
    best = Window.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id")
    return pairs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def select_threshold(pairs: DataFrame, threshold: float, exclusively: bool = True) -> DataFrame:
    """Pairs at or above the cut-off; the assignment is made over all pairs, which the cut cannot change."""
    return (exclusive(pairs) if exclusively else pairs).where(F.col("prob") >= threshold)


def expected_f(pairs: DataFrame) -> DataFrame:
    """Pairs with k (place by falling prob), gain (expected F of the best k), p_empty and k_best of their entity."""
    ordered = Window.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id")
    whole = Window.partitionBy("s1_id")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.least(F.greatest(F.col("prob"), F.lit(EDGE)), F.lit(1 - EDGE))
    out = pairs.withColumns({"k": F.row_number().over(ordered), "_sum": F.sum("prob").over(upto), "_all": F.sum("prob").over(whole), "p_empty": F.exp(F.sum(F.log1p(-p)).over(whole))})
    out = out.withColumn("_f", (1 + BETA2) * F.col("_sum") / (BETA2 * F.col("_all") + F.col("k")))
    out = out.withColumn("gain", F.max("_f").over(whole))
    return out.withColumn("k_best", F.min(F.when(F.col("_f") >= F.col("gain") - TIE, F.col("k"))).over(whole)).drop("_sum", "_all", "_f")


def select_expected_f(pairs: DataFrame, floor: float, exclusively: bool = True) -> DataFrame:
    """Per entity the list with the best expected F; empty where no list beats predicting nothing."""
    out = expected_f(exclusive(pairs) if exclusively else pairs)
    return out.where((F.col("gain") > F.col("p_empty")) & (F.col("k") <= F.col("k_best")) & (F.col("prob") >= floor)).drop("gain", "p_empty", "k_best")


def select_with(pairs: DataFrame, decoder: str, cut: float, exclusively: bool = True) -> DataFrame:
    if decoder not in ("threshold", "expected_f"):
        raise ValueError(f"unknown decoder {decoder!r}")
    return (select_expected_f if decoder == "expected_f" else select_threshold)(pairs, cut, exclusively)


def match_lists(selected: DataFrame) -> DataFrame:
    """s1_id and matches: candidates by falling prob, for entities with any."""
    row = F.struct((-F.col("prob")).alias("p"), "cand_id")
    return selected.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cand_id"]).alias("matches"))


def f_score(tp, n_pred, n_true):
    """F0.5 from counts: one where both lists are empty, zero where nothing is right."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + BETA2) * tp / (BETA2 * n_true + n_pred))


def per_entity(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp and f05 of every entity of `entities`, those without links or predictions included.

    `truth` and `predicted` have s1_id and cand_id.
    """
    links = truth.select("s1_id", "cand_id", F.lit(1).alias("t"))
    both = links.join(predicted.select("s1_id", "cand_id", F.lit(1).alias("p")), ["s1_id", "cand_id"], "full")
    counts = both.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("t") + F.col("p")).alias("tp"))
    out = entities.select("s1_id").join(counts, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return out.withColumn("f05", f_score(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def grid_scores(entities: DataFrame, truth: DataFrame, pairs: DataFrame, grid: list[float]) -> DataFrame:
    """point, cut and f05: the macro score of predicting the pairs of `pairs` at or above each cut of a rising grid.

    An entity's score changes only where one of its pairs enters, so every pair adds one difference at its last
    point; the sums over the grid are over a row for each point, and no pair is repeated for the points.
    """
    last = F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c <= F.col("prob")))
    labelled = pairs.select("s1_id", "cand_id", last.alias("point")).where("point > 0")
    labelled = labelled.join(truth.select("s1_id", "cand_id", F.lit(1).alias("y")), ["s1_id", "cand_id"], "left")
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    known = entities.select("s1_id").join(n_true, "s1_id", "left").na.fill(0, ["n_true"])
    steps = labelled.groupBy("s1_id", "point").agg(F.count("*").alias("n"), F.count("y").alias("tp")).join(known, "s1_id")
    down = Window.partitionBy("s1_id").orderBy(F.desc("point"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"n": F.sum("n").over(upto), "tp": F.sum("tp").over(upto)})
    now = f_score(F.col("tp"), F.col("n"), F.col("n_true"))
    before = F.lag(now).over(down)
    nothing = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    change = steps.select("point", (now - F.coalesce(before, nothing)).alias("d")).groupBy("point").agg(F.sum("d").alias("d"))
    total = known.agg(F.count("*").alias("n"), F.sum(nothing).alias("s"))
    points = entities.sparkSession.createDataFrame([(k + 1, c) for k, c in enumerate(grid)], "point int, cut double")
    rising = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a point
    summed = points.join(F.broadcast(change), "point", "left").withColumn("d", F.sum(F.coalesce("d", F.lit(0.0))).over(rising))
    n, s = total.first()
    return summed.select("point", "cut", ((F.col("d") + F.lit(float(s or 0))) / F.lit(float(n or 1))).alias("f05"))


def plateau_middle(scores: DataFrame) -> DataFrame:
    """The row in the middle (the upper of two) of those within PLATEAU of the best score; `scores` has a row a point."""
    best = scores.agg(F.max("f05").alias("top"))
    near = scores.join(F.broadcast(best), F.col("f05") >= F.col("top") - PLATEAU).drop("top")
    whole = Window.partitionBy()
    ranked = near.withColumns({"_at": F.row_number().over(whole.orderBy("point")) - 1, "_n": F.count("*").over(whole)})
    return ranked.where("_at = floor(_n / 2)").drop("_at", "_n")


def tune_threshold(entities: DataFrame, truth: DataFrame, pairs: DataFrame, exclusively: bool = True, grid: list[float] | None = None) -> tuple[float, float]:
    base = exclusive(pairs) if exclusively else pairs
    r = plateau_middle(grid_scores(entities, truth, base, grid or THRESHOLD_GRID)).first()
    return r["cut"], r["f05"]


def expected_f_pairs(pairs: DataFrame, exclusively: bool = True) -> DataFrame:
    """What the expected-F decoder keeps before any floor; the best k does not depend on the floor."""
    return select_expected_f(pairs, 0.0, exclusively)


def tune_expected_f(entities: DataFrame, truth: DataFrame, pairs: DataFrame, exclusively: bool = True, grid: list[float] | None = None) -> tuple[float, float]:
    kept = expected_f_pairs(pairs, exclusively)
    r = plateau_middle(grid_scores(entities, truth, kept, grid or FLOOR_GRID)).first()
    return r["cut"], r["f05"]


def tune_decoder(entities: DataFrame, truth: DataFrame, pairs: DataFrame, exclusively: bool = True) -> tuple[str, float, float]:
    """(decoder, cut, score): expected-F only where it is strictly better."""
    cut, score = tune_threshold(entities, truth, pairs, exclusively)
    floor, better = tune_expected_f(entities, truth, pairs, exclusively)
    return ("expected_f", floor, better) if better > score else ("threshold", cut, score)
