"""Queries that fit models; their rows are compared by tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators import blocking
from linkweave.plans import fixtures as fx
from linkweave.plans import linking, models

STAGE1 = ["comb_cos", "name_cos", "addr_cos", "prod", "is_s3", "n_pool", "rk_comb_cos", "rk_name_cos", "rk_addr_cos", "gap_comb_cos", "gap_name_cos", "gap_addr_cos", "rk_prod", "gap_prod", "rk_comb_all"]


def _labelled(spark, sf):
    links = linking.copies(spark, sf).withColumn("y", F.lit(1))
    pairs = blocking.stage1_features(linking._pool(spark, sf)).join(links, ["s1_id", "cand_id"], "left")
    return fx.kept(spark, sf, "labelled pool", lambda: pairs.na.fill(0, ["y"]))


def stage1_model(spark, sf):
    """Scores of the re-ranker by folds of entities."""
    scored, _ = models.cross_validate(models.Learner("logistic", 8, features=STAGE1), _labelled(spark, sf), 3, "stage1")
    return scored.select("country", "block", "s1_id", "cand_id", "y", F.round("stage1", 6).alias("stage1"))


def _order_pairs(spark, sf):
    pairs = fx.scored_pairs(spark, sf)
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("cand_id"), "p_size", "p_retailprice")
    return fx.kept(spark, sf, "order pairs", lambda: pairs.join(part, "cand_id").withColumn("first_num_equal", (F.col("p_size") % 2).cast("double")))


def level0_cv(spark, sf):
    """Out-of-fold probabilities of boosted trees."""
    scored, _ = models.cross_validate(models.Learner("gbt", 3, 3, features=["prob", "source", "p_size", "p_retailprice"]), _order_pairs(spark, sf), 2, "oof")
    return scored.select("s1_id", "cand_id", "y", F.round("oof", 6).alias("oof"))


def leave_one_country_out(spark, sf):
    """Trees of the other regions' nations score each region's pairs."""
    nation = fx.table(spark, sf, "nation").join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = fx.entities(spark, sf).join(F.broadcast(nation.select(F.col("n_name").alias("country"), "r_name")), "country").select("s1_id", F.col("r_name").alias("country"))
    pairs = _order_pairs(spark, sf).join(where, "s1_id")
    scored = models.leave_one_out(models.Learner("logistic", 2, features=["prob", "p_size"]), pairs, "loo")
    return scored.select("s1_id", "cand_id", "country", "y", F.round("loo", 6).alias("loo"))


QUERIES = {f.__name__: f for f in (stage1_model, level0_cv, leave_one_country_out)}
ORACLE_SQL: dict[str, str] = {}
