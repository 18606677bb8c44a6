"""Features of a pair by the scores of its entity's other candidates.

Pairs have s1_id, cand_id, source and prob; ties in prob go to the smaller cand_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import similarity as sim


def context(pairs: DataFrame, prefix: str = "r") -> DataFrame:
    """Where a pair stands among its entity's candidates, and among those of its source."""
    ent, src = Window.partitionBy("s1_id"), Window.partitionBy("s1_id", "source")
    order = lambda w: w.orderBy(F.desc("prob"), "cand_id")
    out = pairs.withColumns({"_re": F.row_number().over(order(ent)), "_rs": F.row_number().over(order(src))})
    second = F.max(F.when(F.col("_re") == 2, F.col("prob"))).over(ent)
    return out.withColumns({
        f"{prefix}_rank_s1": F.col("_re"),
        f"{prefix}_pmax_s1": F.max("prob").over(ent),
        f"{prefix}_p2_s1": F.coalesce(second, F.lit(0.0)),
        f"{prefix}_psum_s1": F.sum("prob").over(ent),
        f"{prefix}_nhi_s1": F.sum((F.col("prob") > 0.5).cast("long")).over(ent),
        f"{prefix}_gap_s1": F.max("prob").over(ent) - F.col("prob"),
        f"{prefix}_rank_src": F.col("_rs"),
        f"{prefix}_gap_src": F.max("prob").over(src) - F.col("prob"),
        f"{prefix}_n_src": F.count("*").over(src),
    }).drop("_re", "_rs")


def _best(pairs: DataFrame) -> DataFrame:
    """The two best candidates of each entity and source."""
    order = Window.partitionBy("s1_id", "source").orderBy(F.desc("prob"), "cand_id")
    return pairs.withColumn("_r", F.row_number().over(order))


def twin(pairs: DataFrame, prefix: str = "r") -> DataFrame:
    """The best other candidate of the same source: its id, score, whether it is higher, and its first_num_equal."""
    whole = Window.partitionBy("s1_id", "source")
    row = F.struct("cand_id", "prob", *(["first_num_equal"] if "first_num_equal" in pairs.columns else []))
    ranked = _best(pairs)
    at = lambda r: F.max(F.when(F.col("_r") == r, row)).over(whole)
    out = ranked.withColumn("_t", F.when(F.col("_r") == 1, at(2)).otherwise(at(1)))
    out = out.withColumns({f"{prefix}_twin_id": F.col("_t.cand_id"), f"{prefix}_twin_p": F.col("_t.prob"), f"{prefix}_twin_higher": (F.col("_t.prob") > F.col("prob")).cast("double")})
    if "first_num_equal" in pairs.columns:
        out = out.withColumn(f"{prefix}_twin_numeq_s1", F.col("_t.first_num_equal"))
    return out.drop("_t", "_r")


def anchor(pairs: DataFrame, prefix: str = "r") -> DataFrame:
    """The entity's best candidate of the other source: its id and score."""
    heads = _best(pairs).where("_r = 1").select("s1_id", (5 - F.col("source")).alias("source"), F.col("cand_id").alias(f"{prefix}_anc_id"), F.col("prob").alias(f"{prefix}_anc_p"))
    return pairs.join(heads, ["s1_id", "source"], "left")


def with_similarities(pairs: DataFrame, records: DataFrame, other: str, prefix: str) -> DataFrame:
    """Name and address similarity and equal house numbers of each candidate and the one in column `other`.

    `records` has entity_id, name_core, addr_clean and addr_numbers of all candidates; ValueError if one is missing.
    """
    own = records.select(F.col("entity_id"), "name_core", "addr_clean", F.substring_index("addr_numbers", " ", 1).alias("num"))
    wanted = pairs.select(F.col("cand_id").alias("entity_id")).distinct()
    gone = wanted.join(own, "entity_id", "left_anti").count()
    if gone:
        raise ValueError(f"{gone} candidates have no record")
    side = lambda p, key: own.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"_{p}{c}") for c in ("name_core", "addr_clean", "num")])
    out = pairs.join(side("x", "cand_id"), "cand_id", "left").join(side("y", other), other, "left")
    has = F.col(other).isNotNull()
    nums = has & (F.col("_xnum") != "") & (F.col("_ynum") != "")
    out = out.withColumns({
        f"{prefix}_name": F.when(has, sim.core_tset(F.col("_xname_core"), F.col("_yname_core"))),
        f"{prefix}_addr": F.when(has, sim.core_tset(F.col("_xaddr_clean"), F.col("_yaddr_clean"))),
        f"{prefix}_num_eq": F.when(nums, (F.col("_xnum") == F.col("_ynum")).cast("double")),
    })
    return out.drop(*[f"_{p}{c}" for p in "xy" for c in ("name_core", "addr_clean", "num")])


def relational(pairs: DataFrame, records: DataFrame, prefix: str = "r") -> DataFrame:
    """All 21 features; `pairs` has first_num_equal too."""
    out = anchor(twin(context(pairs, prefix), prefix), prefix)
    out = with_similarities(out, records, f"{prefix}_twin_id", f"{prefix}_twin")
    out = with_similarities(out, records, f"{prefix}_anc_id", f"{prefix}_anc")
    p = F.col(f"{prefix}_anc_p")
    times = {f"{prefix}_anc_x_{k}": p * F.col(f"{prefix}_anc_{k}") / 100 for k in ("name", "addr")}
    return out.withColumns(times).drop(f"{prefix}_twin_id", f"{prefix}_anc_id")
