"""Words that true pairs exchange, add or drop: material for the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT, TOP = 50, 40


def _set(c: str):
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def mine(pairs: DataFrame, min_support: int = MIN_SUPPORT, top: int | None = TOP) -> DataFrame:
    """kind (substitution, added, dropped), country, left, right and n, by falling n within a kind.

    `pairs` has country, a_name, b_name, a_addr, b_addr of true pairs. A substitution is a pair of addresses of which
    either has exactly one word that the other lacks.
    """
    from pyspark.sql import Window

    sets = pairs.select("country", *[_set(f"{s}_{k}").alias(f"{s}_{k}") for s in "ab" for k in ("name", "addr")])
    diff = lambda x, y: F.array_except(x, y)
    rows = sets.select("country", diff("a_addr", "b_addr").alias("xa"), diff("b_addr", "a_addr").alias("ya"), diff("b_name", "a_name").alias("added"), diff("a_name", "b_name").alias("dropped"))
    none = F.lit(None).cast("string")
    one = rows.where((F.size("xa") == 1) & (F.size("ya") == 1)).select(F.lit("substitution").alias("kind"), "country", F.col("xa")[0].alias("left"), F.col("ya")[0].alias("right"))
    add = rows.select(F.lit("added").alias("kind"), "country", none.alias("left"), F.explode("added").alias("right"))
    gone = rows.select(F.lit("dropped").alias("kind"), "country", F.explode("dropped").alias("left"), none.alias("right"))
    n = one.unionByName(add).unionByName(gone).groupBy("kind", "country", "left", "right").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    if top is None:
        return n
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "country", "left", "right")
    return n.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
