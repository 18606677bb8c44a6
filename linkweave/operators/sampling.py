"""Samples and folds by hash of the id: the same on every run and in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_key(column, seed: int = 42):
    """Eight hexadecimal digits of md5 as a number, uniform over ids."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), column.cast("string"))), 1, 8), 16, 10).cast("long")


def assign_folds(entities: DataFrame, folds: int = 4, seed: int = 42) -> DataFrame:
    """Every pair of an entity falls into one fold."""
    return entities.withColumn("fold", F.pmod(hash_key(F.col("s1_id"), seed), F.lit(folds)).cast("long"))


def sample_sizes(n: int, a: int = 60_000, b: int = 200_000, c: int = 150_000) -> dict[str, int]:
    """A shrinks where the table is small."""
    return {"A": min(a, max(n - b - c, n // 4)), "B": b, "C": c}


def disjoint_samples(entities: DataFrame, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """`entities` with sample: consecutive ranges, of the given sizes, of the order by hash; null beyond them.

    The order is over ids in 4096 ranges of the hash: counts by range place each range, a window orders inside it.
    """
    keyed = entities.withColumn("_h", hash_key(F.col("s1_id"), seed)).withColumn("_g", F.shiftright("_h", 20))
    upto = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("_g").count().select("_g", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g").orderBy("_h", "s1_id")
    place = F.col("_before") + F.row_number().over(inside)
    placed = keyed.join(F.broadcast(before), "_g").withColumn("_place", place)
    start, name = 0, F.lit(None).cast("string")
    for key, size in sizes.items():
        name = F.when((F.col("_place") > start) & (F.col("_place") <= start + size), F.lit(key)).otherwise(name)
        start += size
    return placed.withColumn("sample", name).drop("_h", "_g", "_before", "_place")


def hide_fraction(train_entities: int, train_targets: int, test_entities: int, test_targets: int) -> float:
    """Share of entities to hide so that the train split has the test split's targets per entity."""
    if not train_entities or not test_entities or not test_targets:
        return 0.0
    rate = (train_targets / train_entities) / (test_targets / test_entities)
    return min(max(1 - rate, 0.0), 0.5)


def hide(entities: DataFrame, hidden: DataFrame) -> DataFrame:
    return entities.join(hidden.select("s1_id"), "s1_id", "left_anti")


def dev_subset(records: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """The records of a share of each country's regions, and those without a region."""
    regions = records.where("region <> ''").select("country", "region").distinct()
    order = Window.partitionBy("country").orderBy(hash_key(F.concat_ws("|", "country", "region"), seed), "region")
    whole = Window.partitionBy("country")
    picked = regions.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(whole)}).where(F.col("_r") <= F.ceil(F.col("_n") * F.lit(fraction)))
    inside = records.join(picked.select("country", "region"), ["country", "region"], "left_semi")
    return inside.unionByName(records.where("region = ''"))
