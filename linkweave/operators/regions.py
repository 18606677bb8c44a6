"""Regions: choice between candidates, rare regions, and inference from the words at an address's end.

Records have country, region (empty: none; `a|b`: candidates) and addr_clean. All statistics are per country.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.vocabulary import REGIONS

MIN_SHARE = 0.0005
MIN_COUNT, MIN_PURITY, PASSES = 20, 0.98, 2


def region_freq(entities: DataFrame) -> DataFrame:
    """country, region, n over records with exactly one candidate."""
    clear = (F.col("region") != "") & ~F.col("region").contains("|")
    return entities.where(clear).groupBy("country", "region").agg(F.count("*").alias("n"))


def resolve(records: DataFrame, freq: DataFrame) -> DataFrame:
    """Each candidate list becomes its most frequent region, the first by name of equals; the choice is made per list."""
    lists = records.where(F.col("region").contains("|")).select("country", F.col("region").alias("_list")).distinct()
    cands = lists.select("country", "_list", F.explode(F.split("_list", r"\|")).alias("region"))
    known = cands.join(freq, ["country", "region"], "left")
    best = F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "region")).alias("b")
    picked = known.groupBy("country", "_list").agg(best).select("country", F.col("_list").alias("region"), F.col("b.region").alias("_pick"))
    return records.join(picked, ["country", "region"], "left").withColumn("region", F.coalesce("_pick", "region")).drop("_pick")


def rare(entities: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """country and region of regions below a share of the country's records that have a region."""
    n = entities.where("region <> ''").groupBy("country", "region").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("country"))
    return n.withColumn("t", total).where(F.col("n") < min_share * F.col("t")).select("country", "region")


def drop(records: DataFrame, bad: DataFrame) -> DataFrame:
    marked = records.join(bad.withColumn("_bad", F.lit(True)), ["country", "region"], "left")
    return marked.withColumn("region", F.when(F.col("_bad"), "").otherwise(F.col("region"))).drop("_bad")


def witnesses(address):
    """Up to seven words and pairs of neighbours among the last four tokens; digits, codes and short tokens are blank."""
    toks = F.filter(F.split(address, " "), lambda t: t != "")
    tail = F.slice(toks, F.greatest(F.size(toks) - 3, F.lit(1)), 4)
    blank = lambda t: t.rlike(r"^\d+$") | (F.length(t) < 3) | t.isin(*REGIONS.values())
    tail = F.transform(tail, lambda t: F.when(blank(t), "").otherwise(t))
    pairs = F.zip_with(tail, F.slice(tail, 2, 3), lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b)))
    return F.filter(F.concat(tail, pairs), lambda w: w.isNotNull() & (w != ""))


def _observed(records: DataFrame) -> DataFrame:
    return records.withColumn("witness", F.explode(witnesses(F.col("addr_clean"))))


def fit(records: DataFrame, min_count: int = MIN_COUNT, min_purity: float = MIN_PURITY) -> DataFrame:
    """country, witness, region: witnesses that are frequent and nearly exclusive to a region."""
    n = _observed(records.where("region <> ''").select("country", "region", "addr_clean")).groupBy("country", "witness", "region").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "region")).alias("b")
    summed = n.groupBy("country", "witness").agg(F.sum("n").alias("t"), best)
    kept = summed.where((F.col("t") >= min_count) & (-F.col("b.n") >= min_purity * F.col("t")))
    return kept.select("country", "witness", F.col("b.region").alias("region"))


def apply(records: DataFrame, table: DataFrame) -> DataFrame:
    """entity_id and region of records without one whose witnesses all agree."""
    seen = _observed(records.where("region = ''").select("entity_id", "country", "addr_clean")).join(table, ["country", "witness"])
    agreed = seen.groupBy("entity_id").agg(F.min("region").alias("region"), F.max("region").alias("other"))
    return agreed.where("region = other").select("entity_id", "region")


def infer(records: DataFrame, min_count: int = MIN_COUNT, min_purity: float = MIN_PURITY, passes: int = PASSES) -> DataFrame:
    """Fill empty regions; each pass learns from the one before. A pass without news changes nothing."""
    for _ in range(passes):
        found = apply(records, fit(records, min_count, min_purity)).withColumnRenamed("region", "_found")
        records = records.join(found, "entity_id", "left").withColumn("region", F.when(F.col("region") == "", F.coalesce("_found", F.lit(""))).otherwise(F.col("region"))).drop("_found")
    return records
