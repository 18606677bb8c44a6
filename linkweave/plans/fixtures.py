"""Logical inputs made of the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[tuple[str, str, str], DataFrame] = {}


def _shared_root(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, if one is known."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    alone = spark.sparkContext.master.split("[")[0] == "local"
    return "file://" + tempfile.mkdtemp(prefix="linkweave-") if alone else None


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What several queries of a session share is computed once, as a table in the shared folder that goes with the session.

    Without such a folder it is persisted with spill. Plans hold a scan of it and not how it was made: one that names the
    index many times had 27 million letters.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        made, root = make(), _shared_root(spark)
        if root:
            path = f"{root}/linkweave/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            made.write.option("compression", "zstd").parquet(path)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
            made = spark.read.schema(made.schema).parquet(path)
            gc.collect()
            spark._jvm.System.gc()  # what made it leaves shuffle files until its plan is collected
        else:
            made = made.persist(StorageLevel.MEMORY_AND_DISK).select("*")
        rows = made._jdf.queryExecution().toRdd()
        _kept[key] = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, made._jdf.schema(), False), spark)
    return _kept[key]


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts as entities and candidates: s1_id, cand_id, source, prob and the label y, a row a pair."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("s1_id"),
        F.col("l_partkey").alias("cand_id"),
        (2 + F.col("l_linenumber") % 2).cast("long").alias("source"),
        ((F.col("l_quantity") * 1000 + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % 997) / 51000.0).alias("prob"),
        (F.col("l_returnflag") == "R").cast("long").alias("y"),
    )
    return rows.groupBy("s1_id", "cand_id").agg(F.min("source").alias("source"), F.max("prob").alias("prob"), F.max("y").alias("y"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with the name of their customer's nation as country; some have no pair."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), "o_custkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("s1_id", "country")


def truth(pairs: DataFrame) -> DataFrame:
    return pairs.where("y = 1").select("s1_id", "cand_id")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"))


PAIRS_SQL = """pairs AS (
  SELECT l_orderkey AS s1_id, l_partkey AS cand_id, MIN(CAST(2 + l_linenumber % 2 AS BIGINT)) AS source,
    MAX((l_quantity * 1000 + (l_orderkey * 7919 + l_partkey * 31) % 997) / 51000.0) AS prob,
    MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
  FROM lineitem GROUP BY 1, 2),
truth AS (SELECT s1_id, cand_id FROM pairs WHERE y = 1),
entities AS (
  SELECT o_orderkey AS s1_id, n_name AS country FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
EXCLUSIVE_SQL = """excl AS (
  SELECT * EXCLUDE (rk) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM pairs) WHERE rk = 1)"""
EXPECTED_SQL = """ef0 AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS k,
    SUM(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS UNBOUNDED PRECEDING) AS cum,
    SUM(prob) OVER (PARTITION BY s1_id) AS tot,
    EXP(SUM(LN(1 - LEAST(GREATEST(prob, 1e-6), 1 - 1e-6))) OVER (PARTITION BY s1_id)) AS p_empty FROM excl),
ef1 AS (SELECT *, 1.25 * cum / (0.25 * tot + k) AS f FROM ef0),
ef2 AS (SELECT *, MAX(f) OVER (PARTITION BY s1_id) AS best FROM ef1),
ef3 AS (SELECT *, MIN(CASE WHEN f >= best - 1e-12 THEN k END) OVER (PARTITION BY s1_id) AS k_best FROM ef2),
ef AS (SELECT s1_id, cand_id, prob, k FROM ef3 WHERE best > p_empty AND k <= k_best)"""


def counts_sql(name: str, predicted: str) -> str:
    """Per entity n_true, n_pred, tp and f05 against a table of predicted pairs."""
    return f"""{name} AS (
  SELECT e.s1_id, e.country, COALESCE(t.n, 0) AS n_true, COALESCE(p.n, 0) AS n_pred, COALESCE(p.tp, 0) AS tp,
    CASE WHEN COALESCE(t.n, 0) = 0 AND COALESCE(p.n, 0) = 0 THEN 1.0 WHEN COALESCE(p.tp, 0) = 0 THEN 0.0
      ELSE 1.25 * p.tp / (0.25 * t.n + p.n) END AS f05
  FROM entities e
  LEFT JOIN (SELECT s1_id, COUNT(*) AS n FROM truth GROUP BY 1) t USING (s1_id)
  LEFT JOIN (SELECT q.s1_id, COUNT(*) AS n, COUNT(u.cand_id) AS tp FROM {predicted} q
    LEFT JOIN truth u ON q.s1_id = u.s1_id AND q.cand_id = u.cand_id GROUP BY 1) p USING (s1_id))"""
