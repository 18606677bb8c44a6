"""Tab-separated sources and sinks: records, ground truth, match lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file, or of the first file of a folder."""
    row = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"').removeprefix("﻿") for c in row[0][0].rstrip("\r").split("\t")] if row else []


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an empty field is the empty string and the text NA stays as it is."""
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """The four columns of a source, trimmed; ValueError if one is missing."""
    df = read_tsv(spark, path)
    missing = [c for c in SOURCE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing} (got {df.columns})")
    return df.select(*[F.regexp_replace(F.col(c), r"^\s+|\s+$", "").alias(c) for c in SOURCE_COLUMNS])


def links(wide: DataFrame) -> DataFrame:
    """s1_id and cand_id of each link of a table with comma-joined matched_entity_ids; singletons have no row."""
    every = wide.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("cand_id"))
    return every.withColumn("cand_id", F.trim("cand_id")).where("cand_id <> ''")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return links(read_tsv(spark, path))


def links_of(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """s1_id and cand_ids (a set, empty for singletons) of the entities of `ids`."""
    return ids.select("s1_id").distinct().join(truth, "s1_id", "left").groupBy("s1_id").agg(F.collect_set("cand_id").alias("cand_ids"))


def read_ids(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Records of a source whose entity_id is among `ids`."""
    return read_source(spark, path).join(ids.select("entity_id"), "entity_id", "left_semi")


def load_split(spark: SparkSession, data_dir: str, split: str) -> dict[str, DataFrame]:
    """s1, s2, s3, and gt where there is one, of a split."""
    base = f"{data_dir}/{split}/{split}"
    out = {f"s{k}": read_source(spark, f"{base}_source{k}.tsv") for k in (1, 2, 3)}
    jvm, path = spark._jvm, f"{base}_ground_truth.tsv"
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        out["gt"] = read_ground_truth(spark, path)
    return out


def make_targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    return s2.withColumn("source", F.lit(2).cast("long")).unionByName(s3.withColumn("source", F.lit(3).cast("long")))


def pair_rows(entities: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """s1_id and the comma-joined candidates of every entity, by falling prob where there is one; empty if none."""
    if "prob" in pairs.columns:
        best = pairs.groupBy("s1_id", "cand_id").agg(F.max("prob").alias("p"))
    else:
        best = pairs.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(0.0))
    row = F.struct((-F.col("p")).alias("p"), "cand_id")
    joined = best.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cand_id"].cast("string")), ",").alias(column))
    return entities.select("s1_id").join(joined, "s1_id", "left").na.fill("", [column])


def write_pairs(entities: DataFrame, pairs: DataFrame, path: str, columns: tuple[str, str], order: str | None = None) -> None:
    """A table of one row an entity, as tab-separated text with a header in each part; parts are in the entities' order.

    `order` names a column of `entities` that gives the order; without it rows are in order of s1_id.
    """
    rows = pair_rows(entities, pairs, columns[1])
    if order:
        rows = rows.join(entities.select("s1_id", order), "s1_id").orderBy(order).drop(order)
    else:
        rows = rows.orderBy("s1_id")
    rows = rows.withColumnRenamed("s1_id", columns[0])
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def country_ranges(rows: DataFrame, order: str) -> DataFrame:
    """Runs of equal country along `order`: country, first and last place, and rows."""
    by = Window.orderBy(order)
    fresh = F.when(F.lag("country").over(by) == F.col("country"), 0).otherwise(1)
    runs = rows.select("country", order, fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("run", "country").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def record_texts(records: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text (`name | address`) of every id; ValueError if one has no record."""
    wanted = ids.select("id").distinct()
    gone = wanted.join(records, wanted["id"] == records["entity_id"], "left_anti").count()
    if gone:
        raise ValueError(f"{gone} ids have no record")
    return wanted.join(records, wanted["id"] == records["entity_id"]).select("id", F.concat_ws(" | ", "business_name", "business_address").alias("text"))
