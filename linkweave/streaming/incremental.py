"""Incremental linking of a stream of records against an index at rest, and windowed counts of what came in.

An extension: batch linking is the model, and each micro-batch is linked as a batch of new targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkweave.operators import blocking


def link_batch(entities: DataFrame, arrivals: DataFrame, cfg: blocking.Config = blocking.Config()) -> DataFrame:
    """The pool of new targets (records with source 2 or 3) against the entities."""
    both = entities.unionByName(arrivals.select(*entities.columns))
    views = blocking.view_weights(blocking.postings(both, cfg), cfg)
    return blocking.pool(blocking.cosines(views, cfg), cfg)


def link_stream(entities: DataFrame, arrivals: DataFrame, path: str, checkpoint: str, cfg: blocking.Config = blocking.Config()) -> StreamingQuery:
    """Append each micro-batch's pool to a table; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        link_batch(entities, batch, cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and users by type and tumbling window; the watermark bounds the state. `events` has ts, event_type, user_id."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    n = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return n.select(F.col("window.start").alias("start"), "event_type", "n", "users")
