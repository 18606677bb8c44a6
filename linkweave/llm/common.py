"""Session, storage and batch helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose texts are Python objects at once; Spark bounds its own batches by bytes.
BATCH_ROWS = 1000

_own_root: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only on a local master (tests).

    Elsewhere executors could not read what others wrote, so an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="linkweave-")
    return _own_root[app]


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_root(spark)}/linkweave/{tag}-{uuid.uuid4().hex}"


#: By application: folders of tables with weak references to what reads them in the JVM.
_tables: dict[str, list] = {}


def sweep(spark: SparkSession) -> None:
    """Delete the tables of materialize() that no plan reads any more, as the cleaner does with checkpoints."""
    known = _tables.get(spark.sparkContext.applicationId)
    if not known:
        return
    gc.collect()
    spark._jvm.System.gc()
    for item in list(known):
        path, reader = item
        if reader.get() is None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            known.remove(item)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which survives lost executors.

    The table goes once nothing that was made of the returned frame is left.
    """
    spark = df.sparkSession
    sweep(spark)
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    tie(path, out)
    return out


def tie(folder: str, table: DataFrame) -> None:
    """Delete `folder` once no plan reads `table`, a frame as materialize() returns it."""
    spark = table.sparkSession
    files = table._jdf.queryExecution().analyzed().relation().location()
    _tables.setdefault(spark.sparkContext.applicationId, []).append((folder, spark._jvm.java.lang.ref.WeakReference(files)))


def sample_rows(rows: DataFrame, most: int) -> list:
    """Distinct rows with their number of copies (last), about `most` of them in all, by a threshold of their hash.

    The threshold comes from a count before, so what reaches the driver is bounded whatever the number of partitions.
    """
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("__linkweave_copies"))
    each = materialize(each.withColumn("__linkweave_h", F.xxhash64(*rows.columns)), "labelled")
    total = each.count()
    if total > most:
        each = each.where(F.col("__linkweave_h") < int(most / total * 2**64) - 2**63)
    own = each.orderBy("__linkweave_h", *rows.columns).limit(most).select(*rows.columns, "__linkweave_copies")
    return own.collect()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that few texts are Python objects at once; settings stay as they are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Give freed memory back to the system; workers stay for other tasks, and idle ones count too."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow of a function of one batch; `fn` may return None for no rows; `done` is called at a partition's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if (out := fn(b)) is not None:
                yield out
        if done:
            done()
        release()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def rebatch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; whatever else the table holds stays out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of partitions that hold about `per_task` rows each."""
    return max(1, -(-rows // per_task))


def stored_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a table's size, from its files; nothing is read. None where it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None
