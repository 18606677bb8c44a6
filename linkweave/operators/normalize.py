"""Records with normalised names and addresses."""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import addresses, names, translit, vocabulary

NORMALISED = ["name_clean", "name_core", "name_compact", "name_legal", "name_nonlatin", "name_alt", "addr_clean", "addr_alpha", "addr_numbers", "postal", "addr_landmark", "addr_nonlatin", "region", "country_norm"]


def prepare(records: DataFrame, romanise: bool = True) -> DataFrame:
    """`records` (with business_name, business_address, country) and the columns NORMALISED.

    `romanise=False` only lowers case: for sources known to be ASCII, where no Python is needed.
    """
    to_latin = translit.latin if romanise else F.lower
    raw = {c: F.coalesce(F.col(c), F.lit("")) for c in ("business_name", "business_address", "country")}
    out = records.withColumns({"_n": to_latin(raw["business_name"]), "_a": to_latin(raw["business_address"])})
    out = names.with_name_fields(out, "_n")
    out = addresses.with_address_fields(out, "_a")
    return out.withColumns({
        "name_nonlatin": names.nonlatin(raw["business_name"]),
        "addr_nonlatin": names.nonlatin(raw["business_address"]),
        "country_norm": F.lower(F.trim(raw["country"])),
    }).drop("_n", "_a")


def version() -> str:
    """Names the rules that made a cached table: eight digits of a hash over their source."""
    source = "".join(inspect.getsource(m) for m in (names, addresses, translit, vocabulary))
    return hashlib.md5(source.encode()).hexdigest()[:8]


def prepare_cached(records: DataFrame, path: str, romanise: bool = True) -> DataFrame:
    """Normalised records, written once by version of the rules, in folders by country."""
    spark, at = records.sparkSession, f"{path}_{version()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        prepare(records, romanise).write.mode("overwrite").partitionBy("country_norm").parquet(at)
    return spark.read.parquet(at)
