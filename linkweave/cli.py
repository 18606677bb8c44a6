"""Commands: eda, train, validate, predict, all, stack, mine-vocab."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkweave.operators import vocab
from linkweave.plans.engine import Engine, Settings

COMMANDS = ("eda", "train", "validate", "predict", "all", "stack", "mine-vocab")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkweave", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    env = lambda k, d: os.environ.get(f"LINKWEAVE_{k}", d)
    p.add_argument("--data-dir", default=env("DATA_DIR", "data"))
    p.add_argument("--artifact-dir", default=env("ARTIFACT_DIR", "artifacts"))
    p.add_argument("--output-dir", default=env("OUTPUT_DIR", "output"))
    p.add_argument("--sample", type=int, default=200_000, help="entities of sample B")
    p.add_argument("--stage1-sample", type=int, default=60_000)
    p.add_argument("--ce-sample", type=int, default=150_000)
    p.add_argument("--rounds", type=int, default=20)
    p.add_argument("--folds", type=int, default=4)
    p.add_argument("--hide-s1", default="0", help="share of entities to hide, or auto")
    p.add_argument("--min-support", type=int, default=vocab.MIN_SUPPORT)
    p.add_argument("--top", type=int, default=vocab.TOP)
    return p


def mined(engine: Engine, min_support: int, top: int):
    """Vocabulary from the true pairs of the training split."""
    records = engine.records("train")
    side = lambda s, key, df: df.select(F.col("entity_id").alias(key), F.col("name_core").alias(f"{s}_name"), F.col("addr_alpha").alias(f"{s}_addr"), *([F.col("country")] if s == "a" else []))
    pairs = engine.truth("train").join(side("a", "s1_id", records.where("source = 1")), "s1_id").join(side("b", "cand_id", records.where("source <> 1")), "cand_id")
    return vocab.mine(pairs, min_support, top)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, Settings(a.data_dir, a.artifact_dir, a.output_dir, a.sample, a.stage1_sample, a.ce_sample, a.rounds, a.folds, a.hide_s1))
    if a.command == "eda":
        for name, df in engine.eda().items():
            print(f"== {name}")
            df.show(50, truncate=False)
    if a.command in ("train", "all"):
        print(json.dumps(engine.train(), indent=1, default=str))
    if a.command == "validate":
        engine.validate().show(50, truncate=False)
    if a.command in ("predict", "all"):
        print(json.dumps(engine.predict()))
    if a.command == "stack":
        print(json.dumps(engine.stack(), indent=1, default=str))
    if a.command == "mine-vocab":
        mined(engine, a.min_support, a.top).orderBy("kind", F.desc("n")).show(a.top * 3, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
