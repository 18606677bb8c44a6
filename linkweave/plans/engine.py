"""The whole job over splits of tab-separated sources: normalise, block, re-rank, score, decode, write.

A split is data_dir/split/split_source{1,2,3}.tsv, and for training split_ground_truth.tsv. Normalised records, scored
pairs and models are tables under artifact_dir; commands meet only there.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import blocking, decode, features, metrics, normalize, regions, sampling
from linkweave.plans import models
from linkweave.plans.modelling import STAGE1
from linkweave.sources import tsv

MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


@dataclass(frozen=True)
class Settings:
    data_dir: str
    artifact_dir: str
    output_dir: str
    sample: int = 200_000
    stage1_sample: int = 60_000
    ce_sample: int = 150_000
    rounds: int = 20
    folds: int = 4
    hide: str = "0"
    seed: int = 42
    blocking: blocking.Config = field(default_factory=blocking.Config)


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.s = spark, settings

    # records ----------------------------------------------------------------------------------------------------

    def records(self, split: str) -> DataFrame:
        """Normalised records of a split with regions resolved, rare ones dropped, and missing ones inferred."""
        path = f"{self.s.artifact_dir}/records/{split}_{normalize.version()}"
        if not self._exists(f"{path}/_SUCCESS"):
            base = f"{self.s.data_dir}/{split}/{split}_source"
            own = tsv.read_source(self.spark, f"{base}1.tsv").withColumn("source", F.lit(1).cast("long"))
            every = own.unionByName(tsv.make_targets(*(tsv.read_source(self.spark, f"{base}{k}.tsv") for k in (2, 3))))
            raw = normalize.prepare(every).withColumn("raw_country", F.col("country")).withColumn("country", F.col("country_norm"))
            # countries without entities have nothing to link
            known = raw.join(raw.where("source = 1").select("country").distinct(), "country", "left_semi")
            known.write.mode("overwrite").parquet(f"{path}_raw")
            rows = self.spark.read.parquet(f"{path}_raw")
            rows = regions.resolve(rows, regions.region_freq(rows.where("source = 1")))
            rows = regions.infer(regions.drop(rows, regions.rare(rows.where("source = 1"))))
            rows.write.mode("overwrite").partitionBy("country").parquet(path)
        return self.spark.read.parquet(path).withColumn("source", F.col("source").cast("long"))

    def truth(self, split: str) -> DataFrame:
        return tsv.read_ground_truth(self.spark, f"{self.s.data_dir}/{split}/{split}_ground_truth.tsv")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _save(self, name: str, value: dict) -> None:
        rows = self.spark.createDataFrame([(json.dumps(value),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{self.s.artifact_dir}/{name}")

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.s.artifact_dir}/{name}").first()[0])

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.s.artifact_dir}/frames/{name}")
        return self.spark.read.parquet(f"{self.s.artifact_dir}/frames/{name}")

    # candidates -------------------------------------------------------------------------------------------------

    def _index(self, records: DataFrame, name: str) -> DataFrame:
        return self._table(blocking.postings(records, self.s.blocking), f"{name}_index")

    def pools(self, index: DataFrame, name: str, queries: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Stage-1 features of the pool of `queries` (all without), and the best scores of all targets."""
        cos = self._table(blocking.cosines(blocking.view_weights(index, self.s.blocking), self.s.blocking), f"{name}_cosines")
        own = cos if queries is None else cos.join(queries.select("s1_id"), "s1_id", "left_semi")
        return blocking.stage1_features(blocking.pool(own, self.s.blocking)), blocking.target_best(cos)

    def candidates(self, records: DataFrame, name: str, model: PipelineModel, queries: DataFrame | None) -> DataFrame:
        """All features of the candidates that the re-ranker keeps."""
        index = self._index(records, name)
        pool, best = self.pools(index, name, queries)
        scored = models.Learner("gbt", features=STAGE1).predict(model, pool, "stage1")
        kept = blocking.keep_top(scored, self.s.blocking).join(best, ["country", "block", "cand_id", "source"])
        return self._table(features.build(kept, index, records), f"{name}_features")

    def _ids(self, records: DataFrame) -> DataFrame:
        return records.where("source = 1").select(F.col("entity_id").alias("s1_id"), "country")

    # commands ---------------------------------------------------------------------------------------------------

    def eda(self, split: str = "train") -> dict[str, DataFrame]:
        records = self.records(split)
        out = {"records": metrics.record_counts(records)}
        if self._exists(f"{self.s.data_dir}/{split}/{split}_ground_truth.tsv"):
            links, ids = self.truth(split), self._ids(records)
            tgt = records.where("source <> 1")
            out["truth"] = metrics.truth_report(ids, tgt.select(F.col("entity_id").alias("cand_id")), links)
            out["links"] = metrics.links_histogram(ids, links)
            out["agreement"] = metrics.agreement(links, records.where("source = 1"), tgt)
        return out

    def _hidden_share(self) -> float:
        if self.s.hide != "auto":
            return float(self.s.hide)
        n = {}
        for split in ("train", "test"):
            rows = self.records(split)
            n[split] = (rows.where("source = 1").count(), rows.where("source <> 1").count())
        return sampling.hide_fraction(*n["train"], *n["test"])

    def train(self) -> dict:
        """Fit the re-ranker on sample A; candidates, folds and decoder on sample B; refit on all of B."""
        records, links = self.records("train"), self.truth("train")
        ids = self._ids(records)
        n = ids.count()
        sizes = sampling.sample_sizes(n, self.s.stage1_sample, min(self.s.sample, n - n // 4), self.s.ce_sample)
        sizes["hidden"] = int(round(self._hidden_share() * n))
        drawn = sampling.disjoint_samples(ids, {k: max(0, v) for k, v in sizes.items()}, self.s.seed)
        gone = drawn.where("sample = 'hidden'").select(F.col("s1_id").alias("entity_id"))
        records = records.join(gone, "entity_id", "left_anti")
        a, b = (drawn.where(F.col("sample") == k).select("s1_id", "country") for k in "AB")
        truth_of = lambda pairs: pairs.join(links.withColumn("y", F.lit(1)), models.KEY, "left").na.fill(0, ["y"])
        pool, _ = self.pools(self._index(records, "stage1"), "stage1", a)
        learner = models.Learner("gbt", self.s.rounds, features=STAGE1)
        stage1 = learner.fit(self._table(truth_of(pool), "stage1_pool"))
        stage1.write().overwrite().save(f"{self.s.artifact_dir}/stage1")
        pairs = self._table(truth_of(self.candidates(records, "train", stage1, b)), "train_pairs")
        own = links.join(b, "s1_id", "left_semi")
        targets = records.where("source <> 1").count()
        report = metrics.blocking_report(b, own, pairs.select(*models.KEY).distinct(), targets).first().asDict()
        level0 = models.Learner("gbt", self.s.rounds, features=features.feature_names())
        scored, rounds = models.cross_validate(level0, pairs, self.s.folds)
        best = scored.groupBy(*models.KEY).agg(F.max("prob").alias("prob"))  # a pair may stand in two blocks
        best = self._table(best, "train_scored")
        decoder, cut, score = decode.tune_decoder(b, own, best)
        chosen = decode.select_with(best, decoder, cut)
        per = self._table(decode.per_entity(b, own, chosen).join(b, "s1_id"), "train_f05")
        self._table(metrics.error_dump(own, chosen, best), "train_errors")
        model = level0.fit(pairs, rounds=rounds)
        model.write().overwrite().save(f"{self.s.artifact_dir}/level0")
        meta = {"decoder": decoder, "cut": cut, "f05": score, "rounds": rounds, "blocking": report, "importances": level0.importances(model)}
        meta["countries"] = [r.asDict() for r in metrics.by_country(per.select("s1_id", "f05"), b).collect()]
        meta["settings"] = {k: v for k, v in asdict(self.s).items() if k != "blocking"}
        self._save("meta", meta)
        return meta

    def validate(self) -> DataFrame:
        """Macro scores by country of a model that never saw the country."""
        pairs = self.spark.read.parquet(f"{self.s.artifact_dir}/frames/train_pairs")
        scored = models.leave_one_out(models.Learner("gbt", self.s.rounds, features=features.feature_names()), pairs)
        best = scored.groupBy(*models.KEY).agg(F.max("prob").alias("prob"))
        per = self.spark.read.parquet(f"{self.s.artifact_dir}/frames/train_f05").select("s1_id", "country")
        meta = self._load("meta")
        return metrics.by_country(decode.per_entity(per, self.truth("train").join(per, "s1_id", "left_semi"), decode.select_with(best, meta["decoder"], meta["cut"])), per)

    def predict(self, split: str = "test") -> dict[str, int]:
        """Write the two outputs of a split; ValueError if they break a rule. Returns counts."""
        meta, records = self._load("meta"), self.records(split)
        stage1, level0 = (PipelineModel.load(f"{self.s.artifact_dir}/{k}") for k in ("stage1", "level0"))
        pairs = self.candidates(records, split, stage1, None)
        scored = models.Learner("gbt", features=features.feature_names()).predict(level0, pairs)
        best = self._table(scored.groupBy(*models.KEY).agg(F.max("prob").alias("prob")), f"{split}_scored")
        ids = self._ids(records)
        chosen = decode.select_with(best, meta["decoder"], meta["cut"])
        broken = metrics.output_check(ids, records.where("source <> 1").select(F.col("entity_id").alias("cand_id")), chosen, best).where("n > 0").collect()
        if broken:
            raise ValueError(f"outputs break rules: {[(r['rule'], r['n']) for r in broken]}")
        tsv.write_pairs(ids, chosen, f"{self.s.output_dir}/matching_results", MATCHES)
        tsv.write_pairs(ids, best, f"{self.s.output_dir}/candidate_pairs", CANDIDATES)
        return {"entities": ids.count(), "candidates": best.count(), "matches": chosen.count()}

    def stack(self) -> list[dict]:
        """Levels 1 and 2 on the training pairs with the ablation."""
        pairs = self.spark.read.parquet(f"{self.s.artifact_dir}/frames/train_pairs")
        scored = self.spark.read.parquet(f"{self.s.artifact_dir}/frames/train_scored")
        first = pairs.withColumn("_r", F.row_number().over(models_window())).where("_r = 1").drop("_r")
        data = first.join(scored, models.KEY)
        per = self.spark.read.parquet(f"{self.s.artifact_dir}/frames/train_f05").select("s1_id", "country")
        records = self.records("train").where("source <> 1").select("entity_id", "name_core", "addr_clean", "addr_numbers")
        truth = self.truth("train").join(per, "s1_id", "left_semi")
        out, rows = models.levels(data, features.feature_names(), per, per, truth, records, max(2, self.s.rounds // 2), self._table)
        self._table(out.select(*models.KEY, "prob"), "stack_scored")
        self._save("stack", {"levels": rows})
        return rows


def models_window():
    """A pair that stands in two blocks is taken from the one with the higher stage-1 score."""
    from pyspark.sql import Window

    return Window.partitionBy(*models.KEY).orderBy(F.desc("stage1"), "block")
