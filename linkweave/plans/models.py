"""Learners of the stack and what stands between them: logits, bands, folds, ablation.

Learners are pyspark.ml pipelines; gradient-boosted trees grow by level here, so scores are of like quality, never
equal to those of other libraries. A missing feature is a null: it becomes -1 with an indicator beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators import decode, metrics, sampling, siblings

EDGE = 1e-6
KEY = ["s1_id", "cand_id"]


def logit(p):
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p) - F.log(1 - p)


def sigmoid(x):
    return 1 / (1 + F.exp(-x))


def mean_probability(columns: list[str]):
    """Probability of the mean logit of several learners."""
    return sigmoid(sum((logit(F.col(c)) for c in columns[1:]), logit(F.col(columns[0]))) / len(columns))


def in_band(p, low: float | None, high: float | None):
    """Whether a pair is uncertain enough for the expensive scorer; without a band all are."""
    return F.lit(True) if low is None else p.between(low, high)


def score_missing(pairs: DataFrame, scored: DataFrame, scorer: Callable[[DataFrame], DataFrame], column: str, low: float | None, high: float | None) -> DataFrame:
    """`pairs` with `column`: earlier scores stay, pairs of the band without one are scored, the rest is null."""
    old = scored.where(F.col(column).isNotNull()).select(*KEY, column)
    todo = pairs.where(in_band(F.col("prob"), low, high)).join(old, KEY, "left_anti")
    return pairs.join(old.unionByName(scorer(todo).select(*KEY, column)), KEY, "left")


def text_scorer(encode: Callable, column: str = "ce", batch: int = 512):
    """Scorer of pairs with text_a and text_b by a model of the caller's: encode(list, list) -> scores, batch by batch.

    Batches are cut from rows in order of length, so that a batch pads little; `encode` is made once for each worker.
    """

    def score(pairs: DataFrame) -> DataFrame:
        import pandas as pd

        def run(batches):
            model = encode()
            for pdf in batches:
                order = (pdf["text_a"].str.len() + pdf["text_b"].str.len()).argsort(kind="stable").to_numpy()
                out = pd.Series(0.0, index=range(len(pdf)))
                for s in range(0, len(order), batch):
                    at = order[s : s + batch]
                    out.iloc[at] = model(pdf["text_a"].iloc[at].tolist(), pdf["text_b"].iloc[at].tolist())
                yield pd.DataFrame({"s1_id": pdf["s1_id"], "cand_id": pdf["cand_id"], column: out.to_numpy()})

        kinds = dict(pairs.dtypes)
        return pairs.select(*KEY, "text_a", "text_b").mapInPandas(run, f"s1_id {kinds['s1_id']}, cand_id {kinds['cand_id']}, {column} double")

    return score


@dataclass(frozen=True)
class Learner:
    """A classifier on named features. `rounds` is the most trees; with validation fewer may be kept."""

    kind: str = "gbt"
    rounds: int = 20
    depth: int = 5
    seed: int = 42
    features: list[str] = field(default_factory=list)

    def classifier(self, rounds: int | None = None, validate: bool = False):
        n = rounds or self.rounds
        common = {"featuresCol": "features", "labelCol": "y"}
        if self.kind == "gbt":
            gbt = GBTClassifier(maxIter=n, maxDepth=self.depth, stepSize=0.1, seed=self.seed, subsamplingRate=0.8, featureSubsetStrategy="0.8", validationTol=1e-5, **common)
            return gbt.setValidationIndicatorCol("_valid") if validate else gbt
        if self.kind == "forest":
            return RandomForestClassifier(numTrees=n, maxDepth=self.depth + 3, seed=self.seed, **common)
        return LogisticRegression(maxIter=n * 5, regParam=1e-3, **common)

    def inputs(self, df: DataFrame) -> DataFrame:
        cols = {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in self.features}
        cols |= {f"_m_{c}": F.col(c).isNull().cast("double") for c in self.features}
        return df.withColumns(cols)

    def fit(self, df: DataFrame, rounds: int | None = None, validate: bool = False) -> PipelineModel:
        names = [f"_f_{c}" for c in self.features] + [f"_m_{c}" for c in self.features]
        stages = [VectorAssembler(inputCols=names, outputCol="features"), self.classifier(rounds, validate)]
        extra = ["_valid"] if validate else []
        rows = self.inputs(df).withColumn("y", F.col("y").cast("double")).select(*KEY, "y", *names, *extra)
        # boosting zips its errors with the rows: their partitions and order must be the same in every pass
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, *KEY).sortWithinPartitions(*KEY).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return Pipeline(stages=stages).fit(rows)
        finally:
            rows.unpersist()

    def predict(self, model: PipelineModel, df: DataFrame, column: str = "prob") -> DataFrame:
        scored = model.transform(self.inputs(df)).withColumn(column, vector_to_array("probability")[1])
        return scored.drop("features", "probability", "rawPrediction", "prediction", *[f"_{k}_{c}" for k in "fm" for c in self.features])

    def importances(self, model: PipelineModel, top: int = 20) -> list[tuple[str, float]]:
        last = model.stages[-1]
        weights = last.featureImportances.toArray() if self.kind != "logistic" else abs(last.coefficients.toArray())
        names = self.features + [f"{c} missing" for c in self.features]
        return sorted(zip(names, map(float, weights), strict=True), key=lambda x: -x[1])[:top]


def cross_validate(learner: Learner, pairs: DataFrame, folds: int = 4, column: str = "prob") -> tuple[DataFrame, int]:
    """Out-of-fold scores of `pairs` (with y), folds by entity; and the rounds for a fit on all: a tenth more than the mean.

    A fifth of the other folds' entities tells when more trees stop to help.
    """
    parts, kept = [], []
    data = sampling.assign_folds(pairs, folds)
    for k in range(folds):
        train = data.where(F.col("fold") != k).withColumn("_valid", sampling.hash_key(F.col("s1_id"), 7) % 5 == 0)
        model = learner.fit(train, validate=learner.kind == "gbt")
        kept.append(model.stages[-1].getNumTrees if learner.kind == "gbt" else learner.rounds)
        parts.append(learner.predict(model, data.where(F.col("fold") == k), column))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, max(1, int(sum(kept) / folds * 1.1))


def levels(pairs: DataFrame, features: list[str], entities: DataFrame, countries: DataFrame, truth: DataFrame, records: DataFrame, rounds: int = 10, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, list[dict]]:
    """The stack: learners of level 1 with mean logit, level 2 on it and on siblings; each level must be accepted.

    `pairs` has KEY, source, y, prob (level 0), first_num_equal and the features. Returns the pairs with prob of the
    last accepted level and the ablation. Level 2 always sees the mean, accepted or not. `keep` writes a level's
    frame as a table and reads it again.
    """
    pairs = keep(pairs.drop("fold"), "stack_level0")
    base = Learner("gbt", rounds, features=[*features, "prob"])
    data = pairs
    for kind in ("gbt", "forest"):  # learners of unlike bias
        scored, _ = cross_validate(Learner(kind, rounds, features=base.features), pairs, column=f"l1_{kind}")
        data = data.join(scored.select(*KEY, f"l1_{kind}"), KEY)
    data = keep(data.withColumn("l1_mean", mean_probability(["l1_gbt", "l1_forest"])), "stack_level1")
    context = siblings.relational(data.select(*KEY, "source", "first_num_equal", F.col("l1_mean").alias("prob")), records)
    names = [c for c in context.columns if c.startswith("r_")]
    data = keep(data.join(context.select(*KEY, *names), KEY), "stack_siblings")
    second = Learner("gbt", rounds, features=[*base.features, "l1_mean", *names])
    scored, _ = cross_validate(second, data, column="l2")
    data = keep(data.join(scored.select(*KEY, "l2"), KEY), "stack_level2")

    def evaluated(column: str):
        own = data.select(*KEY, F.col(column).alias("prob"))
        decoder, cut, score = decode.tune_decoder(entities, truth, own)
        return decode.per_entity(entities, truth, decode.select_with(own, decoder, cut)), {"name": column, "decoder": decoder, "cut": cut, "f05": score}

    chosen, best = "prob", evaluated("prob")
    rows = [best[1] | {"kept": True}]
    for column in ("l1_gbt", "l1_mean", "l2"):
        now = evaluated(column)
        keep = metrics.accepts(now[0], best[0], countries)
        rows.append(now[1] | {"kept": keep})
        if keep:
            chosen, best = column, now
    return data.withColumn("prob", F.col(chosen)), rows


def leave_one_out(learner: Learner, pairs: DataFrame, column: str = "prob") -> DataFrame:
    """Scores of each country's pairs by a learner that never saw the country; `pairs` has country."""
    names = sorted(r[0] for r in pairs.select("country").distinct().collect())  # a fit for each
    if len(names) < 2:
        raise ValueError(f"nothing is left to learn from without {names}")
    parts = [learner.predict(learner.fit(pairs.where(F.col("country") != c)), pairs.where(F.col("country") == c), column) for c in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
