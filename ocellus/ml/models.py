"""Ordinal classifiers on pyspark.ml, all with the same face: fit on a DataFrame, transform adds ``prediction`` and ``score``."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.scalars import LABELS, cut, expected_class
from ocellus.operators import metrics, thresholds
from ocellus.operators.splits import random_folds


class QwkEvaluator(Evaluator):
    """Quadratic weighted kappa of ``prediction`` against ``grade``: larger is better."""

    def __init__(self, labels=LABELS):
        super().__init__()
        self.labels = labels

    def _evaluate(self, dataset: DataFrame) -> float:
        got = metrics.qwk(dataset.select(F.col("grade").alias("y"), F.col("prediction").cast("int").alias("p")), self.labels)
        return float(got.first()["qwk"])

    def isLargerBetter(self) -> bool:
        return True


def preprocessing(columns: list[str], scaled: bool = True) -> list:
    """Medians (to a thousandth of the rows' order) for what is missing; no constant columns, mean zero and deviation one. Trees do without
    the last two."""
    filled = [f"{c}__f" for c in columns]
    imputer = Imputer(inputCols=columns, outputCols=filled, strategy="median", relativeError=0.001)
    if not scaled:
        return [imputer, VectorAssembler(inputCols=filled, outputCol="features")]
    return [
        imputer,
        VectorAssembler(inputCols=filled, outputCol="raw_vector"),
        VarianceThresholdSelector(featuresCol="raw_vector", outputCol="kept_vector", varianceThreshold=1e-10),
        StandardScaler(inputCol="kept_vector", outputCol="features", withMean=True, withStd=True),
    ]


def balanced(df: DataFrame) -> DataFrame:
    """Adds weight: each class has the same sum. The class counts are one row a class."""
    n = df.groupBy("grade").count().collect()
    total = sum(r["count"] for r in n)
    weights = F.create_map(*[F.lit(x) for r in n for x in (r["grade"], total / (len(n) * r["count"]))])
    return df.withColumn("weight", weights[F.col("grade")])


@dataclass
class Fitted:
    """A trained model: its name, columns, pipeline, and how its output becomes a class and a score."""

    name: str
    columns: list[str]
    labels: tuple[int, ...]
    model: PipelineModel | None
    cuts: list[float] | None = None
    shares: list[float] | None = None
    majority: int | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:  # what new data lack is missing, not an error
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        if self.name == "dummy_frequent":
            return df.withColumn("prediction", F.lit(self.majority)).withColumn("score", F.lit(float(self.majority)))
        if self.name == "dummy_stratified":
            u = F.conv(F.substring(F.md5(F.concat(F.lit("draw:"), F.col("image_id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
            p = F.lit(self.labels[-1])
            for label, upto in reversed(list(zip(self.labels, np.cumsum(self.shares), strict=True))):
                p = F.when(u < float(upto), F.lit(label)).otherwise(p)
            return df.withColumn("prediction", p.cast("int")).withColumn("score", F.col("prediction").cast("double"))
        drop = [c for c in self.model.transform(df.limit(0)).columns if c not in df.columns]
        out = self.model.transform(df)
        if self.cuts is not None:
            out = out.withColumn("score", F.col("value")).withColumn("_p", F.element_at(F.array(*[F.lit(x) for x in self.labels]), cut(F.col("value"), self.cuts) + 1))
        else:
            out = out.withColumn("score", _score(out, self.labels)).withColumn("_p", F.col("prediction").cast("int"))
        return out.drop(*[c for c in drop if c not in ("score", "_p")]).withColumnRenamed("_p", "prediction")

    def save(self, path: str) -> None:
        from ocellus.sources.tables import save_json

        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/pipeline")
        save_json({"name": self.name, "columns": self.columns, "labels": self.labels, "cuts": self.cuts, "shares": self.shares, "majority": self.majority}, f"{path}/model.json")

    @staticmethod
    def load(path: str) -> Fitted:
        from ocellus.sources.tables import load_json

        d = load_json(f"{path}/model.json")
        dummy = d["name"].startswith("dummy")
        return Fitted(d["name"], d["columns"], tuple(d["labels"]), None if dummy else PipelineModel.load(f"{path}/pipeline"), d["cuts"], d["shares"], d["majority"])


def _score(out: DataFrame, labels) -> Column:
    """Expected class of the probabilities; of one-against-rest models, of the raw values' softmax."""
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return expected_class(F.slice(p, 1, len(labels)), labels)
    raw = vector_to_array("rawPrediction")
    top = F.array_max(raw)
    e = F.transform(raw, lambda x: F.exp(x - top))
    return expected_class(e, labels) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)


@dataclass(frozen=True)
class Spec:
    """What a model is, how its settings are drawn, and how it is built of them."""

    text: str
    sample: Callable[[np.random.Generator], dict[str, Any]]
    build: Callable[[dict[str, Any], int, int], Any] | None


def _log(rng: np.random.Generator, lo: float, hi: float) -> float:
    return float(np.exp(rng.uniform(np.log(lo), np.log(hi))))


def _logreg(p, seed, n):
    return LogisticRegression(labelCol="grade", featuresCol="features", weightCol="weight", family="multinomial", elasticNetParam=0.0, regParam=1.0 / (p.get("c", 1.0) * n), maxIter=200)


def _forest(p, seed, n):
    return RandomForestClassifier(labelCol="grade", featuresCol="features", weightCol="weight", seed=seed, numTrees=p.get("trees", 100), maxDepth=p.get("depth", 10), minInstancesPerNode=p.get("leaf", 2), featureSubsetStrategy=p.get("features", "sqrt"))


def _boosted(p, seed, n):
    one = GBTClassifier(seed=seed, maxIter=p.get("iterations", 60), stepSize=p.get("rate", 0.1), maxDepth=p.get("depth", 4), minInstancesPerNode=p.get("leaf", 10), subsamplingRate=0.9)
    return OneVsRest(classifier=one, labelCol="grade", featuresCol="features", weightCol="weight")


def _regressor(p, seed, n):
    return GBTRegressor(labelCol="grade", featuresCol="features", predictionCol="value", seed=seed, maxIter=p.get("iterations", 60), stepSize=p.get("rate", 0.1), maxDepth=p.get("depth", 4), minInstancesPerNode=p.get("leaf", 10), subsamplingRate=0.9)


def _boost_space(rng):
    return {"rate": _log(rng, 0.02, 0.3), "depth": int(rng.integers(2, 7)), "leaf": int(rng.integers(5, 40)), "iterations": int(rng.integers(30, 150))}


MODELS = {
    "dummy_frequent": Spec("the most frequent grade", lambda rng: {}, None),
    "dummy_stratified": Spec("grades drawn by their shares", lambda rng: {}, None),
    "logreg": Spec("multinomial logistic regression", lambda rng: {"c": _log(rng, 1e-3, 1e2)}, _logreg),
    "random_forest": Spec("random forest", lambda rng: {"trees": int(rng.integers(50, 300)), "depth": int(rng.integers(4, 20)), "leaf": int(rng.integers(1, 12)), "features": str(rng.choice(["sqrt", "log2", "0.3"]))}, _forest),
    "hist_gbm": Spec("boosted trees, one against the rest", _boost_space, _boosted),
    "ordinal_gbm": Spec("boosted regression of the grade, cut where agreement is best", _boost_space, _regressor),
}
BASELINES = ("dummy_frequent", "dummy_stratified")


def fit(name: str, df: DataFrame, columns: list[str], params: dict[str, Any] | None = None, seed: int = 42, labels=LABELS, cv: int = 5) -> Fitted:
    """``df``: image_id, grade and the columns. Raises on an unknown name, and on one class alone."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")
    params = params or {}
    counts = {r["grade"]: r["count"] for r in df.groupBy("grade").count().collect()}
    if name == "dummy_frequent":
        return Fitted(name, columns, labels, None, majority=min(counts, key=lambda g: (-counts[g], g)))
    if name == "dummy_stratified":
        return Fitted(name, columns, labels, None, shares=[counts.get(x, 0) / sum(counts.values()) for x in labels])
    if len(counts) < 2:
        raise ValueError("one class alone can't be learnt")
    n, stages = sum(counts.values()), preprocessing(columns, scaled=name == "logreg")
    rows = balanced(df.select("image_id", "grade", *columns)).persist()  # every stage and every tree reads them
    try:
        if name != "ordinal_gbm":
            return Fitted(name, columns, labels, Pipeline(stages=[*stages, MODELS[name].build(params, seed, n)]).fit(rows))
        cuts = thresholds.search(_apart(rows, stages, params, seed, n, cv), labels)
        return Fitted(name, columns, labels, Pipeline(stages=[*stages, _regressor(params, seed, n)]).fit(rows), cuts)
    finally:
        rows.unpersist()


def _apart(rows: DataFrame, stages: list, params: dict[str, Any], seed: int, n: int, cv: int) -> DataFrame:
    """y, score of every row, by a regressor that didn't see it: what cut points come from."""
    folded = random_folds(rows, cv, seed)

    def one(k: int) -> DataFrame:
        model = Pipeline(stages=[*stages, _regressor(params, seed, n)]).fit(folded.where(F.col("fold") != k))
        return model.transform(folded.where(F.col("fold") == k)).select(F.col("grade").alias("y"), F.col("value").alias("score"))

    with ThreadPoolExecutor(cv) as pool:
        return functools.reduce(DataFrame.unionByName, pool.map(one, range(cv)))
