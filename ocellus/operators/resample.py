"""Bootstrap intervals and tests. The metrics depend on the rows through confusion cells alone, so resampling draws the cells'
counts: the cost doesn't grow with the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions.scalars import LABELS


def kappa_of(m: np.ndarray) -> np.ndarray:
    """Quadratic weighted kappa of confusion matrices (..., K, K)."""
    k = m.shape[-1]
    d = (np.arange(k)[:, None] - np.arange(k)[None, :]) ** 2
    n = m.sum(axis=(-1, -2))
    expected = (m.sum(-1)[..., :, None] * m.sum(-2)[..., None, :] * d).sum(axis=(-1, -2)) / np.maximum(n, 1)
    return np.where(expected > 1e-12, 1 - (m * d).sum(axis=(-1, -2)) / np.where(expected > 1e-12, expected, 1), 0.0)


def balanced_of(m: np.ndarray) -> np.ndarray:
    n = m.sum(-1)
    recall = np.where(n > 0, np.diagonal(m, axis1=-2, axis2=-1) / np.maximum(n, 1), np.nan)
    return np.nan_to_num(np.nanmean(recall, axis=-1)) if m.size else np.zeros(m.shape[:-2])


def macro_f1_of(m: np.ndarray) -> np.ndarray:
    both = m.sum(-1) + m.sum(-2)
    return np.where(both > 0, 2 * np.diagonal(m, axis1=-2, axis2=-1) / np.maximum(both, 1), 0.0).mean(-1)


METRICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"qwk": kappa_of, "balanced_accuracy": balanced_of, "macro_f1": macro_f1_of}


def matrix(df: DataFrame, labels=LABELS, y: str = "y", p: str = "p") -> np.ndarray:
    m = np.zeros((len(labels), len(labels)), np.int64)
    for r in df.where(F.col(y).isin(*labels) & F.col(p).isin(*labels)).groupBy(y, p).count().collect():  # one row a cell
        m[labels.index(r[0]), labels.index(r[1])] = r[2]
    return m


def _draws(spark: SparkSession, n: int, one: Callable[[np.random.Generator], float], seed: int) -> DataFrame:
    """draw, value: each draw has a generator of its own, so the result doesn't depend on partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"draw": b["id"], "value": [one(np.random.default_rng([seed, int(i)])) for i in b["id"]]})

    return spark.range(n).mapInPandas(run, "draw long, value double")


def bootstrap_ci(df: DataFrame, metric: str = "qwk", n: int = 2000, alpha: float = 0.05, seed: int = 42, stratify: bool = True, labels=LABELS) -> DataFrame:
    """point, low, high by the percentile method, resampled within the true classes. Under 8 rows or 10 draws all three are the point."""
    m, f = matrix(df, labels), METRICS[metric]
    point = float(f(m.astype(float)))
    if m.sum() < 8 or n < 10:
        return df.sparkSession.createDataFrame([(point, point, point)], "point double, low double, high double")

    def one(rng: np.random.Generator) -> float:
        if stratify:
            return float(f(np.stack([rng.multinomial(r.sum(), r / r.sum()) if r.sum() else r for r in m]).astype(float)))
        return float(f(rng.multinomial(m.sum(), m.ravel() / m.sum()).reshape(m.shape).astype(float)))

    got = _draws(df.sparkSession, n, one, seed).agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return got.select(F.lit(point).alias("point"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_bootstrap(df: DataFrame, a: str = "pa", b: str = "pb", metric: str = "qwk", n: int = 2000, seed: int = 42, labels=LABELS) -> DataFrame:
    """difference (a less b), low, high, p_value of two predictions of the same rows, resampled together."""
    k, f = len(labels), METRICS[metric]
    t = np.zeros((k, k, k), np.int64)
    known = F.col("y").isin(*labels) & F.col(a).isin(*labels) & F.col(b).isin(*labels)
    for r in df.where(known).groupBy("y", a, b).count().collect():  # one row a cell
        t[labels.index(r[0]), labels.index(r[1]), labels.index(r[2])] = r[3]
    diff = lambda c: float(f(c.sum(2).astype(float)) - f(c.sum(1).astype(float)))
    point = diff(t)
    if t.sum() < 8:
        return df.sparkSession.createDataFrame([(point, point, point, 1.0)], "difference double, low double, high double, p_value double")
    one = lambda rng: diff(rng.multinomial(t.sum(), t.ravel() / t.sum()).reshape(t.shape))
    wrong = (F.col("value") <= 0) if point > 0 else (F.col("value") >= 0)
    got = _draws(df.sparkSession, n, one, seed).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(wrong.cast("double")).alias("w"))
    return got.select(F.lit(point).alias("difference"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.least(F.lit(1.0), 2 * F.col("w")).alias("p_value"))
