"""Cut points that turn an ordinal score into classes with the best agreement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.functions.ordering import quantiles, running, step_of, value_buckets

MOST_CANDIDATES = 400


def initial(df: DataFrame, labels: tuple[int, ...]) -> DataFrame:
    """cut (1-based), share, threshold: score quantiles at the cumulative shares of the classes."""
    counts = df.agg(F.count("*").alias("n"), *[F.sum((F.col("y") <= x).cast("long")).alias(f"c{x}") for x in labels[:-1]]).first()
    shares = [(c or 0) / counts["n"] if counts["n"] else 0.0 for c in counts[1:]]
    told = F.array(*[F.lit(s) for s in shares])
    cuts = quantiles(df, "score", shares).select(F.posexplode("q").alias("k", "threshold"))
    return cuts.select((F.col("k") + 1).alias("cut"), told[F.col("k")].alias("share"), "threshold")


def candidates(df: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Midpoints of neighbouring distinct scores; of more than ``most`` distinct ones, of that many exact quantiles of them."""
    distinct = df.select(F.col("score").cast("double").alias("score")).where("score is not null").distinct()
    n = distinct.count()
    if n <= most:
        marks = [r["score"] for r in distinct.collect()]
    else:
        places = np.arange(most) * (n - 1) / (most - 1)
        wanted = np.unique(np.r_[np.floor(places), np.ceil(places)]).astype(int).tolist()
        ranked = running(value_buckets(distinct, "score"), F.col("_bucket"), [F.col("score")], {"upto": F.lit(1)})
        at = {r["upto"] - 1: r["score"] for r in ranked.where((F.col("upto") - 1).isin(wanted)).collect()}
        lo, hi = ([at[int(k)] for k in f(places)] for f in (np.floor, np.ceil))
        marks = (np.array(lo) + (places - np.floor(places)) * (np.array(hi) - np.array(lo))).tolist()
    marks = np.unique(np.array(marks, float))
    return df.sparkSession.createDataFrame([(float(m),) for m in (marks[1:] + marks[:-1]) / 2], "candidate double")


def moments(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Of a table bins x true classes: how many rows, and the sum of their classes, lie in each bin or above (and none beyond the last);
    the rows, and the sums of their classes and of the classes' squares."""
    k = np.arange(table.shape[1])
    above = lambda x: np.r_[np.cumsum(x[::-1])[::-1], 0.0]
    return above(table.sum(axis=1)), above(table @ k), table.sum(), (table @ k).sum(), (table @ (k * k)).sum()


def kappa(m: tuple, cuts: list[np.ndarray]) -> np.ndarray:
    """Agreement where a row's class is the number of cuts at its bin or below. One cut may be an array of several."""
    count, ysum, n, y, yy = m
    p = sum(count[c] for c in cuts)
    pp = sum((2 * j + 1) * count[c] for j, c in enumerate(cuts))  # k squared is the sum of the first k odd numbers
    py = sum(ysum[c] for c in cuts)
    expected = (n * (pp + yy) - 2 * p * y) / max(n, 1)
    return np.where(expected > 1e-12, 1 - (pp + yy - 2 * py) / np.maximum(expected, 1e-12), 0.0)


def search(df: DataFrame, labels: tuple[int, ...], sweeps: int = 3) -> list[float]:
    """Coordinate ascent over the candidates. Rows are first counted by candidate bin and class, so the search itself works on a table of
    at most MOST_CANDIDATES + 1 times len(labels) numbers."""
    marks = sorted(r["candidate"] for r in candidates(df).collect())
    if not marks:
        return [0.0] * (len(labels) - 1)
    # a mark's bin is that of the scores above it
    binned = step_of(df.where("score is not null"), "score", np.nextafter(marks, np.inf).tolist(), "bin")
    table = np.zeros((len(marks) + 1, len(labels)))
    for r in binned.groupBy("bin", "y").count().collect():
        if r["y"] in labels:
            table[r["bin"], labels.index(r["y"])] += r["count"]
    m = moments(table)
    start = [r["threshold"] for r in initial(df, labels).orderBy("cut").collect()]
    cuts = [min(int(np.searchsorted(marks, t)) + 1, len(marks)) for t in start]
    best = float(kappa(m, cuts))
    for _ in range(sweeps):
        moved = False
        for j in range(len(cuts)):
            lo, hi = cuts[j - 1] if j else 0, cuts[j + 1] if j + 1 < len(cuts) else len(marks)
            got = kappa(m, [*cuts[:j], np.arange(lo, hi + 1), *cuts[j + 1 :]])
            if got.max() > best + 1e-9:
                best, cuts[j], moved = float(got.max()), lo + int(got.argmax()), True
        if not moved:
            break
    full = [marks[0] - 1, *marks, marks[-1] + 1]
    return [float(full[c]) for c in cuts]
