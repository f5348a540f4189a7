"""Folds and hold-outs that never split a group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.functions.ordering import hash_bucket, running
from ocellus.functions.scalars import LABELS
from ocellus.operators.manifest import group_sizes


class LeakageError(RuntimeError):
    """A group is on both sides of a split."""


def groups_per_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grade").agg(F.count_distinct("group").alias("n_groups"))


def safe_n_splits(rows: DataFrame, requested: int) -> DataFrame:
    """One row, n_splits: no more folds than the rarest class has groups, and two at least."""
    return groups_per_class(rows).agg(F.greatest(F.lit(2), F.least(F.lit(requested), F.min("n_groups"))).cast("int").alias("n_splits"))


def group_folds(rows: DataFrame, n_splits: int, seed: int = 42) -> DataFrame:
    """group, worst, n, fold: within each worst grade, groups in hash order are dealt to the folds in turn.

    Places in the order are counted within hash buckets and over them, so no task holds all groups of a grade.
    """
    sizes = group_sizes(rows).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("group"))))
    out = running(sizes, hash_bucket(F.col("h")), [F.col("h"), F.col("group")], {"place": F.lit(1)}, by=("worst",))
    return out.select("group", "worst", "n", F.pmod(F.col("place") - 1, F.lit(n_splits)).cast("int").alias("fold"))


def with_folds(rows: DataFrame, n_splits: int, seed: int = 42) -> DataFrame:
    return rows.join(group_folds(rows, n_splits, seed).select("group", "fold"), "group")


def greedy_folds(counts: np.ndarray, n_splits: int, seed: int = 42) -> np.ndarray:
    """Folds of groups by their class counts (groups x classes): groups with the most uneven counts first, each to the fold that
    leaves the classes' shares over the folds most even, the smaller fold at a tie. For cohorts whose groups fit one machine."""
    order = np.random.default_rng(seed).permutation(len(counts))
    order = order[np.argsort(-counts[order].std(axis=1), kind="stable")]
    folds, totals = np.zeros((n_splits, counts.shape[1])), np.maximum(counts.sum(axis=0), 1)
    out = np.zeros(len(counts), int)
    for g in order:
        spread = []
        for k in range(n_splits):
            trial = folds.copy()
            trial[k] += counts[g]
            spread.append((round((trial / totals).std(axis=0).mean(), 12), folds[k].sum(), k))
        out[g] = min(spread)[2]
        folds[out[g]] += counts[g]
    return out


def random_folds(rows: DataFrame, n_splits: int, seed: int = 42, key: str = "image_id") -> DataFrame:
    """Folds by row, blind to groups; what the leakage audit compares with."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n_splits)).cast("int"))


def holdout(rows: DataFrame, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds test: the rows of fold zero of about 1 / test_size folds."""
    wanted = round(1 / min(max(test_size, 0.05), 0.5))
    k = safe_n_splits(rows, wanted).first()["n_splits"]
    out = with_folds(rows, k, seed).withColumn("test", F.col("fold") == 0).drop("fold")
    if out.where("test").agg(F.count_distinct("grade")).first()[0] < 2:
        raise ValueError("the hold-out has one class alone")
    return out


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("group").distinct().join(test.select("group"), "group", "left_semi")


def verify_no_leakage(train: DataFrame, test: DataFrame) -> None:
    some = overlap(train, test).limit(5).collect()
    if some:
        raise LeakageError("groups on both sides: " + ", ".join(str(r["group"]) for r in some))


def split_summary(rows: DataFrame, side: str = "test", labels=LABELS) -> DataFrame:
    """For each side its rows, groups, and rows of each label (zero where it has none)."""
    per_label = [F.sum((F.col("grade") == x).cast("long")).alias(f"grade_{x}") for x in labels]
    return rows.groupBy(side).agg(F.count("*").alias("n_rows"), F.count_distinct("group").alias("n_groups"), *per_label)
