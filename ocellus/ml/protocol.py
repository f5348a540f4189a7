"""The evaluation protocol: search, hold-out, nested cross-validation, leakage audit, importance, ablation, and the bundle of results."""

from __future__ import annotations

import itertools
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.config import Config
from ocellus.functions.ordering import running
from ocellus.functions.scalars import FAMILIES, LABELS
from ocellus.ml.models import BASELINES, MODELS, Fitted, QwkEvaluator, fit
from ocellus.operators import metrics, resample, splits
from ocellus.operators.extract import feature_columns, varying


def cross_validate(name: str, rows: DataFrame, columns: list[str], params: dict, folds: int, seed: int, labels=LABELS) -> list[float]:
    """Agreement on each fold of the column ``fold``; a fit that fails scores zero. The folds run side by side: small jobs leave most cores idle."""

    def one(k: int) -> float:
        try:
            got = fit(name, rows.where(F.col("fold") != k), columns, params, seed, labels)
            return QwkEvaluator(labels).evaluate(got.transform(rows.where(F.col("fold") == k)))
        except ValueError:
            return 0.0

    with ThreadPoolExecutor(folds) as pool:
        return list(pool.map(one, range(folds)))


@dataclass
class Search:
    name: str
    params: dict[str, Any]
    qwk: float
    std: float


def search(name: str, rows: DataFrame, columns: list[str], n_iter: int, folds: int, seed: int, labels=LABELS, parallel: int = 2) -> Search:
    """The settings with the best mean agreement over group-disjoint folds; ties to the first drawn."""
    rng = np.random.default_rng(seed)
    k = splits.safe_n_splits(rows, folds).first()["n_splits"]
    folded = splits.with_folds(rows, k, seed).persist()
    drawn = [MODELS[name].sample(rng) for _ in range(1 if name in BASELINES else max(1, n_iter))]
    with ThreadPoolExecutor(parallel) as pool:
        scores = list(pool.map(lambda p: cross_validate(name, folded, columns, p, k, seed, labels), drawn))
    folded.unpersist()
    best = max(range(len(drawn)), key=lambda i: (np.mean(scores[i]), -i))
    return Search(name, drawn[best], float(np.mean(scores[best])), float(np.std(scores[best])))


def evaluate(model: Fitted, test: DataFrame, cfg: Config, labels=LABELS) -> tuple[dict[str, Any], DataFrame]:
    """All metrics and intervals on the hold-out, and its predictions: image_id, group, grade, prediction, score."""
    pred = model.transform(test).select("image_id", "group", "grade", "prediction", "score").persist()
    pairs = pred.select(F.col("grade").alias("y"), F.col("prediction").alias("p"), "score")
    out = metrics.classification_bundle(pairs, labels).first().asDict()
    out |= {f"referable_{k}": v for k, v in metrics.referable_metrics(pairs, cfg.modeling.referable_threshold_grade, cfg.modeling.target_sensitivity).first().asDict().items()}
    for m in ("qwk", "balanced_accuracy", "macro_f1"):
        r = resample.bootstrap_ci(pairs, m, cfg.modeling.n_bootstrap, seed=cfg.seed, labels=labels).first()
        out[f"{m}_interval"] = [r["low"], r["high"]]
    out["confusion"] = resample.matrix(pairs, labels).tolist()
    return out, pred


def nested(rows: DataFrame, columns: list[str], names: tuple[str, ...], cfg: Config, labels=LABELS) -> list[dict[str, Any]]:
    """For each outer fold and model its agreement, with settings searched inside the other folds."""
    m = cfg.modeling
    k = splits.safe_n_splits(rows, m.nested_outer_folds).first()["n_splits"]
    folded = splits.with_folds(rows, k, cfg.seed + 1000).withColumnRenamed("fold", "outer").persist()
    out = []
    for fold in range(k):
        inner, outer = folded.where(F.col("outer") != fold), folded.where(F.col("outer") == fold)
        for name in names:
            best = search(name, inner, columns, max(8, m.n_search_iter // 3) if m.n_search_iter >= 8 else m.n_search_iter, m.cv_folds, cfg.seed + 100 + fold, labels)
            model = fit(name, inner, columns, best.params, cfg.seed, labels)
            out.append({"model": name, "fold": fold, "qwk": QwkEvaluator(labels).evaluate(model.transform(outer))})
    folded.unpersist()
    return out


def leakage_audit(rows: DataFrame, columns: list[str], name: str, cfg: Config, labels=LABELS) -> dict[str, Any]:
    """Agreement of an untuned model with folds by group and by row; the difference is what a blind split would overstate."""
    k = splits.safe_n_splits(rows, cfg.modeling.cv_folds).first()["n_splits"]
    got = {}
    for kind, folded in (("grouped", splits.with_folds(rows, k, cfg.seed)), ("random", splits.random_folds(rows, k, cfg.seed))):
        got[kind] = float(np.mean(cross_validate(name, folded.persist(), columns, {}, k, cfg.seed, labels)))
        folded.unpersist()
    return {"model": name, "grouped_qwk": got["grouped"], "random_qwk": got["random"], "optimism": got["random"] - got["grouped"]}


def _multipliers(n: int, most: int = 1000) -> list[int]:
    """The first numbers from n / 3 on that are prime to n. Only so many are looked for: the driver's memory doesn't grow with n."""
    return list(itertools.islice((p for p in range(max(2, n // 3), 2 * n + 10) if math.gcd(p, n) == 1), most)) or [1]


def permutation_importance(model: Fitted, test: DataFrame, columns: list[str], repeats: int, seed: int = 42, labels=LABELS, at_once: int = 16) -> DataFrame:
    """feature, importance, std, family: the loss of agreement when a column's values change rows.

    Rows are numbered; for each column and repeat, row i takes the value of row (a i + b) mod n with a prime to n. Only the numbers and
    the values that move are shuffled, for ``at_once`` columns at a time; a row then meets its own new values (at_once * repeats of
    them), and whole rows stay where they are. One aggregate gives the agreements of all these columns and repeats.
    """
    numbered = running(test.select("image_id", "grade", *columns).withColumn("h", F.md5(F.col("image_id").cast("string"))), F.conv(F.substring("h", 1, 3), 16, 10).cast("int"), [F.col("h"), F.col("image_id")], {"i": F.lit(1)}).withColumn("i", (F.col("i") - 1).cast("long")).drop("h").persist()
    n = numbered.count()
    base = QwkEvaluator(labels).evaluate(model.transform(numbered))
    rng = np.random.default_rng(seed)
    primes = _multipliers(n)
    out = None
    for at in range(0, len(columns), at_once):
        some = columns[at : at + at_once]
        plan = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("repeat"), F.lit(int(rng.choice(primes))).cast("long").alias("a"), F.lit(int(rng.integers(0, max(n, 1)))).cast("long").alias("b")) for k in range(len(some)) for r in range(repeats)])
        wanted = numbered.select("i", F.explode(plan).alias("x")).select("i", "x.k", "x.repeat", F.pmod(F.col("x.a") * F.col("i") + F.col("x.b"), F.lit(n)).alias("j"))
        source = numbered.select(F.col("i").alias("j"), F.array(*[F.col(c).cast("double") for c in some]).alias("values"))
        new = wanted.join(source, "j").select("i", F.struct("k", "repeat", F.col("values")[F.col("k")].alias("value")).alias("x")).groupBy("i").agg(F.collect_list("x").alias("new"))
        moved = numbered.join(new, "i").withColumn("x", F.explode("new"))
        moved = moved.select("image_id", "grade", F.col("x.k").alias("k"), F.col("x.repeat").alias("repeat"), *[F.when(F.col("x.k") == some.index(c), F.col("x.value")).otherwise(F.col(c).cast("double")).alias(c) if c in some else F.col(c) for c in columns])
        pairs = model.transform(moved).select("k", "repeat", F.col("grade").alias("y"), F.col("prediction").cast("int").alias("p"))
        names = F.array(*[F.lit(c) for c in some])
        part = pairs.groupBy("k", "repeat").agg(metrics.kappa_columns(labels).alias("qwk")).select(names[F.col("k")].alias("feature"), "repeat", "qwk")
        out = part if out is None else out.unionByName(part)
    family = F.split("feature", "_")[0]
    got = out.groupBy("feature").agg(F.avg(F.lit(base) - F.col("qwk")).alias("importance"), F.stddev_pop("qwk").alias("std"))
    return got.withColumn("family", F.when(family.startswith("zone"), "zone").otherwise(F.coalesce(F.when(family.isin(*FAMILIES), family), F.lit("other"))))


def family_of(column: str) -> str:
    head = column.split("_")[0]
    return "zone" if head.startswith("zone") else head if head in FAMILIES else "other"


def family_ablation(rows: DataFrame, columns: list[str], name: str, cfg: Config, labels=LABELS, family=family_of) -> list[dict[str, Any]]:
    """Agreement with all columns, with one family alone, and without it; best family first."""
    k = splits.safe_n_splits(rows, cfg.modeling.cv_folds).first()["n_splits"]
    folded = splits.with_folds(rows, k, cfg.seed).persist()
    mean = lambda cols: float(np.mean(cross_validate(name, folded, cols, {}, k, cfg.seed, labels))) if cols else 0.0
    every = mean(columns)
    out = []
    for f in sorted({family(c) for c in columns}):
        own = [c for c in columns if family(c) == f]
        only, without = mean(own), mean([c for c in columns if family(c) != f])
        out.append({"family": f, "n": len(own), "all_qwk": every, "only_qwk": only, "without_qwk": without, "loss": every - without})
    folded.unpersist()
    return sorted(out, key=lambda r: -r["only_qwk"])


@dataclass
class Results:
    """What a training run found, and its chosen model."""

    summary: dict[str, Any]
    chosen: Fitted
    predictions: DataFrame
    importance: DataFrame | None = None
    models: dict[str, Fitted] = field(default_factory=dict)


def run(features: DataFrame, cfg: Config, labels=LABELS) -> Results:
    """Hold-out, search and evaluation of each model, choice by cross-validation alone, then the audits.

    Nested folds and the leakage audit use all rows, the hold-out too, after the choice is made. The referral threshold is chosen on the
    hold-out, so its sensitivity and specificity there are optimistic.
    """
    began = time.time()
    columns = varying(features, feature_columns(features))
    rows = features.select("image_id", "group", "grade", *columns).persist()
    split = splits.holdout(rows, cfg.modeling.test_size, cfg.seed).persist()
    train, test = split.where("not test").drop("test"), split.where("test").drop("test")
    splits.verify_no_leakage(train, test)
    names = (*BASELINES, *cfg.modeling.models)
    summary: dict[str, Any] = {"n_rows": rows.count(), "n_features": len(columns), "split": [r.asDict() for r in splits.split_summary(split).collect()], "models": {}}
    fitted, long = {}, None
    for name in names:
        best = search(name, train, columns, cfg.modeling.n_search_iter, cfg.modeling.cv_folds, cfg.seed, labels)
        fitted[name] = fit(name, train, columns, best.params, cfg.seed, labels)
        got, pred = evaluate(fitted[name], test, cfg, labels)
        summary["models"][name] = {"params": best.params, "cv_qwk": best.qwk, "cv_std": best.std} | got
        pred = pred.withColumn("model", F.lit(name))
        long = pred if long is None else long.unionByName(pred)
    rank = sorted(cfg.modeling.models, key=lambda m: -summary["models"][m]["cv_qwk"])
    chosen = rank[0]
    summary["selected"] = chosen
    wide = long.groupBy("image_id", F.col("grade").alias("y")).pivot("model", list(names)).agg(F.first("prediction"))
    for what, other in (("against_baseline", "dummy_stratified"), *((("against_runner_up", rank[1]),) if len(rank) > 1 else ())):
        summary[what] = {"model": other} | resample.paired_bootstrap(wide, chosen, other, n=cfg.modeling.n_bootstrap, seed=cfg.seed, labels=labels).first().asDict()
    if cfg.modeling.nested_cv:
        summary["nested_cv"] = nested(rows, columns, cfg.modeling.models, cfg, labels)
    summary["leakage_audit"] = leakage_audit(rows, columns, chosen, cfg, labels)
    importance = None
    if cfg.modeling.permutation_repeats:
        importance = permutation_importance(fitted[chosen], test, columns, cfg.modeling.permutation_repeats, cfg.seed, labels).persist()
        summary["importance"] = [r.asDict() for r in importance.orderBy(F.desc("importance"), "feature").collect()]  # one row a column
        summary["family_importance"] = [r.asDict() for r in importance.groupBy("family").agg(F.sum(F.greatest("importance", F.lit(0.0))).alias("importance")).orderBy(F.desc("importance")).collect()]
    summary["ablation"] = family_ablation(train, columns, chosen, cfg, labels)
    summary["referable_threshold"] = summary["models"][chosen]["referable_threshold"]
    summary["runtime_seconds"] = time.time() - began
    return Results(summary, fitted[chosen], long, importance, fitted)
