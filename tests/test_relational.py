"""Manifest, quality, splits, metrics, thresholds and resampling: contracts, degenerate cases, golden values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.functions import ordering, scalars
from ocellus.operators import cache, manifest, metrics, quality, resample, splits, thresholds
from ocellus.operators.manifest import LabelJoinError

#: Confusion matrices (rows true, columns predicted) with their agreement, balanced accuracy, macro F1, accuracy and mean error.
GOLDEN = [
    ([[19, 10, 4, 0, 0], [7, 4, 5, 0, 0], [3, 1, 11, 4, 1], [0, 0, 2, 1, 3], [0, 0, 1, 0, 6]], (0.762, 0.480, 0.454, 0.500, 0.61)),
    ([[30, 1, 2, 0, 0], [11, 3, 2, 0, 0], [4, 2, 12, 0, 2], [0, 1, 3, 1, 1], [0, 0, 1, 0, 6]], (0.792, 0.544, 0.533, 0.634, 0.49)),
    ([[26, 5, 2, 0, 0], [9, 4, 3, 0, 0], [4, 2, 13, 0, 1], [1, 0, 3, 1, 1], [0, 0, 0, 0, 7]], (0.787, 0.571, 0.561, 0.622, 0.49)),
    ([[30, 1, 2, 0, 0], [12, 4, 0, 0, 0], [6, 2, 7, 4, 1], [1, 0, 1, 1, 3], [1, 0, 0, 0, 6]], (0.729, 0.507, 0.485, 0.585, 0.59)),
]


def pairs(spark, matrix):
    return spark.createDataFrame([(y, p) for y, r in enumerate(matrix) for p, n in enumerate(r) for _ in range(n)], "y int, p int")


@pytest.mark.parametrize("matrix, want", GOLDEN)
def test_golden(spark, matrix, want):
    got = metrics.classification_bundle(pairs(spark, matrix)).first()
    assert (round(got.qwk, 3), round(got.balanced_accuracy, 3), round(got.macro_f1, 3), round(got.accuracy, 3), round(got.mae, 2)) == want
    m = np.array(matrix, float)
    assert np.isclose(resample.kappa_of(m), got.qwk) and np.isclose(resample.balanced_of(m), got.balanced_accuracy) and np.isclose(resample.macro_f1_of(m), got.macro_f1)


def test_degenerate_metrics(spark):
    constant = spark.createDataFrame([(y, 0) for y in (0, 1, 2, 3, 4) * 3], "y int, p int")
    assert metrics.qwk(constant).first()[0] == 0.0
    absent = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "y int, p int")
    assert round(metrics.balanced_accuracy(absent).first()[0], 6) == 0.5
    assert round(metrics.macro_f1(absent).first()[0], 6) == round((0.5 + 0.8) / 5, 6)
    assert metrics.qwk(constant.limit(0)).first()[0] == 0.0


def test_ranking_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 5, 300), rng.integers(0, 40, 300) / 8.0
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist(), strict=True)), "y int, score double")
    got = metrics.referable_metrics(df).first()
    pos = y >= 2
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[pos] for b in s[~pos]])
    assert np.isclose(got.auroc, auc)
    points = [(t, (s[pos] >= t).mean(), (s[~pos] >= t).mean()) for t in np.unique(s)]
    ok = [(fpr, -t, tpr) for t, tpr, fpr in points if tpr >= 0.9]
    assert got.sensitivity >= 0.9 and got.specificity <= 1 - min(ok)[0] + 1e-12
    ap, last = 0.0, 0.0
    for t, tpr, _ in sorted(points, reverse=True):
        ap += (tpr - last) * pos[s >= t].mean()
        last = tpr
    assert np.isclose(got.average_precision, ap)


def test_one_class_has_no_ranking(spark):
    got = metrics.referable_metrics(spark.createDataFrame([(0, 0.1), (1, 0.7)], "y int, score double")).first()
    assert got.auroc is None and got.threshold is None and got.sensitivity is None


def test_running_equals_a_global_window(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 7).alias("n"))
    got = {r.h: r.t for r in ordering.running(df, ordering.hash_bucket(F.col("h")), [F.col("h")], {"t": F.col("n")}).collect()}
    total = 0
    for h, n in sorted((r.h, r.n) for r in df.collect()):
        total += n
        assert got[h] == total


def test_groups(spark):
    df = spark.createDataFrame([("10_left",), ("10_RIGHT",), ("p0007_left",), ("odd",)], "i string")
    got = [r[0] for r in df.select(scalars.derive_group(F.col("i"), r"(p?\d+)_(?:left|right)")).collect()]
    assert got == ["10", "10", "p0007", "odd"]
    assert [r[0] for r in df.select(scalars.derive_group(F.col("i"), None)).collect()] == ["10_left", "10_RIGHT", "p0007_left", "odd"]


def raw(spark):
    rows = [("P1_LEFT.JPG ", "2"), ("p1_left", "3"), ("p1_right.png", "n/a"), ("p2_left", "1.9"), ("p2_right.jpe", "0")]
    return spark.createDataFrame(rows, "weird_name string, severity string").coalesce(1)


def test_labels(spark):
    got = {r.image_id: r.grade for r in manifest.clean_labels(raw(spark), "weird_name", "severity").collect()}
    assert got == {"p1_left": 2, "p2_left": 1, "p2_right.jpe": 0}
    assert manifest.coercion_audit(raw(spark), "weird_name", "severity").first().asDict() == {"n_rows": 5, "n_bad_labels": 1, "n_duplicates": 1, "n_usable": 3}


def test_columns_are_guessed(spark):
    df = spark.createDataFrame([(f"img{k}", k % 4, k / 7) for k in range(40)], "name string, severity int, other double")
    assert manifest.guess_id_column(df) == "name"
    assert manifest.guess_label_column(df, "name") == "severity"


def cohort(spark, patients=200):
    rng = np.random.default_rng(1)
    rows = []
    for p in range(patients):
        base = int(rng.choice(5, p=[0.73, 0.07, 0.15, 0.03, 0.02]))
        rows += [(f"{p}_{eye}", f"/x/{p}_{eye}.png", int(np.clip(base + rng.integers(-1, 2), 0, 4)), str(p)) for eye in ("left", "right")]
    return spark.createDataFrame(rows, "image_id string, image_path string, grade int, group string")


def test_sampling_keeps_groups_whole(spark):
    full = cohort(spark)
    for strategy in ("prevalence", "balanced"):
        got = manifest.subsample(full, 120, strategy)
        n = got.count()
        assert 120 <= n <= 130
        assert got.groupBy("group").count().where("count != 2").count() == 0
        assert {r.image_id for r in got.collect()} == {r.image_id for r in manifest.subsample(full, 120, strategy).collect()}
    assert manifest.subsample(full, 10_000).count() == 400
    share = lambda d: d.where("grade >= 3").count() / d.count()
    assert share(manifest.subsample(full, 100, "balanced")) > share(manifest.subsample(full, 100))
    with pytest.raises(ValueError):
        manifest.subsample(full, 10, "other")


def test_manifest_guards(spark):
    images = cohort(spark, 5).select("image_id", "image_path")
    with pytest.raises(LabelJoinError, match="zero rows"):
        manifest.build(images, spark.createDataFrame([("nothing", 1)], "image_id string, grade int"), "x")
    with pytest.raises(LabelJoinError, match="Only one class"):
        manifest.build(images, images.select("image_id", F.lit(0).alias("grade")), "x")
    rows, audit = manifest.build(images, images.select("image_id", F.pmod(F.hash("image_id"), F.lit(3)).alias("grade")), "x", r"(\d+)_")
    assert rows.columns == ["image_id", "image_path", "grade", "group", "source"] and audit.grouped and audit.n_matched == 10


def measures(spark, n):
    rng = np.random.default_rng(2)
    rows = [(k, k % 5, float(np.clip(rng.normal(0.38, 0.11), 0.02, 0.95)), float(max(rng.normal(0.0023, 0.0011), 1e-5)), True, "old" if k == 0 else "") for k in range(n)]
    return spark.createDataFrame(rows, "image_id int, grade int, qc_brightness double, qc_focus double, gradable boolean, qc_reasons string")


def test_cohort_flags(spark):
    got = quality.flag_cohort_outliers(measures(spark, 400), 0.02)
    assert 0.02 <= got.where("not gradable").count() / 400 <= 0.045
    assert got.where("image_id = 0 and qc_reasons like 'old%'").count() == 1
    assert quality.flag_cohort_outliers(measures(spark, 20), 0.02).where("not gradable").count() == 0
    assert quality.flag_cohort_outliers(measures(spark, 400), 0.0).where("not gradable").count() == 0
    nan = measures(spark, 100).withColumn("qc_focus", F.lit(float("nan")))
    assert quality.reason_counts(quality.flag_cohort_outliers(nan, 0.02)).where("reason = 'cohort_blurred'").count() == 0


def test_quality_never_leaves_one_class(spark):
    df = measures(spark, 100).withColumn("gradable", F.col("grade") == 0)
    assert quality.apply_quality_control(df).count() == 100


def test_folds(spark):
    full = cohort(spark)
    folded = splits.with_folds(full, 5)
    assert folded.groupBy("group").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 12
    few = spark.createDataFrame([(g, str(k)) for k, g in enumerate([0] * 20 + [1] * 20 + [2] * 2)], "grade int, group string")
    assert splits.safe_n_splits(few, 5).first()[0] == 2


def test_holdout_and_guard(spark):
    got = splits.holdout(cohort(spark))
    train, test = got.where("not test"), got.where("test")
    splits.verify_no_leakage(train, test)
    assert 0.15 < test.count() / got.count() < 0.35
    with pytest.raises(splits.LeakageError):
        splits.verify_no_leakage(train, train)
    assert splits.split_summary(got).agg(F.sum("n_rows")).first()[0] == 400


def test_greedy_folds():
    rng = np.random.default_rng(0)
    counts = np.eye(5)[rng.integers(0, 5, 120)] * rng.integers(1, 4, (120, 1))
    folds = splits.greedy_folds(counts, 4)
    shares = np.stack([counts[folds == k].sum(0) for k in range(4)]) / counts.sum(0)
    assert np.abs(shares - 0.25).max() < 0.12


def scored(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.choice(5, 500, p=[0.49, 0.10, 0.27, 0.08, 0.06])
    return spark.createDataFrame(list(zip(y.tolist(), (0.7 * y + rng.normal(0, 0.8, 500)).tolist(), strict=True)), "y int, score double")


@pytest.mark.parametrize("seed", [0, 1])
def test_cuts_beat_rounding(spark, seed):
    df = scored(spark, seed)
    cuts = thresholds.search(df, scalars.LABELS)
    assert cuts == sorted(cuts) and len(cuts) == 4
    tuned = metrics.qwk(df.withColumn("p", scalars.cut(F.col("score"), cuts))).first()[0]
    plain = metrics.qwk(df.withColumn("p", F.greatest(F.lit(0), F.least(F.lit(4), F.bround("score").cast("int"))))).first()[0]
    assert tuned >= plain - 1e-9


def test_cut_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.01,)], "s double")
    assert [r[0] for r in df.select(scalars.cut(F.col("s"), [0.5, 1.0])).collect()] == [0, 1, 2]


def test_bootstrap(spark):
    df = pairs(spark, GOLDEN[3][0])
    r = resample.bootstrap_ci(df, n=400).first()
    assert r.low < r.point < r.high and 0.5 < r.low and r.high < 0.9
    assert tuple(r) == tuple(resample.bootstrap_ci(df, n=400).first())
    few = resample.bootstrap_ci(df.limit(5)).first()
    assert few.low == few.point == few.high
    two = df.select("y", F.col("p").alias("pa"), F.lit(0).alias("pb"))
    assert resample.paired_bootstrap(two, n=200).first().p_value < 0.05
    same = df.select("y", F.col("p").alias("pa"), F.col("p").alias("pb"))
    assert resample.paired_bootstrap(same, n=50).first().p_value == 1.0


def test_cache(spark):
    store = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, at long, v string")
    work = spark.createDataFrame([("a",), ("c",)], "key string")
    assert {(r.key, r.v) for r in cache.latest(store).collect()} == {("a", "y"), ("b", "z")}
    assert [r.key for r in cache.reusable(work, store).collect()] == ["a"]
    assert [r.key for r in cache.left_to_do(work, store).collect()] == ["c"]
    assert cache.combined(store, work).count() == 5


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 0.0, 1.0],), ([0.0, 1.0, 0.0],)], "p array<double>")
    assert [r[0] for r in df.select(scalars.expected_class(F.col("p"), (0, 1, 2))).collect()] == [0.0, 2.0, 1.0]
    assert scalars.refer(F.col("p"), math.nan) is None
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in odd.select(scalars.finite(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.0]


def test_permutation_importance_against_moved_rows(spark):
    """The loss of agreement, recomputed by moving the values by hand."""
    from ocellus.ml import protocol

    class Sum:
        """Predicts the sum of two columns, cut to the grades."""

        @staticmethod
        def transform(df):
            return df.withColumn("prediction", F.least(F.lit(4), F.greatest(F.lit(0), F.round(F.col("colour_a") + F.col("zone0_b")))).cast("int"))

    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 3, 60).tolist(), rng.integers(0, 3, 60).tolist(), rng.normal(size=60).tolist()
    rows = [(k, min(4, a[k] + b[k]), float(a[k]), float(b[k]), c[k]) for k in range(60)]
    df = spark.createDataFrame(rows, "image_id long, grade int, colour_a double, zone0_b double, odd_c double").repartition(3)
    columns = ["colour_a", "zone0_b", "odd_c"]
    got = {r.feature: r for r in protocol.permutation_importance(Sum, df, columns, 4, seed=5, at_once=2).collect()}
    assert {k: r.family for k, r in got.items()} == {"colour_a": "colour", "zone0_b": "zone", "odd_c": "other"}
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    draw = np.random.default_rng(5)
    primes = [p for p in range(20, 130) if math.gcd(p, 60) == 1][:1000]
    for at in range(3):
        losses = []
        for _ in range(4):
            p, q = int(draw.choice(primes)), int(draw.integers(0, 60))
            y, told = [], []
            for i, r in enumerate(order):
                v = list(r)
                v[2 + at] = order[(p * i + q) % 60][2 + at]
                y.append(r[1])
                told.append(min(4, max(0, round(v[2] + v[3]))))
            pairs = spark.createDataFrame(list(zip(y, told, strict=True)), "y int, p int")
            losses.append(1 - metrics.qwk(pairs).first().qwk)
        r = got[columns[at]]
        assert r.importance == pytest.approx(np.mean(losses)) and r.std == pytest.approx(np.std(losses))
