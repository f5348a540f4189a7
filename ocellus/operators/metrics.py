"""Agreement, ranking and screening metrics as aggregates. One pass over the rows; what follows works on distinct scores or cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocellus.functions.ordering import value_buckets
from ocellus.functions.scalars import LABELS

TINY = 1e-12


def cells(df: DataFrame, y: str = "y", p: str = "p", labels=LABELS) -> DataFrame:
    """Confusion counts of pairs with known labels: at most one row for each pair of labels."""
    return df.where(F.col(y).isin(*labels) & F.col(p).isin(*labels)).groupBy(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, y: str = "y", p: str = "p", labels=LABELS) -> DataFrame:
    """All pairs of labels with their counts, zero included."""
    every = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "y int, p int")
    return every.join(cells(df, y, p, labels), ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def row_normalised(matrix: DataFrame) -> DataFrame:
    rows = matrix.groupBy("y").agg(F.sum("n").alias("row_n"))
    return matrix.join(F.broadcast(rows), "y").select("y", "p", "n", (F.col("n") / F.greatest("row_n", F.lit(1))).alias("share"))


def _index(c: str, labels) -> Column:
    return F.create_map(*[F.lit(x) for k, v in enumerate(sorted(labels)) for x in (v, float(k))])[F.col(c).cast("int")]


def kappa_columns(labels=LABELS, weight: str | None = None) -> Column:
    """Quadratic weighted kappa as one aggregate: squared distances expand into sums of label numbers and their products."""
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    i, j = _index("y", labels), _index("p", labels)
    known = F.col("y").isin(*labels) & F.col("p").isin(*labels)
    s = lambda c: F.sum(F.when(known, n * c))
    total, si, sj, sii, sjj, sij = s(F.lit(1.0)), s(i), s(j), s(i * i), s(j * j), s(i * j)
    expected = total * (sii + sjj) - 2 * si * sj
    value = 1 - total * (sii + sjj - 2 * sij) / F.when(expected > TINY, expected)
    return F.coalesce(value, F.lit(0.0)) if len(labels) > 1 else F.lit(0.0)


def qwk(df: DataFrame, labels=LABELS) -> DataFrame:
    return df.agg(kappa_columns(labels).alias("qwk"))


def _per_label(labels, n: Column) -> tuple[Column, Column]:
    """Balanced accuracy and macro F1, as aggregates over counted pairs y, p of which ``n`` says how many there are."""
    known = F.col("y").isin(*labels) & F.col("p").isin(*labels)
    s = lambda c: F.coalesce(F.sum(F.when(known & c, n)), F.lit(0)).cast("double")
    recalls, scores = [], []
    for x in labels:
        right, true, told = s((F.col("y") == x) & (F.col("p") == x)), s(F.col("y") == x), s(F.col("p") == x)
        recalls.append(F.try_divide(right, true))
        scores.append(F.coalesce(F.try_divide(2 * right, true + told), F.lit(0.0)))
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x).cast("double"))
    return F.coalesce(mean(F.array_compact(F.array(*recalls))), F.lit(0.0)), mean(F.array(*scores))


def balanced_accuracy(df: DataFrame, labels=LABELS) -> DataFrame:
    """Mean recall over the classes that occur."""
    return cells(df, labels=labels).agg(_per_label(labels, F.col("n"))[0].alias("balanced_accuracy"))


def macro_f1(df: DataFrame, labels=LABELS) -> DataFrame:
    """Mean F1 over all labels; one that neither occurs nor is predicted counts zero."""
    return cells(df, labels=labels).agg(_per_label(labels, F.col("n"))[1].alias("macro_f1"))


def classification_bundle(df: DataFrame, labels=LABELS) -> DataFrame:
    """qwk, balanced_accuracy, macro_f1 over pairs of known labels; accuracy and mae over all pairs. One row, from one table of pairs."""
    counts = df.groupBy("y", "p").agg(F.count("*").alias("n"))
    recall, f1 = _per_label(labels, F.col("n"))
    return counts.agg(
        kappa_columns(labels, "n").alias("qwk"),
        (F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        (F.sum(F.abs(F.col("y") - F.col("p")) * F.col("n")) / F.sum("n")).alias("mae"),
        recall.alias("balanced_accuracy"),
        f1.alias("macro_f1"),
    )


def score_counts(df: DataFrame, positive: Column, score: str = "score") -> DataFrame:
    """Distinct scores with their positives and negatives."""
    hit = positive.cast("long")
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def curve(counts: DataFrame) -> DataFrame:
    """score, pos, neg; counted from the highest score down to it tp and fp; next_pos and next_neg of the score below; and the totals n1, n0.

    Counted in buckets of scores and over the buckets, so no task holds all scores.
    """
    rows = value_buckets(counts, "score")
    whole, down = W.partitionBy(F.lit(0)), W.orderBy(F.desc("_bucket"))
    above = down.rowsBetween(W.unboundedPreceding, -1)
    buckets = rows.groupBy("_bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max_by(F.struct("pos", "neg"), "score").alias("head"))
    base = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    buckets = buckets.select("_bucket", base("p").alias("p"), base("n").alias("n"), F.lead("head").over(down).alias("head"), F.sum("p").over(whole).alias("n1"), F.sum("n").over(whole).alias("n0"))
    inside = W.partitionBy("_bucket").orderBy(F.desc("score"))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    told = {"tp": F.col("p") + F.sum("pos").over(upto), "fp": F.col("n") + F.sum("neg").over(upto)}
    told |= {f"next_{c}": F.coalesce(F.lead(c).over(inside), F.col("head")[c]) for c in ("pos", "neg")}
    return rows.join(F.broadcast(buckets), "_bucket").withColumns(told).select("score", "pos", "neg", *told, "n1", "n0")


def _corner() -> Column:
    """Where the step to the next point differs from the last one, and at the end."""
    return F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))


def roc_points(counts: DataFrame) -> DataFrame:
    """threshold, tp, fp, tpr, fpr at the corners of the ROC curve. (The start, where nothing is called positive, isn't listed.)"""
    return curve(counts).where(_corner()).select(F.col("score").alias("threshold"), "tp", "fp", F.try_divide("tp", "n1").alias("tpr"), F.try_divide("fp", "n0").alias("fpr"))


def pr_points(counts: DataFrame) -> DataFrame:
    return curve(counts).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "n1").alias("recall"))


def _auroc() -> Column:
    """Over a curve: the share of positive-negative pairs in the right order, ties half. Null with one class alone."""
    return F.try_divide(F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos").cast("double") * F.sum("neg"))


def _precision() -> Column:
    return F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double"))


def _best(target: float) -> Column:
    """Over a curve: among the corners that reach the sensitivity, the one with the fewest false positives, the highest threshold first."""
    there = _corner() & (F.try_divide("tp", "n1") >= target) & (F.col("n0") > 0)
    return F.min_by(F.when(there, F.struct(F.col("score").alias("threshold"), "tp", "fp", "n1", "n0")), F.when(there, F.struct(F.col("fp"), -F.col("score"))))


def _rates(best: str) -> list[Column]:
    b = F.col(best)
    fn, tn = b["n1"] - b["tp"], b["n0"] - b["fp"]
    found = lambda c: F.when(b.isNotNull(), F.coalesce(c, F.lit(0.0)))
    return [
        b["threshold"].alias("threshold"),
        F.try_divide(b["tp"], b["n1"]).alias("sensitivity"),
        F.try_divide(tn, b["n0"]).alias("specificity"),
        found(F.try_divide(b["tp"], b["tp"] + b["fp"])).alias("ppv"),
        found(F.try_divide(tn, tn + fn)).alias("npv"),
    ]


def auroc(counts: DataFrame) -> DataFrame:
    return curve(counts).agg(_auroc().alias("auroc"))


def average_precision(counts: DataFrame) -> DataFrame:
    return curve(counts).agg(_precision().alias("average_precision"))


def operating_point(counts: DataFrame, target: float = 0.9) -> DataFrame:
    """threshold, sensitivity, specificity, ppv, npv where the sensitivity reaches ``target``. All null with one class alone."""
    return curve(counts).agg(_best(target).alias("best")).select(*_rates("best"))


def referable_metrics(df: DataFrame, threshold_grade: int = 2, target: float = 0.9) -> DataFrame:
    """prevalence, auroc, average_precision and the operating point, of the grade reaching ``threshold_grade``: one aggregate over one curve."""
    counts = score_counts(df, F.col("y") >= threshold_grade)
    prevalence = F.try_divide(F.sum("pos"), F.sum(F.col("pos") + F.col("neg")))
    got = curve(counts).agg(prevalence.alias("prevalence"), _auroc().alias("auroc"), _precision().alias("average_precision"), _best(target).alias("best"))
    return got.select("prevalence", "auroc", "average_precision", *_rates("best"))
