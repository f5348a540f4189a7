"""Images joined to labels: identifiers, groups, audits, sampling by whole groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocellus.functions.ordering import hash_bucket, running
from ocellus.functions.scalars import LABELS, derive_group, grade_label, normal_id


class LabelJoinError(ValueError):
    """Images and labels don't make a usable cohort."""


def first_of(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key; the key's rows are reduced before they are shuffled, so a frequent key is no burden."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def clean_labels(raw: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """image_id, grade of rows with a number as label (decimals cut off); of rows that share an id the first in file order."""
    rows = raw.withColumn("_at", F.monotonically_increasing_id()).select(normal_id(F.col(id_column)).alias("image_id"), F.col(label_column).try_cast("double").alias("g"), "_at")
    rows = rows.where("image_id is not null and g is not null and not isnan(g)").select("image_id", F.col("g").cast("int").alias("grade"), "_at")
    return first_of(rows, "image_id", F.col("_at")).drop("_at")


def coercion_audit(raw: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """n_rows, n_bad_labels, n_duplicates, n_usable: one row."""
    g = F.col(label_column).try_cast("double")
    ok = g.isNotNull() & ~F.isnan(g)
    by_id = raw.select(normal_id(F.col(id_column)).alias("i"), ok.alias("ok")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("good"))
    return by_id.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - F.col("good")).alias("n_bad_labels"), F.sum(F.greatest(F.col("good") - 1, F.lit(0))).alias("n_duplicates"), F.sum((F.col("good") > 0).cast("long")).alias("n_usable"))


def guess_id_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """For each column its rows, distinct values and their ratio, from one pass."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d{k}") for k, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d{k}").alias("n_distinct")) for k, c in enumerate(columns)])).alias("x")).select("x.*", F.try_divide("x.n_distinct", "x.n_rows").alias("ratio"))


def guess_id_column(df: DataFrame) -> str | None:
    """The text-like or nearly unique column with the most distinct values a row; the first of equals."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    rows = {r["column"]: r["ratio"] or 0.0 for r in guess_id_stats(df).collect()}
    best, top = None, -1.0
    for c in df.columns:
        if (c in text or rows[c] > 0.9) and rows[c] > top:
            best, top = c, rows[c]
    return best


def guess_label_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the share of numbers, whether all are whole, their distinct values and smallest, from one pass."""
    v = {c: F.col(c).try_cast("double") for c in columns}
    aggs = []
    for k, c in enumerate(columns):
        aggs += [F.avg(v[c].isNotNull().cast("double")).alias(f"s{k}"), F.max(F.abs(v[c] - F.floor(v[c]))).alias(f"f{k}"), F.count_distinct(v[c]).alias(f"d{k}"), F.min(v[c]).alias(f"m{k}")]
    one = df.agg(*aggs)
    item = [F.struct(F.lit(c).alias("column"), F.col(f"s{k}").alias("numeric_share"), (F.col(f"f{k}") == 0).alias("integral"), F.col(f"d{k}").alias("n_distinct"), F.col(f"m{k}").alias("smallest")) for k, c in enumerate(columns)]
    return one.select(F.explode(F.array(*item)).alias("x")).select("x.*")


def guess_label_column(df: DataFrame, exclude: str | None) -> str | None:
    columns = [c for c in df.columns if c != exclude]
    rows = {r["column"]: r for r in guess_label_stats(df, columns).collect()}
    for c in columns:
        r = rows[c]
        if (r["numeric_share"] or 0) >= 0.9 and r["integral"] and 2 <= r["n_distinct"] <= 10 and r["smallest"] >= 0:
            return c
    return None


def join_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join; the smaller side is broadcast by its size at run time, else both are shuffled on the id."""
    return images.join(labels, "image_id")


def join_audit(images: DataFrame, labels: DataFrame) -> DataFrame:
    """n_images, n_labels, n_matched, n_unmatched_images, n_unmatched_labels, from one union and one shuffle."""
    both = images.select("image_id", F.lit(1).alias("i"), F.lit(0).alias("l")).unionByName(labels.select("image_id", F.lit(0).alias("i"), F.lit(1).alias("l")))
    ids = both.groupBy("image_id").agg(F.max("i").alias("i"), F.max("l").alias("l"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    i, lab = F.col("i") == 1, F.col("l") == 1
    return ids.agg(n(i).alias("n_images"), n(lab).alias("n_labels"), n(i & lab).alias("n_matched"), n(i & ~lab).alias("n_unmatched_images"), n(~i & lab).alias("n_unmatched_labels"))


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("image_id"), "image_id", "left_anti")


def class_summary(manifest: DataFrame, labels=LABELS) -> DataFrame:
    """grade, grade_name, n_images, share (4 digits, half to even), n_groups: a row for each label, with zeros where no image has it, and for
    each other grade that occurs."""
    seen = manifest.groupBy("grade").agg(F.count("*").alias("n_images"), F.count_distinct("group").alias("n_groups"))
    every = manifest.sparkSession.createDataFrame([(x,) for x in labels], "grade int")
    counts = every.join(seen.withColumn("grade", F.col("grade").cast("int")), "grade", "full").na.fill(0, ["n_images", "n_groups"])
    total = F.sum("n_images").over(W.partitionBy(F.lit(0)))  # over the classes
    return counts.select("grade", grade_label(F.col("grade")).alias("grade_name"), "n_images", F.coalesce(F.bround(F.try_divide("n_images", total), 4), F.lit(0.0)).alias("share"), "n_groups")


def group_sizes(manifest: DataFrame) -> DataFrame:
    """group, worst grade, n rows."""
    return manifest.groupBy("group").agg(F.max("grade").alias("worst"), F.count("*").alias("n"))


def _order_hash(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("group")))


def sample_groups(groups: DataFrame, budget: int, strategy: str = "prevalence", seed: int = 42) -> DataFrame:
    """Whole groups until their rows reach ``budget``: by hash order, or in turns over the worst grades (``balanced``).

    The running total is taken in two steps (within buckets of the order, over the buckets), so no task holds all groups.
    """
    h = groups.withColumn("h", _order_hash(seed))
    if strategy == "prevalence":
        got = running(h, hash_bucket(F.col("h")), [F.col("h"), F.col("group")], {"upto": F.col("n")})
        return got.where(F.col("upto") - F.col("n") < budget).select("group", "worst", "n")
    if strategy != "balanced":
        raise ValueError(f"unknown strategy {strategy!r}")
    # the turn of a group is its place among those of its worst grade, counted in the same two steps
    graded = running(h, hash_bucket(F.col("h")), [F.col("h"), F.col("group")], {"turn": F.lit(1)}, by=("worst",))
    turns = graded.groupBy("turn").agg(F.sum("n").alias("n"))
    over = running(turns, F.floor(F.log2(F.col("turn").cast("double"))).cast("int"), [F.col("turn")], {"upto": F.col("n")})
    before = over.select("turn", (F.col("upto") - F.col("n")).alias("before")).where(F.col("before") < budget)
    inside = W.partitionBy("turn").orderBy("worst").rowsBetween(W.unboundedPreceding, -1)
    rows = graded.join(before, "turn").withColumn("upto", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.where(F.col("upto") < budget).select("group", "worst", "n")


def subsample(manifest: DataFrame, budget: int | None, strategy: str = "prevalence", seed: int = 42) -> DataFrame:
    """Rows of whole groups, about ``budget`` of them; everything where the budget is none or not exceeded."""
    if not budget or manifest.count() <= budget:
        return manifest
    return manifest.join(sample_groups(group_sizes(manifest), budget, strategy, seed).select("group"), "group", "left_semi")


@dataclass(frozen=True)
class Audit:
    n_images: int
    n_labels: int
    n_matched: int
    class_counts: dict[int, int]
    grouped: bool


def build(images: DataFrame, labels: DataFrame, source: str, group_regex: str | None = None, budget: int | None = None, strategy: str = "prevalence", seed: int = 42) -> tuple[DataFrame, Audit]:
    """Manifest image_id, image_path, grade, group, source, and its audit. Raises where nothing joins or one class is left."""
    got = join_audit(images, labels).first()
    if not got["n_matched"]:
        raise LabelJoinError(f"the join of {got['n_images']} images and {got['n_labels']} labels has zero rows")
    rows = join_labels(images, labels).withColumn("group", derive_group(F.col("image_id"), group_regex)).withColumn("source", F.lit(source))
    rows = subsample(rows, budget, strategy, seed).select("image_id", "image_path", "grade", "group", "source")
    classes = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(classes) < 2:
        raise LabelJoinError("Only one class is left")
    total, groups = rows.agg(F.count("*"), F.count_distinct("group")).first()
    return rows, Audit(got["n_images"], got["n_labels"], got["n_matched"], classes, groups < total)
