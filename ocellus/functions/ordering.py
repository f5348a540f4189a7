"""Running totals, neighbours and quantiles in a global order, without one task that holds all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of the order of a number; the tables of bucket totals have so many rows (by hash: 4096), whatever the input.
BUCKETS = 512


def hash_bucket(hexdigest: Column) -> Column:
    """Buckets in the order of a hex digest."""
    return F.conv(F.substring(hexdigest, 1, 3), 16, 10).cast("int")


def step_of(df: DataFrame, column: str, marks: list[float], name: str) -> DataFrame:
    """Adds ``name``: how many of the marks (sorted, all different) are not above the number. Found by binary search."""
    if not marks:
        return df.withColumn(name, F.lit(0))
    value = df.withColumn("_marked", F.col(column).cast("double"))
    step = Bucketizer(splits=[-math.inf, *marks, math.inf], inputCol="_marked", outputCol=name, handleInvalid="keep").transform(value)
    return step.drop("_marked").withColumn(name, F.col(name).cast("int"))


def value_buckets(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds _bucket: buckets in the order of a number, about equal in rows. Their bounds are approximate quantiles, from one pass."""
    value = F.col(column).cast("double")
    marks = df.select(F.percentile_approx(F.when(~F.isnan(value), value), [k / buckets for k in range(1, buckets)], 4 * buckets)).first()[0] or []
    return step_of(df, column, sorted({m for m in marks if math.isfinite(m)}), "_bucket")


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each name the total of its column up to and including the row, apart for each value of the columns ``by`` (of which there are
    few). ``order`` must agree with the buckets' order."""
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(bases), [*by, "_bucket"])
    out = out.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.select(*df.drop("_bucket").columns, *sums)


def quantiles(df: DataFrame, column: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``by``, q and n: exact quantiles at the shares, linear between neighbours, and the number of values; null and NaN are
    left out. One row, or one for each value of ``by``. Distinct values are counted before their order is taken."""
    value = F.col(column).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by, value.alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running(rows := value_buckets(rows, "_value"), F.col("_bucket"), [F.col("_value")], {"_upto": F.col("_n")}, by)
    totals = rows.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(F.broadcast(totals), list(by)) if by else ranked.join(F.broadcast(totals))
    place = [(F.col("_total") - 1) * F.lit(float(s)) for s in shares]
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_value")))  # noqa: E731  the value at place k
    found = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *[at(F.floor(p)).alias(f"_lo{k}") for k, p in enumerate(place)], *[at(F.ceil(p)).alias(f"_hi{k}") for k, p in enumerate(place)])
    between = [F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{k}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{k}") + (p - F.floor(p)) * F.col(f"_hi{k}")) for k, p in enumerate(place)]
    return found.select(*by, F.array(*between).alias("q"), F.coalesce("_total", F.lit(0)).alias("n"))
