"""Quality control: absolute limits, tails of the cohort, and what they remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.ordering import quantiles

LEAST_ROWS = 50


def absolute_reasons(mask_fraction: Column, focus: Column, brightness: Column, min_mask=0.20, min_focus=3e-5, max_bright=0.92, min_bright=0.06) -> Column:
    """Reasons in fixed order, joined by ';'; '' where there is none."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(mask_fraction < min_mask, F.lit("field_of_view_too_small")),
                F.when(focus < min_focus, F.lit("out_of_focus")),
                F.when(brightness > max_bright, F.lit("overexposed")),
                F.when(brightness < min_bright, F.lit("underexposed")),
            )
        ),
        ";",
    )


def flag_cohort_outliers(frame: DataFrame, quantile: float = 0.01, columns: tuple[tuple[str, str], ...] = (("qc_brightness", "cohort_dark"), ("qc_focus", "cohort_blurred"))) -> DataFrame:
    """Flags rows at or below the cohort's exact lower quantile (linear, NaN left out) of each column with LEAST_ROWS values.

    Reasons are appended to qc_reasons, and gradable becomes false. The cut points are one row for each column, which is broadcast.
    """
    if not 0 < quantile < 0.5:
        return frame
    out = frame
    for k, (c, _) in enumerate(columns):
        out = out.join(F.broadcast(quantiles(frame, c, [quantile]).select(F.col("q")[0].alias(f"_q{k}"), F.col("n").alias(f"_n{k}"))))
    low = [~F.isnan(F.col(c).cast("double")) & (F.col(c) <= F.col(f"_q{k}")) for k, (c, _) in enumerate(columns)]
    hits = [F.when((F.col(f"_n{k}") >= LEAST_ROWS) & low[k], F.lit(reason)) for k, (_, reason) in enumerate(columns)]
    told = F.when(F.col("qc_reasons") != "", F.col("qc_reasons"))
    out = out.withColumn("qc_reasons", F.array_join(F.array_compact(F.array(told, *hits)), ";"))
    fine = F.col("gradable")
    for h in hits:
        fine = fine & h.isNull()
    return out.withColumn("gradable", fine).select(*frame.columns)


def reason_counts(frame: DataFrame) -> DataFrame:
    """reason, n over all rows' reasons."""
    each = frame.select(F.explode(F.split("qc_reasons", ";")).alias("reason")).where("reason != ''")
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def apply_quality_control(frame: DataFrame, drop: bool = True, quantile: float = 0.01) -> DataFrame:
    """Flagged rows go, unless fewer than two grades would be left: then all stay."""
    flagged = flag_cohort_outliers(frame, quantile)
    if not drop:
        return flagged
    kept = flagged.where("gradable")
    classes = kept.agg(F.count_distinct("grade")).first()[0]
    return kept if classes >= 2 else flagged
