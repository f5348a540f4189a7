"""Files in and out: image folders, label files, tables, the append-only store, JSON, synthetic cohorts, predictions."""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.config import Synthetic
from ocellus.functions.scalars import IMAGE_SUFFIXES, is_image, stem
from ocellus.kernels import render
from ocellus.operators import cache, manifest
from ocellus.operators.manifest import LabelJoinError
from ocellus.sources.adapters import Adapter


def scan_images(spark: SparkSession, root: str, pattern: str = "**/*") -> DataFrame:
    """image_id, image_path, modified of the image files below ``root``; of those that share a stem, the first path.

    Only the listing is read: the files' contents aren't selected. A pattern that ends in one image suffix takes all of them.
    """
    tail = pattern.rsplit("/", 1)[-1]
    for s in IMAGE_SUFFIXES:
        if tail.lower().endswith(s):
            tail = tail[: -len(s)] + ".*"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", tail).load(root)
    except Exception as e:
        raise LabelJoinError(f"no image folder at {root}") from e
    found = files.where(is_image(F.col("path"))).select(stem(F.col("path")).alias("image_id"), F.col("path").alias("image_path"), F.col("modificationTime").alias("modified"))
    if found.isEmpty():
        raise LabelJoinError(f"no images below {root}")
    return manifest.first_of(found, "image_id", F.col("image_path"))


def read_labels(spark: SparkSession, path: str, adapter: Adapter, id_column: str | None = None, label_column: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """image_id, grade, and what was found out: the columns, by name or by their values, and the audit of the coercion."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    ids = id_column or adapter.find(raw.columns, adapter.id_columns) or manifest.guess_id_column(raw)
    grade = label_column or adapter.find(raw.columns, adapter.label_columns) or manifest.guess_label_column(raw, ids)
    for what, c in (("id", ids), ("label", grade)):
        if c not in raw.columns:
            raise LabelJoinError(f"no {what} column among {', '.join(raw.columns)}")
    audit = manifest.coercion_audit(raw, ids, grade).first().asDict()
    if not audit["n_usable"]:
        raise LabelJoinError(f"no usable label in {path}")
    return manifest.clean_labels(raw, ids, grade), audit | {"csv": path, "id_column": ids, "label_column": grade}


def save_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; else a CSV of the same name."""
    try:
        return spark.read.parquet(path)
    except Exception:
        if not path.endswith(".csv"):
            return spark.read.csv(f"{path}.csv", header=True, inferSchema=True)
        raise


def append_store(rows: DataFrame, path: str) -> None:
    """Add rows to the store, a folder for each signature, so that readers of one signature list its files alone."""
    rows.write.mode("append").partitionBy("signature").parquet(path)


def read_store(spark: SparkSession, path: str, signature: str, schema: T.StructType) -> DataFrame:
    """The latest rows of a signature; none where there is no store yet."""
    full = T.StructType([*schema.fields, T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("signature", T.StringType())])
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], full)
    return cache.latest(spark.read.schema(full).parquet(path).where(F.col("signature") == signature))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, signature: str | None = None) -> DataFrame:
    """Rows of a line-by-line JSON log; broken lines are left out, and of a key's records the last line stays."""
    bad = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("allowNonNumericNumbers", "true").json(path)
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).where("_broken is null and key is not null").drop("_broken")
    if signature is not None:
        rows = rows.where(F.col("signature") == signature)
    return cache.latest(rows, "key", "_at").drop("_at")


def _plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return _plain(dataclasses.asdict(x))
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted(_plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def save_json(value: Any, path: str | Path) -> None:
    """Sets become sorted lists, numbers that JSON lacks become null."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(_plain(value), indent=2, default=str))


def load_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def save_predictions(long: DataFrame, path: str, models: list[str]) -> None:
    """A row for each image, pred_<model> and score_<model> side by side."""
    wide = long.groupBy("image_id", "group", "grade").pivot("model", models).agg(F.first("prediction").alias("pred"), F.first("score").alias("score"))
    cols = [F.col(f"{m}_{k}").alias(f"{k}_{m}") for m in models for k in ("pred", "score")]
    wide.select("image_id", "group", F.col("grade").alias("grade_true"), *cols).orderBy("image_id").write.mode("overwrite").csv(path, header=True)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """image_id, group, grade, model, prediction, score of a file that ``save_predictions`` wrote."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    models = [c.removeprefix("pred_") for c in wide.columns if c.startswith("pred_")]
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").cast("int").alias("prediction"), F.col(f"score_{m}").cast("double").alias("score")) for m in models])
    return wide.select("image_id", "group", F.col("grade_true").cast("int").alias("grade"), F.explode(each).alias("x")).select("image_id", "group", "grade", "x.*")


PICTURE = "image_id string, patient_id string, eye string, grade int, png binary"


def synthetic(spark: SparkSession, cfg: Synthetic, seed: int = 42) -> DataFrame:
    """A synthetic cohort: image_id, patient_id, eye, grade, png. Each patient is drawn from a seed of their own."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                rows = render.patient(int(i), seed, cfg.grade_prevalence, cfg.image_size)
                yield pd.DataFrame([(a, p, e, g, render.png(x)) for a, p, e, g, x in rows], columns=["image_id", "patient_id", "eye", "grade", "png"])

    return spark.range(cfg.n_patients).repartition(max(1, min(cfg.n_patients, 64)), "id").mapInPandas(draw, PICTURE)


def write_synthetic(spark: SparkSession, cfg: Synthetic, out: str, seed: int = 42) -> int:
    """Write the cohort as image files and labels.csv below ``out`` (a folder that all executors share); returns the number of images."""
    folder = f"{out}/images"

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            for r in b.itertuples():
                Path(folder, f"{r.image_id}.png").write_bytes(r.png)
            yield b[["image_id", "patient_id", "eye", "grade"]]

    rows = synthetic(spark, cfg, seed).mapInPandas(save, "image_id string, patient_id string, eye string, grade int").toPandas().sort_values("image_id")
    rows.to_csv(Path(out) / "labels.csv", index=False)
    return len(rows)
