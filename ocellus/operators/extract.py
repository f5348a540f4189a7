"""Descriptors of images: one pass for each image, rows that fail stay visible, and what is already known isn't computed again."""

from __future__ import annotations

import inspect
import logging
import re
import time
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.config import Features, Quality, signature
from ocellus.kernels import families, filters, frame, morphology, render
from ocellus.operators import cache
from ocellus.sources import tables

log = logging.getLogger(__name__)

META = ("image_id", "image_path")
CONTROL = [T.StructField("qc_mask_fraction", T.DoubleType()), T.StructField("qc_brightness", T.DoubleType()), T.StructField("qc_focus", T.DoubleType()), T.StructField("gradable", T.BooleanType()), T.StructField("qc_reasons", T.StringType()), T.StructField("extraction_ok", T.IntegerType()), T.StructField("extraction_error", T.StringType())]
NOT_FEATURES = {"grade", "group", "source", "patient_id", "eye", *META, *(f.name for f in CONTROL), "key", "at", "signature", "fold", "test"}


def schema(features: Features = Features()) -> T.StructType:
    """Fixed: ids, descriptors, quality, outcome. Nothing is inferred."""
    return T.StructType([T.StructField(c, T.StringType()) for c in META] + [T.StructField(c, T.DoubleType()) for c in families.columns(features)] + CONTROL)


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Colours in [0, 1] from rows of blue, green, red (and alpha), or of grey."""
    if height <= 0 or width <= 0:
        raise ValueError("the file can't be decoded")
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (np.repeat(px, 3, axis=2) if channels == 1 else px[..., 2::-1]) / 255.0


def loaded(row) -> np.ndarray:
    """Colours of a row of ``pixels``."""
    return render.ppm(row.data) if row.height == -2 else decoded(int(row.height), int(row.width), int(row.channels), row.data)


def describe(image_id: str, path: str, load, features: Features, quality: Quality) -> dict:
    """One row; whatever goes wrong becomes a row that says so."""
    row = {"image_id": image_id, "image_path": path}
    try:
        f = frame.prepare(load(), features, quality)
        return row | families.describe(f) | f.quality | {"gradable": not f.reasons, "qc_reasons": ";".join(f.reasons), "extraction_ok": 1, "extraction_error": None}
    except Exception as e:  # one bad file must not end the job
        return row | {"gradable": False, "qc_reasons": "extraction_failed", "extraction_ok": 0, "extraction_error": f"{type(e).__name__}: {e}"[:500]}


#: Paths that the driver holds, and one read lists, at a time.
LOT = 10_000
PIXELS = "image_id string, image_path string, height int, width int, channels int, data binary"


def in_lots(images: DataFrame, most: int | None = None) -> Iterator[DataFrame]:
    """The rows, in tables of at most ``most`` (LOT), whose contents the driver knows."""
    names, kinds = images.columns, images.schema
    rows: list[tuple] = []
    for r in images.toLocalIterator():
        rows.append(tuple(r[n] for n in names))
        if len(rows) == (most or LOT):
            yield images.sparkSession.createDataFrame(rows, kinds)
            rows = []
    if rows:
        yield images.sparkSession.createDataFrame(rows, kinds)


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return [p for p in paths if (at := jvm.Path(p)).getFileSystem(conf).exists(at)]


def _read(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """Exactly these files: characters with a meaning in patterns are escaped. Files that are gone are left out."""
    load = lambda some: spark.read.format(kind).option("dropInvalid", "false").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in some])
    try:
        return load(paths)
    except AnalysisException:
        some = _there(spark, paths)
        return load(some) if some else None


def _decoded(lot: DataFrame) -> DataFrame:
    """The lot's files, and no others, decoded where they are read; the table of ids, of a lot's size, is what is broadcast."""
    spark = lot.sparkSession
    paths = sorted({r["image_path"] for r in lot.select("image_path").collect() if r["image_path"]})
    raw = [p for p in paths if p.lower().endswith(".ppm")]
    out = None
    for kind, some in (("image", [p for p in paths if p not in set(raw)]), ("binaryFile", raw)):
        got = _read(spark, kind, some) if some else None
        if got is None:
            continue
        if kind == "image":
            got = got.select(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))).alias("_path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
        else:
            got = got.select(F.col("path").alias("_path"), F.lit(-2).alias("height"), F.lit(0).alias("width"), F.lit(0).alias("channels"), F.col("content").alias("data"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        return lot.select("image_id", "image_path", F.lit(0).alias("height"), F.lit(0).alias("width"), F.lit(0).alias("channels"), F.lit(b"").alias("data"))
    out = out.withColumn("_path", F.regexp_replace("_path", "^file:/+", "/"))
    ids = lot.select("image_id", "image_path", F.regexp_replace("image_path", "^file:/+", "/").alias("_path"))
    known = {_plain(unquote(p)) for p in out.inputFiles()}
    found = out.join(F.broadcast(ids), "_path").select("image_id", "image_path", "height", "width", "channels", "data")
    gone = [(r["image_id"], r["image_path"], 0, 0, 0, b"") for r in lot.select("image_id", "image_path").collect() if _plain(r["image_path"] or "") not in known]
    return found.unionByName(spark.createDataFrame(gone, PIXELS)) if gone else found


def pixels(images: DataFrame) -> DataFrame:
    """``images``: image_id, image_path. Adds height, width, channels, data: decoded by the JVM, but for PPM files, whose bytes are kept.

    Only the listed files are read, each in the task that decodes it, and pixels aren't shuffled. A file that is gone has height 0.
    """
    out = None
    for lot in in_lots(images.select("image_id", "image_path")):
        got = _decoded(lot)
        out = got if out is None else out.unionByName(got)
    return images.sparkSession.createDataFrame([], PIXELS) if out is None else out


def extract(pictures: DataFrame, features: Features = Features(), quality: Quality = Quality()) -> DataFrame:
    """``pictures``: image_id, image_path, height, width, channels, data. All families of an image come from one call, which shares
    the maps they have in common."""
    out = schema(features)
    names = out.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame([describe(r.image_id, r.image_path, lambda r=r: loaded(r), features, quality)]).reindex(columns=names)

    return pictures.mapInPandas(run, out)


def code_fingerprint() -> str:
    """Changes with the kernels' source, so that a changed kernel invalidates what it computed."""
    return signature(*[inspect.getsource(m) for m in (filters, morphology, frame, families)], digits=8)


def settings_signature(features: Features, quality: Quality) -> str:
    return signature(features, quality, code_fingerprint())


def extract_with_store(manifest: DataFrame, store: str | None, features: Features = Features(), quality: Quality = Quality()) -> DataFrame:
    """``manifest``: image_id, image_path, modified and more. Known rows are read from the store, the others computed and appended;
    both are joined to the manifest, and rows that failed are dropped, with a warning that says how many. What failed is tried again
    the next time. Images are computed lot by lot, so a run that is stopped goes on after the last lot."""
    spark = manifest.sparkSession
    sig = settings_signature(features, quality)
    work = manifest.withColumn("key", cache.cache_key(F.col("image_path"), F.col("modified"), F.lit(sig)))
    if store:
        todo = cache.left_to_do(work, tables.read_store(spark, store, sig, schema(features))).select("image_id", "image_path", "key")
        for lot in in_lots(todo):
            fresh = extract(pixels(lot), features, quality).where("extraction_ok = 1").join(F.broadcast(lot.select("image_id", "key")), "image_id")
            tables.append_store(fresh.withColumn("at", F.lit(time.time_ns())).withColumn("signature", F.lit(sig)), store)
        rows = cache.reusable(tables.read_store(spark, store, sig, schema(features)), work).drop("key", "at", "signature", "image_path")
    else:
        rows = extract(pixels(work), features, quality).drop("image_path")
    out = manifest.join(rows, "image_id").where("extraction_ok = 1")
    if store and (lost := manifest.count() - out.count()):
        log.warning("%d images have no descriptors and are left out", lost)
    return out


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that aren't ids, outcomes or quality, sorted."""
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType)
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in NOT_FEATURES)


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose population deviation isn't zero, from one pass."""
    got = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if (got[c] or 0) > 1e-12]
