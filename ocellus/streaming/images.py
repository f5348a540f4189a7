"""New files of an image folder as a stream: each is described once and appended to the store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ocellus.config import Features, Quality
from ocellus.functions.scalars import is_image, stem
from ocellus.operators.cache import cache_key
from ocellus.operators.extract import extract, pixels, settings_signature
from ocellus.sources.tables import append_store

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_images(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, image_path, modified of files as they appear; contents aren't read here."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return files.where(is_image(F.col("path"))).select(stem(F.col("path")).alias("image_id"), F.col("path").alias("image_path"), F.col("modificationTime").alias("modified"))


def keep_store(spark: SparkSession, folder: str, store: str, checkpoint: str, features: Features = Features(), quality: Quality = Quality()) -> StreamingQuery:
    """Describe all files that no earlier run has seen, batch by batch, and stop. A changed file or setting isn't noticed: that is what the
    store's keys are for."""
    sig = settings_signature(features, quality)

    def save(batch: DataFrame, _: int) -> None:
        got = extract(pixels(batch.select("image_id", "image_path")), features, quality).where("extraction_ok = 1")
        keyed = batch.select("image_id", cache_key(F.col("image_path"), F.col("modified"), F.lit(sig)).alias("key"))
        append_store(got.join(keyed, "image_id").withColumn("at", F.lit(time.time_ns())).withColumn("signature", F.lit(sig)), store)

    return new_images(spark, folder).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
