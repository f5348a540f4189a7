"""Streams: new image files are described once, and windows of a stream equal those of the table."""

import numpy as np
from pyspark.sql import functions as F

from ocellus.config import Features
from ocellus.kernels import render
from ocellus.streaming.events import quality_windows
from ocellus.streaming.images import keep_store
from ocellus.utils import human_count, timer


def test_new_files_are_described_once(spark, tmp_path):
    folder, store, marks = tmp_path / "in", tmp_path / "store", tmp_path / "marks"
    folder.mkdir()

    def put(k):
        look = render.Look.sample(np.random.default_rng(k))
        (folder / f"eye{k}.png").write_bytes(render.png(render.render(k, look, True, 96, np.random.default_rng(k))))

    def run():
        keep_store(spark, str(folder), str(store), str(marks), Features(work_size=64)).awaitTermination()
        return sorted(r.image_id for r in spark.read.parquet(str(store)).select("image_id").collect())

    put(0)
    put(3)
    assert run() == ["eye0", "eye3"]
    put(4)
    assert run() == ["eye0", "eye3", "eye4"]
    assert run() == ["eye0", "eye3", "eye4"]


def test_windows(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 97).alias("ts"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("event_type"), (F.col("id") / 7).alias("value"))
    rows.write.parquet(str(tmp_path / "e"))
    stream = quality_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.start, r.event_type, r.n, round(r["mean"], 9), r.low) for r in d.collect())
    assert key(spark.table("windows")) == key(quality_windows(rows))


def test_helpers():
    assert [human_count(x) for x in (5, 1500, 2_500_000)] == ["5", "1.5k", "2.5M"]
    with timer("nothing") as t:
        pass
    assert t["seconds"] >= 0
