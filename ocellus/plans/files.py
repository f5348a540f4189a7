"""Queries that go through the file sources and sinks: each writes a table of the driver's in a format, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.plans.catalogue import _read, eyes, query
from ocellus.plans.catalogue import EYES as _EYES
from ocellus.session import scratch
from ocellus.sources import tables
from ocellus.sources.adapters import Adapter

_LABELS = """raw AS (SELECT o_orderkey AS k, 'Eye_' || o_orderkey || '.PNG' AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE (cast(substr(o_orderpriority, 1, 1) AS INT) - 1) || '.0' END AS level FROM orders)"""


@query(f"WITH {_LABELS} SELECT 'eye_' || k AS image_id, floor(TRY_CAST(level AS DOUBLE))::INT AS grade FROM raw WHERE TRY_CAST(level AS DOUBLE) IS NOT NULL")
def label_csv(spark, sf):
    """A label file: columns found by name, ids normalised, rows without a number left out."""
    key = F.col("o_orderkey")
    level = F.when(key % 7 == 0, F.lit("n/a")).otherwise(F.concat((F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"), F.lit(".0")))
    raw = _read(spark, sf, "orders").select(F.concat(F.lit("Eye_"), key.cast("string"), F.lit(".PNG")).alias(" Image "), level.alias("LEVEL"))
    path = scratch(spark, "labels")
    raw.write.csv(path, header=True)
    return tables.read_labels(spark, path, Adapter("x", ("id", "image"), ("grade", "level")))[0]


_STORE = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("v", T.DoubleType())])


@query("SELECT cast(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS v FROM customer")
def store_files(spark, sf):
    """The append-only store: a second append replaces a third of the rows, another signature's rows aren't seen."""
    rows = _read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id"), F.col("c_acctbal").cast("double").alias("v"), F.col("c_custkey").alias("k"))
    path = scratch(spark, "store")
    keyed = lambda df, at, signature: df.select("image_id", "v", F.col("image_id").alias("key"), F.lit(at).cast("long").alias("at"), F.lit(signature).alias("signature"))
    tables.append_store(keyed(rows, 1, "a"), path)
    tables.append_store(keyed(rows.where("k % 3 = 0").withColumn("v", F.col("v") * 2), 2, "a"), path)
    tables.append_store(keyed(rows.withColumn("v", F.lit(-1.0)), 3, "b"), path)
    return tables.read_store(spark, path, "a", _STORE).select("key", "v")


@query("SELECT cast(event_id % 1000 AS VARCHAR) AS key, max_by(value, event_id) AS value FROM events GROUP BY 1")
def jsonl_log(spark, sf):
    """A line-by-line log with broken lines: the last line of each key."""
    log = _read(spark, sf, "events").select("event_id", F.to_json(F.struct((F.col("event_id") % 1000).cast("string").alias("key"), "value")).alias("line"))
    broken = log.where("event_id % 50 = 0").select((F.col("event_id") + 0.5).alias("event_id"), F.lit('{"key": "0", "val').alias("line"))
    path = scratch(spark, "log")
    log.unionByName(broken).repartition(1).sortWithinPartitions("event_id").select("line").write.text(path)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType())])
    return tables.read_jsonl(spark, path, schema).select("key", "value")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity FROM lineitem")
def table_files(spark, sf):
    """A table partitioned by a column."""
    path = scratch(spark, "table")
    tables.save_table(_read(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"), path, ["l_returnflag"])
    return tables.load_table(spark, path).select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {_EYES} SELECT cast(image_id AS VARCHAR) AS image_id, grp AS \"group\", y AS grade, model, CASE WHEN model = 'a' THEN p ELSE pb END AS prediction, CASE WHEN model = 'a' THEN score ELSE pb::DOUBLE END AS score FROM eyes, (SELECT unnest(['a', 'b']) AS model)")
def prediction_files(spark, sf):
    """Predictions of two models, side by side in a file, and long again."""
    e = eyes(spark, sf)
    rows = e.select("image_id", "group", "grade", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("p").alias("prediction"), F.col("score").cast("double").alias("score")), F.struct(F.lit("b").alias("model"), F.col("pb").alias("prediction"), F.col("pb").cast("double").alias("score")))).alias("x")).select("image_id", "group", "grade", "x.*")
    path = scratch(spark, "predictions")
    tables.save_predictions(rows, path, ["a", "b"])
    return tables.load_predictions(spark, path)
