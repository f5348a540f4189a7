"""Exact dedup: two Bloom passes find possibly repeated digests; only those rows shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import bytes_of, join_hot, public_id, slim, stage


def _sha(batch: pa.RecordBatch) -> list[bytes]:
    # bytes.lower changes A-Z alone
    return [hashlib.sha256(t.lower()).digest() for t in bytes_of(batch, "text")]


def _head(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def _keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield _head(_sha(batch))


def _marker(again):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _sha(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.binary()), pa.array(bloom.maybe_repeated(again.value, _head(d)))], names=["doc_id", "sha", "maybe"])

    return run


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of texts that are identical after A-Z are lower-cased, with the row that stays.

    Returns for each row doc_id, keep_id (the group's largest doc_id), group_size (rows), kept, text_sha256. A null text counts
    as empty; empty texts are one group. A null doc_id ranks below all others and comes back null. Rows that repeat a
    doc_id count in group_size, and all rows that hold the largest id are kept. Very long texts are read whole; all other columns are left
    out, whatever their names. An empty table gives no rows.
    """
    rows = slim(docs)
    total = rows.count()
    again = bloom.repeated(rows, _keys, total)
    marked = stage(rows.mapInArrow(_marker(again), "doc_id long, sha binary, maybe boolean"), "exact")
    some = marked.where("maybe").drop("maybe")
    groups = some.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_hot(some, groups, "sha", "group_size", total)
    alone = marked.where("not maybe").select("sha", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return joined.unionByName(alone).select(
        public_id(), public_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
