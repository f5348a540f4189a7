"""Line dedup: lines found in many documents stay in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bytes_of, join_hot, known_rows, longs_of, per_batch, public_id, stage, unused

MIN_CHARS, MIN_DOCS = 20, 3
#: [\x20\x09-\x0D]
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the normalised line; None where it is too short to count."""
    k = line.strip(BLANK).lower()
    if len(k) < min_chars or (not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def _keys(min_chars: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, keys = [], []
        for k, text in enumerate(bytes_of(batch, "text")):
            got = {line_key(x, min_chars) for x in text.split(b"\n")}
            got.discard(None)
            at += [k] * len(got)
            keys += got
        at = np.array(at, np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(longs_of(batch, c)[at]) for c in ("doc_id", "row")), pa.array(keys, pa.binary())], names=["doc_id", "row", "key"])

    return per_batch(run)


KEPT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _reassemble(min_chars: int, extra: list[str]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, out = [], [], []
        for text, drop in zip(bytes_of(batch, "text"), batch.column(batch.schema.get_field_index("drop")).to_pylist(), strict=True):
            lines = text.split(b"\n")
            n.append(len(lines))
            if not drop:
                gone.append(0)
                out.append(text)
                continue
            drop = set(drop)
            kept = [x for x in lines if line_key(x, min_chars) not in drop]
            gone.append(len(lines) - len(kept))
            out.append(b"\n".join(kept))
        named = {x: batch.column(batch.schema.get_field_index(x)) for x in extra}
        cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*named.values(), *cols], names=[*named, "n_lines", "n_dropped", "kept_text"])

    return per_batch(run)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""Drop lines whose key is in ``min_docs`` documents or more, except in the largest doc_id that holds it.

    A text is split at \n; a line's key is the line without ``[\x20\x09-\x0D]`` at its ends, A-Z lower-cased; keys under
    ``min_chars`` code points are left alone. Returns for each row doc_id, n_lines (before), n_dropped, kept_text (the other
    lines in their order, joined by \n). A null or empty text is one empty line and gives ''. A null doc_id ranks below all others and
    comes back null. Rows that repeat a doc_id, or have none, count as one document, so all of the largest id keep a line; each row
    loses only lines of its own. Very long texts are read whole, and each distinct line counts once a text. All other columns are left
    out, whatever their names. An empty table gives no rows.
    """
    rows = known_rows(docs)
    both = rows.join(_dropped(rows, min_chars, min_docs).hint("shuffle_hash"), ["doc_id", "row"], "left")
    return both.mapInArrow(_reassemble(min_chars, ["doc_id"]), KEPT).withColumn("doc_id", public_id())


def _dropped(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, row, and the keys of the lines that it loses."""
    pairs = stage(rows.mapInArrow(_keys(min_chars), "doc_id long, row long, key binary"), "lines")
    keys = pairs.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep_id"), F.count("*").alias("held")).where(F.col("n") >= min_docs)
    drop = join_hot(pairs, stage(keys, "keys"), "key", "held", pairs.count()).where("doc_id != keep_id")
    return drop.groupBy("doc_id", "row").agg(F.collect_set("key").alias("drop"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the texts that stay after ``line_dedup``, and n_chars, where there is one, to match. A null text stays null."""
    drop, key, row = unused("drop", docs.columns), unused("doc_key", docs.columns), unused("row_key", docs.columns)
    gone = _dropped(known_rows(docs), min_chars, min_docs).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("drop").alias(drop))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.withColumns({key: F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), row: F.xxhash64(text)}).join(gone.hint("shuffle_hash"), [key, row], "left")
    out = rows.withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(drop), min_chars)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)


def _without(text: F.Column, drop: F.Column, min_chars: int) -> F.Column:
    @F.arrow_udf("string")
    def kept(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(texts.cast(pa.large_binary()).to_pylist(), drops.to_pylist(), strict=True):
            gone = set(d or ())
            out.append(t and b"\n".join(x for x in t.split(b"\n") if line_key(x, min_chars) not in gone))
        return pa.array(out, pa.binary()).cast(pa.string())

    return kept(text, drop)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS keep_id FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT l.doc_id, l.pos, l.line, hot.k IS NOT NULL AND l.doc_id <> hot.keep_id AS gone FROM l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
