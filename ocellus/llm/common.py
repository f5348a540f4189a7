"""What the corpus operators share: input columns, staged tables, joins that survive hot keys, span cutting."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: the smallest long, so a null id ranks below every other.
NULL_ID = -(2**63)
#: A key held by more than one row in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slim(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, without nulls: other columns, whatever their names, can't clash."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def known_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, text. ``row`` is a digest of the text: rows that share a doc_id, null ones too, are told apart by it, so no row's
    spans or lines reach another row. Rows equal in both are one document."""
    return slim(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")


def public_id(name: str = "doc_id") -> F.Column:
    """The id as the caller knows it: NULL_ID is null again."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def unused(name: str, taken: list[str]) -> str:
    """A column name near ``name`` that no column in ``taken`` has, whatever the case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the cluster names none, one of our own is set."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
        got = f"{tempfile.gettempdir()}/checkpoints"
    return got.rstrip("/")


#: Tables staged inside each open ``staging`` block.
_OPEN: list[list[DataFrame]] = []


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation.

    The table is removed at the end of the ``staging`` block that it was made in (unless ``keep``), by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later result reads."""
    for df in tables:
        system, where = _at(df.sparkSession, df._staged_at)
        system.delete(where, True)


def finished(*tables: DataFrame) -> None:
    """Remove staged tables that no later result reads, and the shuffle files of finished jobs: Spark keeps those until the driver's garbage
    is collected, which a driver with little to do puts off until they fill the disk."""
    discard(*tables)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def staging() -> Iterator[None]:
    """Tables staged inside are removed at the end: what is to stay must have been written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        discard(*_OPEN.pop())


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of the driver's. It goes by Arrow: rows of Python objects would take Python workers of their own on the executors."""
    return spark.createDataFrame(pa.table(columns))


def partitions_for(spark: SparkSession, size: int) -> int:
    """As many partitions as ``size`` bytes make of the advisory size, and no fewer than a shuffle's own number."""
    each = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    got = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", each.strip().lower())
    one = int(got[1]) << 10 * " kmgt".index(got[2] or " ") if got else 64 << 20
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // max(one, 1 << 20)))


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (cheap to read twice) to ``keyed``, which has one row a key and in ``weight`` its number of rows.

    Keys over 1/HOT_SHARE of ``total`` number under HOT_SHARE, whatever the data, so they are broadcast; all other keys
    are shuffled, and none of them can fill a task.
    """
    limit = max(total // HOT_SHARE, HOT_SHARE)
    hot = F.broadcast(keyed.where(F.col(weight) > limit))
    cold = keyed.where(F.col(weight) <= limit)
    spread = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).select(*spread.columns).unionByName(spread)


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def longs_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def parts(batch: pa.RecordBatch, name: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text, and one row at least."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0)
    at = 0
    ends = np.cumsum(sizes, dtype=np.int64)
    while at < len(batch):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans, in order; touching spans are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[new], e[np.r_[new[1:] - 1, len(e) - 1]]


CUT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for whole in batches:
        for batch in parts(whole):
            spans_out, kept, sizes = [], [], []
            for text, spans in zip(bytes_of(batch, "text"), batch.column(batch.schema.get_field_index("spans")), strict=True):
                sizes.append(len(text))
                if not spans.is_valid or not len(spans.values):
                    spans_out.append([])
                    kept.append(text)
                    continue
                v = spans.values
                s, e = merge_spans(v.field(0).to_numpy(zero_copy_only=False), v.field(1).to_numpy(zero_copy_only=False))
                edge = [0, *np.ravel(np.column_stack([s, e])).tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                spans_out.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(spans_out, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )


def cut_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Remove byte spans from texts. ``rows``: doc_id, row, text (``known_rows``). ``spans``: doc_id, row, start, end in UTF-8 bytes,
    overlapping or not.

    Returns doc_id (null again where it was), n_bytes, spans (maximal removed runs, original offsets) and kept (the bytes that stay; a
    cut may fall inside a code point), one row for each row of ``rows``. The spans of one text are what is gathered, never more than
    its own size.
    """
    by_row = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = rows.join(by_row.hint("shuffle_hash"), ["doc_id", "row"], "left").mapInArrow(frugal(_cut), CUT)
    return cut.withColumn("doc_id", public_id())


def span_digest(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _release() -> None:
    """Give freed memory back, so that a worker that is used again doesn't hold the most that any task before it needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """The mapInArrow function, with freed memory given back at a task's end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return tidy


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = 4_000_000) -> Callable:
    """mapInArrow function that gives ``f`` slices of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, most=most):
                yield f(batch)

    return frugal(run)
