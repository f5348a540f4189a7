"""Mixing sources to target weights: token blocks, multinomial shard counts, and pseudorandom block permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, bytes_of, longs_of, public_id, small_table, stage

WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
BLOCK = 64  # words
SLOTS = 4096  # blocks of an output shard
MOST_SHARDS = 1024
#: Slots of one row of the plan, and of one task that deals them.
RANGE, TASK = 16_384, 250_000
#: Documents of a layout bucket, about.
BUCKET = 4_000


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> list[float]:
    """Words of each source (in order): ``share`` of all words by weight, none above ``most`` times its size."""
    w = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, free = np.zeros(len(size)), np.ones(len(size), bool)
    left = share * size.sum()
    while free.any():
        given = left * w / w[free].sum()
        over = free & (given > most * size)
        if not over.any():
            out[free] = given[free]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def quotas(sizes: list[int], wanted: list[float], block: int, most: int = MOST_TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source, and how many slots it fills, which is never over ``most`` times its blocks."""
    n = -(-np.array(sizes, np.int64) // block)
    share = np.divide(wanted, sizes, out=np.zeros(len(sizes)), where=np.array(sizes) > 0)
    return n, np.minimum(np.rint(share * n).astype(np.int64), most * n)


def draw(quota: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Multinomial source counts of each shard. Each draw is by what the sources still have to give, so that all slots of all
    sources are dealt in the end; what a source can't give any more is drawn again among the others."""
    rng = np.random.default_rng(seed)
    left, out = quota.copy(), np.zeros((n_shards, len(quota)), np.int64)
    for k in range(n_shards):
        need = int(left.sum()) // (n_shards - k)
        if k == n_shards - 1:
            out[k] = left
            break
        while need and left.sum():
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def _round(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    h = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size), by ``key``: a Feistel network over the next power of four, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        h, m, a = half[todo], mask[todo], x[todo]
        for r in range(4):
            left, right = a >> h, a & m
            a = (right << h) | (left ^ (_round(right, key[todo] + np.uint64(r << 40)) & m))
        x[todo] = a
        todo &= x >= size
    return x.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(t.split()) for t in bytes_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64())], names=["doc_id", "src", "same", "size"])


def _source(docs: DataFrame) -> Column:
    """Sorts as the source does by code point, with null last."""
    return F.coalesce(F.concat(F.lit("a"), docs["source"].cast("string")), F.lit("b"))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _keys(docs: DataFrame) -> list[Column]:
    """same: equal for equal texts of one source, so that rows that share a doc_id, null ones too, are told apart."""
    src = _source(docs)
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"), src.alias("src"), F.xxhash64(_text(docs), src).alias("same")]


def _numbered(rows: DataFrame, unique: bool) -> DataFrame:
    """copy: numbers rows that are equal in id, source and text, which are interchangeable."""
    return rows.withColumn("copy", F.lit(1) if unique else F.row_number().over(W.partitionBy("doc_id", "same").orderBy("src")))


KEY = ["doc_id", "same", "copy"]


class Mix:
    """A mix of documents. ``layout``: doc_id, same, copy, src, size, start (its first word's place in its source).
    ``sources``: src, source_size, target, n_blocks, quota. ``slots``: src, block, shard, slot, round (how often the source has been
    gone through). Two quantities are gathered on the driver: the table of sources, and sources times output shards (at most
    MOST_SHARDS); neither grows with the documents.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = 0):
        spark = docs.sparkSession
        self.docs, self.block = docs, block
        rows = stage(docs.select(*_keys(docs), _text(docs).alias("text")).mapInArrow(_sizes, "doc_id long, src string, same long, size long"), "sizes")
        total = rows.count()
        self.unique = rows.select("doc_id", "same").distinct().count() == total
        rows = _numbered(rows, self.unique).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(max(1, total // BUCKET))))
        # places in two steps: inside a bucket, and of the buckets of a source; no window holds a source's rows
        inside = W.partitionBy("src", "bucket").orderBy(*KEY).rowsBetween(W.unboundedPreceding, -1)
        per_bucket = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
        before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        buckets = stage(per_bucket.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))), "buckets")
        placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets.select("src", "bucket", "base"), ["src", "bucket"])
        self.layout = stage(placed.select(*KEY, "src", "size", (F.col("start") + F.col("base")).alias("start")), "layout")
        got = buckets.groupBy("src").agg(F.sum("words").alias("size")).orderBy("src").collect()
        sizes = [r["size"] for r in got]
        wanted = targets(sizes, weights, share)
        n_blocks, quota = quotas(sizes, wanted, block) if got else (np.zeros(0, np.int64),) * 2
        n_shards = int(min(MOST_SHARDS, max(1, -(-quota.sum() // SLOTS))))
        plan = draw(quota, n_shards, seed)
        first = np.cumsum(plan, axis=0) - plan
        names, counts = pa.array([r["src"] for r in got], pa.string()), lambda x: pa.array(np.asarray(x, np.int64))
        self.sources = small_table(spark, src=names, source_size=counts(sizes), target=pa.array(np.asarray(wanted, float)), n_blocks=counts(n_blocks), quota=counts(quota))
        j, k = np.nonzero(plan) if got else (np.zeros(0, np.int64),) * 2
        # the plan is small, so the number of its partitions is stated: as many as the slots need
        tasks = int(min(max(1, -(-quota.sum() // TASK)), 20_000))
        of = np.asarray(n_blocks, np.int64)[k] if got else k
        dealt_by = (first[j, k], plan[j, k]) if got else (k, k)
        plan_df = small_table(spark, src=names.take(counts(k)), k=pa.array(k.astype(np.int32)), shard=pa.array(j.astype(np.int32)), n_blocks=counts(of), first=counts(dealt_by[0]), n=counts(dealt_by[1]))
        ranges = plan_df.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long")))).repartition(tasks, "src", "shard", "lo")
        slot = F.explode(F.sequence("lo", F.least(F.col("lo") + RANGE, "n") - 1))
        dealt = ranges.select("src", "k", "shard", "n_blocks", "first", slot.alias("slot")).select("src", "k", "shard", "n_blocks", "slot", (F.col("first") + F.col("slot")).alias("at"))
        self.slots = dealt.mapInArrow(_blocks(seed), "src string, block long, shard int, slot long, round long")

    def pieces(self) -> DataFrame:
        """Each word range of a document that the mix takes: doc_id, same, copy, src, block, shard, slot, round, word_from, word_to."""
        b = self.block
        spread = self.layout.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        # both sides are estimated by what they are exploded from, far below their size: neither may be broadcast
        joined = spread.join(self.slots.hint("merge"), ["src", "block"])
        lo = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
        hi = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
        return joined.select(*KEY, "src", "block", "shard", "slot", "round", lo.alias("word_from"), hi.alias("word_to"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row for each document."""
        by_doc = self.pieces().groupBy(*KEY).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
        rows = self.layout.join(by_doc, KEY, "left").join(self.sources, "src")
        return rows.select(public_id(), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mixed corpus, with the columns of the input: one row for each document and round, its text the words taken. Where the
        whole text is taken, it is as it was; else the taken runs are cut out as they stand and joined by a new line."""
        spans = self.pieces().groupBy(*KEY, "round").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("spans"))
        rounds = spans.groupBy(*KEY).agg(F.collect_list("spans").alias("rounds"))
        names = self.docs.columns
        full = self.docs.select(F.struct(*[self.docs[c] for c in names]).alias("row"), *_keys(self.docs))
        rows = _numbered(full, self.unique).join(rounds.hint("shuffle_hash"), KEY)
        each = rows.select("row", F.explode("rounds").alias("spans"))
        text = _cut_words(F.col("row.text"), F.col("spans"))
        cut = each.select("row", text.alias("text"))
        out = [F.col("text").alias(c) if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names]
        return cut.select(*out)


def _blocks(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n, at = (longs_of(batch, c).astype(np.int64) for c in ("k", "n_blocks", "at"))
            round_ = at // n
            key = (np.uint64(seed) * np.uint64(1_000_003) + k.astype(np.uint64)) * np.uint64(1009) + round_.astype(np.uint64)
            block = permute(at % n, n, _round(key, np.zeros(len(key), np.uint64)))
            cols = [batch.column(0), pa.array(block), batch.column(2), batch.column(batch.schema.get_field_index("slot")), pa.array(round_)]
            yield pa.RecordBatch.from_arrays(cols, names=["src", "block", "shard", "slot", "round"])

    return run


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    from .rolling import Words

    words = Words([text])
    runs: list[list[int]] = []
    for a, b in spans:
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    if runs == [[0, len(words.starts)]]:
        return text
    return b"\n".join(text[words.starts[a] : words.ends[b - 1]] for a, b in runs)


def _cut_words(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True):
            out.append(cut_words(t or b"", [(x["word_from"], x["word_to"]) for x in s]))
        return pa.array(out, pa.binary()).cast(pa.string())

    return cut(text, spans)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = 0) -> Mix:
    r"""Mix the words of all documents by source.

    Sources, sorted by code point with null last, get ``share`` of all words by their weights, repeating; a target stops at
    MOST_TIMES its source's size, and the excess is dealt to the others. A source's words (``[^\x20\x09-\x0D]+``), document after
    document, are packed into blocks of ``block`` words. Shards of SLOTS blocks draw how many each source gives; a source's slots
    go through pseudorandom permutations of its blocks, one for each round, so that no block is taken a third time before all
    have been taken twice. Null and empty texts have no words and are never taken. A null doc_id is an id below all others and
    comes back null; rows that repeat a doc_id are mixed apart. Very long texts are cut like others, by words. Other columns go through
    ``documents`` as they are, whatever their names. An empty table gives no rows. The same input gives the same mix.
    """
    return Mix(docs, weights, share, block, seed)
