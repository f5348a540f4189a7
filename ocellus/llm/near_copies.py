"""Near copies by word shingles: SimHash fingerprints of the shingle sets are compared in tiles, and what lies further apart than the
radius is found by shared rare shingles, so that all pairs with a Jaccard similarity are joined; and their groups."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, simhash
from .common import NULL_ID, bytes_of, finished, frugal, join_hot, per_batch, parts, slim, stage, unused
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Texts of one shingle that one cell pairs; a shingle that more texts hold is dealt to several cells.
CELL = 1000
#: Text that a task holds the shingles of at a time.
SLICE = 500_000
#: Two sets with the similarity share one shingle in LEVEL of the smaller one, and one at least, among their first ones.
LEVEL = 20
#: Shingles of a bucket, about, and of what a task deals at a time.
BUCKET, DEAL = 500_000, 1_000_000
#: Shingles held by more than one in SHARE of all that are counted, and by 4 * CELL sets, are gathered on the driver: 2 * SHARE at most.
SHARE = 1 << 16
#: Stands for the number of sets that hold such a shingle.
MANY = (1 << 31) - 1
#: Most bits of the map of sets to be fetched whole. Others may pass it, and are dropped by a join.
MAP_BITS = 1 << 26
#: 64-bit words of a set's parity bits, and their columns.
WORDS = 8
PARITY = [f"w{k}" for k in range(WORDS)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words as in SimHash; fewer words than a shingle's are one shingle, none none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = max(len(w) - shingle + 1, 1)
    h = np.full(n, len(w) if len(w) < shingle else shingle, np.uint64)
    for k in range(min(shingle, len(w))):
        h = (h ^ h >> np.uint64(29)) * _MIX + w[k : k + n]
    return np.unique((h ^ h >> np.uint64(32)) * _MIX)


def fingerprint(found: np.ndarray) -> int:
    """A bit is 1 if set in over half of the shingles' hashes."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(found)).view(np.int64)[0])


def parity(found: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * WORDS buckets: whether an odd number of shingles falls into it. Each shingle that only one of two sets holds
    flips one bit, so the sets differ by as many shingles at least as their bits differ."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _rows(shingle: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = [_node(shingles(t, shingle)) for t in bytes_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64())], names=["doc_id", "digest", "node"])

    return per_batch(run, SLICE)


def level(n: F.Column | int) -> F.Column | int:
    """How many shingles two sets share among their first ones, if the smaller one has n. It never falls with n."""
    return F.floor((n + (LEVEL - 1)) / LEVEL).cast("int") if isinstance(n, F.Column) else (n + LEVEL - 1) // LEVEL


def _least(n: F.Column | int, similarity: float) -> F.Column | int:
    """Shingles that a set of n shares with one of the similarity, and that such a set has, at least."""
    got = similarity * n - 1e-9
    return F.ceil(got).cast("int") if isinstance(n, F.Column) else math.ceil(got)


def _firsts(shingle: int, similarity: float):
    """Each set with its first shingles in the order of their hashes: so many that two sets with the similarity share ``level`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        kinds = (pa.int64(), pa.int64(), pa.int32(), *([pa.int64()] * WORDS), pa.list_(pa.int64()))
        for whole in batches:
            for batch in parts(whole, most=SLICE):
                out = []
                for text in bytes_of(batch, "text"):
                    found = shingles(text, shingle)
                    n = len(found)
                    if not n or (node := _node(found)) in told:
                        continue
                    told.add(node)
                    out.append((node, fingerprint(found), n, *parity(found).tolist(), found[: n - _least(n, similarity) + level(n)].view(np.int64)))
                if len(told) > 100_000:
                    told.clear()
                cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["node", "fp", "n", *PARITY, "tokens"])

    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and the sets that hold them, about DEAL at a time, of rows node, tokens."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        col = batch.column(1)
        nodes = np.repeat(batch.column(0).to_numpy(), np.diff(col.offsets.to_numpy()))
        held.append((col.flatten().to_numpy(), nodes))
        n += len(nodes)
        if n >= DEAL:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _often(often: int):
    """Shingles that one lot of a task holds over ``often`` times, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _flat(batches):
            k, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k[n > often]), pa.array(n[n > often])], names=["token", "held"])

    return run


def _deal(hot: np.ndarray, buckets: int):
    """Shingles that aren't hot, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes in _flat(batches):
            cold = ~bloom.among(tokens, hot)
            tokens, nodes = tokens[cold], nodes[cold]
            bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, nodes = bucket[order], tokens[order], nodes[order]
            edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, int)
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), cut(tokens), cut(nodes)], names=["bucket", "tokens", "nodes"])

    return run


def _hot_rows(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes in _flat(batches):
            ok = bloom.among(tokens, hot)
            yield _held(nodes[ok], tokens[ok], np.full(int(ok.sum()), MANY))

    return run


def _held(nodes: np.ndarray, tokens: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tokens), pa.array(held.astype(np.int32))], names=["node", "token", "held"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed buckets, which come one after the other, the shingles that several sets hold, with these sets and their number."""
    key, tokens, nodes = None, [], []

    def settle() -> Iterator[pa.RecordBatch]:
        if not tokens:
            return
        t, s = np.concatenate(tokens), np.concatenate(nodes)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.r_[True, t[1:] != t[:-1]]
        one = new | np.r_[True, s[1:] != s[:-1]]  # equal sets of different tasks
        t, s, new = t[one], s[one], new[one]
        edge = np.flatnonzero(new)
        n = np.repeat(np.diff(np.r_[edge, len(t)]), np.diff(np.r_[edge, len(t)]))
        several = n > 1
        t, s, n = t[several], s[several], n[several]
        for a in range(0, len(t), 10_000):
            yield _held(s[a : a + 10_000], t[a : a + 10_000], n[a : a + 10_000])

    for batch in batches:
        for bucket, some, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != key:
                yield from settle()
                key, tokens, nodes = bucket, [], []
            tokens.append(np.frombuffer(some, np.int64))
            nodes.append(np.frombuffer(own, np.int64))
    yield from settle()


def _sets(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Sets that can have a near copy, with their attributes and the shingles of which they must hold one: node, fp, n, many, parity, tokens.

    First shingles are counted by bucket, so no filter has to hold them all, and nothing of a set is moved but these. Of those that
    several sets hold, two sets with the similarity share ``level``: a set with fewer is left out, and of the others all but so many, by
    rarity, hold one of the other's. Equal numbers are in the order of the hashes.
    """
    first = stage(texts.mapInArrow(frugal(_firsts(shingle, similarity)), f"node long, fp long, n int, {", ".join(f"{w} long" for w in PARITY)}, tokens array<long>"), "firsts")
    flat = first.select("node", "tokens")
    total = flat.agg(F.sum(F.size("tokens"))).first()[0] or 0
    limit = max(4 * CELL, total // SHARE)
    lots = flat.rdd.getNumPartitions() + total // DEAL
    often = flat.mapInArrow(frugal(_often(max(2, limit // lots))), "token long, held long")
    hot = often.groupBy("token").agg(F.sum("held").alias("held")).where(2 * F.col("held") > limit).select("token")
    hot = np.sort(np.array([r["token"] for r in hot.toLocalIterator()], np.int64))
    buckets = total // BUCKET + 1
    dealt = flat.mapInArrow(frugal(_deal(hot, buckets)), "bucket int, tokens binary, nodes binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    held = dealt.mapInArrow(frugal(_count), "node long, token long, held int")
    if len(hot):
        held = held.unionByName(flat.mapInArrow(frugal(_hot_rows(hot)), "node long, token long, held int"))
    by_set = held.groupBy("node").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("held", "token")))).alias("tokens"))
    own = first.drop("tokens").dropDuplicates(["node"]).join(by_set.hint("shuffle_hash"), "node").withColumn("many", F.size("tokens"))
    need = level(_least(F.col("n"), similarity))
    kept = own.where(F.col("many") >= need).withColumn("tokens", F.slice(F.col("tokens")["token"], F.lit(1), F.col("many") - need + 1))
    kept = stage(kept.select("node", "fp", "n", "many", *PARITY, "tokens"), "told")
    finished(first)
    return kept


def _whole(texts: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """node, found: all shingles of the sets ``ends`` (node), made again from their texts. A map of bits spares most of the others."""
    ends = stage(ends, "ends")
    bits = min(MAP_BITS, max(1 << 16, 1 << (16 * ends.count()).bit_length()))
    at = F.pmod("node", F.lit(bits)) + 1
    marked = np.zeros(bits // 8, np.uint8)
    for row in ends.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator():
        got = np.frombuffer(bytes(row["bits"]), np.uint8)
        marked[(row["k"] - 1) * len(got) : row["k"] * len(got)] = got
    sent = texts.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, most=SLICE):
                out = []
                for text in bytes_of(batch, "text"):
                    found = shingles(text, shingle)
                    if len(found):
                        p = (node := _node(found)) % bits
                        if sent.value[p >> 3] >> (p & 7) & 1:
                            out.append((node, found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["node", "found"])

    got = texts.mapInArrow(frugal(run), "node long, found array<long>")
    return got.join(ends, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))


def _fits(a: str, b: str, similarity: float) -> F.Column:
    """Whether two sets' sizes, their numbers of first shingles that repeat, and the bits by which they differ let them have the similarity.

    No pair with it is left out: the bits (exclusive-or and bit count) bound the shingles that only one of the sets holds from below.
    """
    both = F.col(f"{a}n") + F.col(f"{b}n")
    least = F.least(f"{a}n", f"{b}n")
    sizes = (least >= F.lit(similarity / (1 + similarity)) * both - F.lit(1e-6)) & (F.least(f"{a}many", f"{b}many") >= level(least))
    differ = functools.reduce(operator.add, (F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in PARITY))
    return sizes & (differ <= F.lit((1 - similarity) / (1 + similarity)) * both + F.lit(1e-6))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, label: str) -> DataFrame:
    """The pairs u, v whose sets have the similarity."""
    pairs = listed = stage(pairs.distinct(), f"{label}-pairs")
    total = pairs.count()
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stage(_whole(texts, ends, shingle), f"{label}-sets")
    for side, name in (("u", "x"), ("v", "y")):
        weights = pairs.groupBy(side).agg(F.count("*").alias("weight"))
        keyed = weights.join(sets.withColumnsRenamed({"node": side, "found": name}), side)
        pairs = join_hot(pairs, keyed, side, "weight", total).drop("weight")
    both = pairs.withColumn("both", F.size(F.array_intersect("x", "y")))
    out = stage(both.where(F.col("both") + F.lit(1e-9) >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("both"))).select("u", "v"), label)
    finished(listed, sets)
    return out


def _alike(told: DataFrame, radius: int) -> DataFrame:
    """Pairs u, v of sets whose fingerprints are equal or within the radius: of each fingerprint its least set is compared."""
    nodes = told.select("node", "fp").distinct()
    lead = stage(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")), "leads")
    equal = join_hot(nodes, lead.where("n > 1"), "fp", "n", nodes.count()).where("node != lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    near = simhash.links(lead.select("fp"), radius).distinct()
    for side in ("u", "v"):
        near = near.join(lead.select(F.col("fp").alias(side), F.col("lead").alias(f"{side}_lead")), side).drop(side)
    return equal.unionByName(near.select(F.least("u_lead", "v_lead").alias("u"), F.greatest("u_lead", "v_lead").alias("v")))


def links(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """Links (u, v) of shingle sets that join exactly those reachable by steps of the similarity or more. ``texts``: text, without nulls.

    Sets whose SimHash fingerprints are within ``radius`` bits are compared, by tiles. Most sets with the similarity are further apart, so
    each shingle's first and last set are compared with its others; then all pairs that these links leave apart. Every pair is checked
    by its exact similarity.
    """
    told = _sets(texts, shingle, similarity)
    own = ["node", "n", "many", *PARITY]
    held = told.select(*own, F.posexplode("tokens").alias("pos", "token"))
    whole = F.struct(*own)
    ends = held.groupBy("token").agg(F.min(whole).alias("least"), F.max(whole).alias("most"), F.count("*").alias("held")).where("held > 1")
    held = shared = stage(join_hot(held, ends, "token", "held", held.count()), "held")
    star = held.select(*own, F.explode(F.array("least", "most")).alias("end")).where("node != end.node").where(_fits("", "end.", similarity))
    star = star.select(F.least("node", "end.node").alias("u"), F.greatest("node", "end.node").alias("v"))
    near = _verified(star.unionByName(_alike(told, radius)), texts, shingle, similarity, "star")
    label = components(near).withColumnRenamed("u", "node")
    held = held.drop("least", "most").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = labelled = stage(held, "labelled")
    finished(told, shared)
    apart = held.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held")).where("low != high")
    held = join_hot(held.drop("held"), apart, "token", "held", held.count()).drop("low", "high")
    held = held.withColumn("cells", F.ceil(F.col("held") / CELL).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    held = stage(held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))), "cells")
    finished(labelled)
    a = held.select("token", F.col("part").alias("i"), F.col("other").alias("j"), *(F.col(c).alias(f"a_{c}") for c in (*own, "label", "pos")))
    b = held.select("token", F.col("other").alias("i"), F.col("part").alias("j"), *(F.col(c).alias(f"b_{c}") for c in (*own, "label", "pos")))
    # what two sets share of their first shingles lies at or after the first that both hold, so there this leaves room for enough of it
    room = F.least(F.col("a_many") - F.col("a_pos"), F.col("b_many") - F.col("b_pos")) >= level(F.least("a_n", "b_n"))
    pairs = a.join(b, ["token", "i", "j"]).where("a_label < b_label").where(room).where(_fits("a_", "b_", similarity))
    pairs = pairs.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v"))
    rest = _verified(pairs, texts, shingle, similarity, "rest")
    finished(held)
    return near.unionByName(rest)


def survivors(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, unchanged.

    Texts are near copies if their sets of ``shingle`` words have a Jaccard similarity of ``similarity`` at least; groups are what such
    steps join, and texts without words are one group. The row with the smallest doc_id stays, a null one ranks first; of rows of
    the group that repeat it, the one with the smallest text. Rows with the same id in different groups don't touch each other. Very long
    texts are read whole; all other columns stay, whatever their names. An empty table gives no rows.
    """
    key, digest = unused("id_key", docs.columns), unused("id_digest", docs.columns)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    known = docs.withColumns({key: F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), digest: F.xxhash64(text)})
    plain = slim(docs)
    rows = stage(plain.withColumn("digest", F.xxhash64("text")).mapInArrow(_rows(shingle), "doc_id long, digest long, node long").distinct(), "rows")
    label = components(links(plain.select("text"), shingle, similarity)).withColumnRenamed("u", "node")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = stage(nodes, "nodes")
    first = nodes.groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    lead = rows.join(nodes.join(first, ["label", "doc_id"]), ["node", "doc_id"]).select("label", "doc_id", "digest")
    lead = stage(lead, "lead")
    of = lead.groupBy("label").agg(F.first("doc_id").alias(key), F.min("digest").alias("one"), F.max("digest").alias("other"))
    kept = of.where("one = other").select(key, F.col("one").alias(digest))
    clash = of.where("one != other").select("label")
    if not clash.isEmpty():
        several = lead.join(clash, "label").withColumnsRenamed({"doc_id": key, "digest": digest})
        texts = known.select(key, digest, text.alias("text")).join(several, [key, digest])
        least = texts.groupBy("label").agg(F.min(F.struct("text", key, digest)).alias("least"))
        kept = kept.unionByName(least.select(f"least.{key}", f"least.{digest}"))
    kept = stage(kept, "kept")
    return known.dropDuplicates([key, digest]).join(kept.hint("shuffle_hash"), [key, digest], "left_semi").select(*docs.columns)
