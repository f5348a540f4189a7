"""SimHash near-dedup: fingerprints, tiled exact comparison, and components of linked fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, frugal, join_hot, per_batch, public_id, slim, stage
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: A tile holds the fingerprints with the same number of bits in each of four 16-bit words.
SIDE = 17
N_TILES = SIDE**4
#: Most fingerprints of a tile that one cell compares with others; larger tiles are dealt to several cells.
CELL = 16_384
#: Fingerprints that one task deals; bytes that it packs at a time; comparisons, and bytes read, of one task that compares.
DEAL, PACK, TASK_PAIRS, TASK_BYTES = 65_536, 8_000_000, 2_000_000_000, 16_000_000
#: Bytes of a text whose shingles are held at a time.
PART = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_DIGITS = np.array([SIDE**3, SIDE**2, SIDE, 1])


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints. A bit is 1 if set in over half of the XXH64 (seed 42) of a text's word shingles."""
    out = np.zeros(len(texts), np.uint64)
    held: list[bytes] = []
    rows: list[int] = []
    sizes: list[int] = []

    def settle() -> None:
        if not held:
            return
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
        n = np.array(sizes)
        ones = np.add.reduceat(bits, np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
        held.clear(), rows.clear(), sizes.clear()

    for k, text in enumerate(texts):
        got = []
        ones, n = None, 0
        tail: list[bytes] = []
        for part in _parts(text):
            words = tail + part.lower().split()
            got = digests(words, shingle)
            if len(text) > PART and len(words) >= shingle:  # a long text's shingles are counted part by part
                bits = np.unpackbits(np.frombuffer(b"".join(got), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                ones, n = bits if ones is None else ones + bits, n + len(got)
            tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
        if ones is not None:
            out[k] = np.packbits(2 * ones > n).view(">u8")[0]
        elif got:
            held += got
            rows.append(k)
            sizes.append(len(got))
            if len(held) > 200_000:
                settle()
    settle()
    return out


def digests(words: list[bytes], shingle: int) -> list[bytes]:
    """Of every shingle; of all words together, if they are fewer than a shingle's; none of none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_digest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PART bytes, cut before a blank."""
    a = 0
    while a < len(text):
        cut = _BLANK.search(text, a + PART) if len(text) - a > PART else None
        b = cut.start() if cut else len(text)
        yield text[a:b]
        a = b


def _prints(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(bytes_of(batch, "text")).view(np.int64))], names=["doc_id", "fp"])


def tiles(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int64) @ _DIGITS


def offsets(radius: int) -> np.ndarray:
    """Differences of four word counts that add up to the radius at most, one of each opposite pair, without zero."""
    span = range(-radius, radius + 1)
    return np.array([d for d in product(span, repeat=4) if 0 < sum(map(abs, d)) <= radius and d > (0, 0, 0, 0)])


def _owners(tile: int, steps: np.ndarray) -> np.ndarray:
    """Tiles that compare their own fingerprints with those of ``tile``."""
    at = np.array([tile // SIDE**3, tile // SIDE**2 % SIDE, tile // SIDE % SIDE, tile % SIDE]) - steps
    return at[((at >= 0) & (at < SIDE)).all(axis=1)] @ _DIGITS


def _deal(cells, radius: int):
    """Send fingerprints, packed by tile, to their tile's cells and to the cells of the tiles that compare with it. A tile may come in
    parts, from any tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = offsets(radius)
        of = cells.value
        out: list[tuple[int, int, bool, bytes]] = []
        size = 0
        for fp in _many(batches):
            tile = tiles(fp)
            order = np.argsort(tile, kind="stable")
            fp, tile = fp[order], tile[order]
            edge = np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                for row in _sendings(int(tile[a]), fp[a:b], of, steps):
                    out.append(row)
                    size += len(row[3]) + 16
                    if size > PACK:
                        yield _pack(out)
                        out, size = [], 0
        if out:
            yield _pack(out)

    return run


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints, about DEAL at a time: the more of a tile are packed together, the fewer rows there are."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        if sum(map(len, held)) >= DEAL:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _sendings(t: int, own: np.ndarray, of: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, int, bool, bytes]]:
    """(tile, cell, whether as a guest, fingerprints) of what a tile's fingerprints are compared in."""
    n = int(of[t])
    part = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)
    for c in range(n):
        mine = own[part == c].tobytes()
        if mine:
            yield t, c, False, mine
            for d in range(c):
                yield t, d, True, mine
    whole = own.tobytes()
    for o in _owners(t, steps).tolist():
        for c in range(of[o]):
            yield o, c, True, whole


def planned(counts: np.ndarray, radius: int) -> tuple[int, int]:
    """Comparisons, and bytes sent, for these numbers of fingerprints by tile."""
    n = counts.reshape((SIDE,) * 4).astype(float)
    cells = np.ceil(n / CELL)
    pairs, sent = n * n / 2, n * (cells + 1) / 2
    for d in offsets(radius):
        here = tuple(slice(max(-x, 0), SIDE - max(x, 0)) for x in d)
        there = tuple(slice(max(x, 0), SIDE - max(-x, 0)) for x in d)
        pairs[here] += n[here] * n[there]
        sent[here] += cells[here] * n[there]
    return int(pairs.sum()), int(8 * sent.sum())


def _pack(rows) -> pa.RecordBatch:
    tile, cell, guest, prints = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(cell, pa.int32()), pa.array(guest, pa.bool_()), pa.array(prints, pa.binary())], names=["tile", "cell", "guest", "prints"])


class _Cell:
    """One cell's own fingerprints, and what they link to. Of a linked group only a spanning set of links is kept."""

    def __init__(self, own: np.ndarray, radius: int):
        self.own, self.radius = own, radius
        self.label = np.arange(len(own))
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(own), 256):
            self.meet(own[a : a + 256], a)

    def meet(self, others: np.ndarray, at: int | None = None) -> None:
        step = max(1, (1 << 18) // max(len(self.own), 1))
        for k in range(0, len(others), step):
            some = others[k : k + step]
            close = np.bitwise_count(some[:, None] ^ self.own[None, :]) <= self.radius
            if at is not None:
                close[np.arange(len(some)), at + k + np.arange(len(some))] = False
            g, h = np.nonzero(close)
            if not len(g):
                continue
            while True:  # those that share a partner get one root; only roots are hooked, so no earlier merge is cut
                root = self.label[h]
                least = np.full(len(some), len(self.own))
                np.minimum.at(least, g, root)
                if (root == least[g]).all():
                    break
                np.minimum.at(self.label, root, least[g])
                while ((up := self.label[self.label]) != self.label).any():
                    self.label = up
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            self.out.append((some[g[first]], self.own[h[first]]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.own)))
        self.out.append((self.own[moved], self.own[self.label[moved]]))
        return tuple(np.concatenate(x).view(np.int64) for x in zip(*self.out, strict=True))


def _compare(radius: int):
    """Rows come sorted by cell, its own fingerprints before the guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, cell = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if cell is not None:
                u, v = cell.links()
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            for tile, c, guest, prints in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (tile, c) != key:
                    if cell is None and own:
                        cell = _Cell(np.concatenate(own), radius)
                    yield from done()
                    key, own, cell = (tile, c), [], None
                got = np.frombuffer(prints, np.uint64)
                if not guest:
                    own.append(got)
                    continue
                if cell is None:
                    if not own:
                        continue
                    cell = _Cell(np.concatenate(own), radius)
                cell.meet(got)
        if cell is None and own:
            cell = _Cell(np.concatenate(own), radius)
        yield from done()

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints reachable by steps of ``radius`` bits or fewer.

    ``prints``: distinct fingerprints, fp. Two fingerprints can be within the radius only if the bit counts of their four words
    differ by no more in all, so only such tiles are compared, each pair of fingerprints once, by exclusive-or and bit count.
    """
    spark = prints.sparkSession
    tile = sum((F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") * int(_DIGITS[k]) for k in range(4)), F.lit(0))
    tiled = prints.select("fp", tile.alias("tile"))
    counts = np.zeros(N_TILES, np.int64)  # N_TILES numbers, whatever the input
    for row in tiled.groupBy("tile").count().toLocalIterator():
        counts[row["tile"]] = row["count"]
    sent = spark.sparkContext.broadcast(-(-counts // CELL))
    # both numbers of partitions follow the work, not the size of the few packed rows; a large tile is dealt by several tasks
    total = int(counts.sum())
    part = F.pmod(F.xxhash64("fp"), F.lit(-(-total // (DEAL << 8)) or 1))
    dealt = tiled.repartition(-(-total // DEAL) or 1, "tile", part).select("fp").mapInArrow(frugal(_deal(sent, radius)), "tile int, cell int, guest boolean, prints binary")
    pairs, size = planned(counts, radius)
    tasks = max(1, pairs // TASK_PAIRS, size // TASK_BYTES)
    met = dealt.repartition(tasks, "tile", "cell").sortWithinPartitions("tile", "cell", "guest")
    return met.mapInArrow(frugal(_compare(radius)), "u long, v long")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    r"""Fingerprint and component of every whole text.

    Words are ``[^\x20\x09-\x0D]+`` after A-Z are lower-cased; shingles are 3 words joined by a space, repeats included (fewer
    words: all of them; none: fingerprint zero). Fingerprints link at ``radius`` differing bits or fewer. Returns for each row doc_id,
    fingerprint (16 lower-case hex digits) and component_id, the smallest doc_id that links lead to, its own included. Null and
    empty texts have no words. A null doc_id ranks below all others and comes back null, in component_id too. Rows that repeat a doc_id
    are fingerprinted apart, and repeated rows are one node. Very long texts are read whole, part by part; all other columns are left out,
    whatever their names. An empty table gives no rows.
    """
    rows = stage(slim(docs).mapInArrow(per_batch(_prints), "doc_id long, fp long"), "prints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    label = components(links(nodes, radius)).select(F.col("u").alias("fp"), "label")
    known = stage(nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    total = rows.count()
    by_print = join_hot(known, smallest, "label", "nodes", total).select("fp", "n", "component_id")
    out = join_hot(rows, stage(by_print, "components"), "fp", "n", total)
    return out.select(public_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), public_id("component_id"))
