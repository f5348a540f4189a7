"""Suffix-array dedup: bytes covered by a long string that also starts earlier in the corpus are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, bwt
from .common import bytes_of, cut_spans, frugal, join_hot, known_rows, longs_of, partitions_for, parts, stage
from .rolling import BYTE, Prefix, mix

LENGTH = 100
GRAM = 32
#: Text of a bundle that one Burrows-Wheeler transform takes, about; and most occurrences of an anchor that go into one.
BUNDLE, MOST_OCCURRENCES = 750_000, 50_000
#: An anchor with more occurrences, or one in FREQUENT_SHARE of all anchors, is known before the pieces are dealt, and spread.
HOT = 50_000
SLICE = 500_000


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) of every window of the width."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return f(x[:-rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, offset, and the range around it, of selected grams.

    In every string of ``length`` bytes the gram with the smallest hash is selected, so equal strings share an anchor's hash, and each
    lies inside the range of its anchor. Of long runs of equal hashes (periodic text) enough are kept for each string to hold one.
    """
    width = length - gram + 1
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = (np.zeros(0, np.int64),) * 5
    if not (sizes >= length).any():
        return none
    ends = np.cumsum(sizes)
    h = Prefix(BYTE[buf]).every(gram)
    # strings that begin less than ``length`` before a text's end aren't strings
    valid = np.ones(len(buf) - length + 1, bool)
    cross = np.zeros(len(buf) + 1, np.int32)
    np.add.at(cross, np.maximum(ends - length + 1, 0), 1)
    np.add.at(cross, ends, -1)
    valid = np.cumsum(cross)[: len(valid)] == 0
    least = _slide(h, width, np.minimum)
    least[~valid] = 0
    padded = np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]
    at = np.flatnonzero((_slide(padded, width, np.maximum) == h) & (h != 0))
    if not len(at):
        return none
    # thin out chains of equal hashes at most 8 bytes apart: first, last, and the first in each 48 bytes
    near = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) <= 8)
    inside = np.r_[False, near] & np.r_[near, False]
    moved = np.r_[True, at[1:] // 48 != at[:-1] // 48]
    at = at[~inside | moved]
    text = np.searchsorted(ends, at, side="right")
    begin, end = (ends - sizes)[text], ends[text]
    # strings that hold a neighbour with a smaller hash aren't this anchor's
    lo, hi = np.maximum(at - width + 1, begin), np.minimum(at, end - length)
    smaller = (h[at[:-1]] < h[at[1:]]) & (text[:-1] == text[1:])
    lo[1:] = np.where(smaller, np.maximum(lo[1:], at[:-1] + 1), lo[1:])
    larger = (h[at[:-1]] > h[at[1:]]) & (text[:-1] == text[1:])
    hi[:-1] = np.where(larger, np.minimum(hi[:-1], at[1:] - width), hi[:-1])
    ok = lo <= hi
    return text[ok], h[at[ok]], (at - begin)[ok], (lo - begin)[ok], (hi + length - begin)[ok]


def chunks(texts: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of bounded size, of which each string of ``length`` bytes is in exactly one: the chunks, their texts, and their offsets."""
    out, of, at = [], [], []
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 1), SLICE):
            out.append(t if len(t) <= SLICE else t[a : a + SLICE + length - 1])
            of.append(k)
            at.append(a)
    return out, np.array(of, np.int64), np.array(at, np.int64)


def _lots(texts: list[bytes]) -> Iterator[slice]:
    """Ranges of texts with about SLICE bytes."""
    a = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > 2 * SLICE:
            yield slice(a, k)
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield slice(a, len(texts))


class _Keys:
    def __init__(self, length: int):
        self.length = length

    def __call__(self, whole: pa.RecordBatch) -> Iterator[np.ndarray]:
        for batch in parts(whole, most=SLICE):
            some = chunks(bytes_of(batch, "text"), self.length)[0]
            for k in _lots(some):
                yield anchors(some[k], self.length)[1]


PLACE = ["doc_id", "row", "start"]
PIECE = "deal long, spread boolean, digest long, doc_id long, row long, start int, end int, piece binary"


def _pieces(again, hot, length: int):
    """Pieces around anchors that may repeat, dealt by anchor; those of hot anchors are spread by their place. A task gives the bytes
    of equal pieces once, in any row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()

        def pieces(texts: list[bytes], ids: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
            text, h, _, lo, hi = anchors(texts, length)
            ok = bloom.maybe_repeated(again.value, h)
            text, h, lo, hi = text[ok], h[ok], lo[ok], hi[ok]
            cut = [texts[t][a:b] for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            digests = [xxhash.xxh3_64_intdigest(x) for x in cut]
            for k, d in enumerate(digests):
                if d in told:
                    cut[k] = None
                else:
                    told.add(d)
            if len(told) > 500_000:
                told.clear()
            lo, hi = lo + begin[text], hi + begin[text]
            spread = bloom.among(h, hot.value)
            deal = np.where(spread, mix(rows[text].view(np.uint64) + lo.astype(np.uint64)), h).view(np.int64)
            digests = np.array(digests, np.uint64).view(np.int64)
            cols = [deal, spread, digests, ids[text], rows[text], lo.astype(np.int32), hi.astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cut, pa.binary())], names=["deal", "spread", "digest", *PLACE, "end", "piece"])

        for whole in batches:
            for batch in parts(whole, most=SLICE):
                some, of, begin = chunks(bytes_of(batch, "text"), length)
                ids, rows = longs_of(batch, "doc_id")[of], longs_of(batch, "row")[of]
                yield from (pieces(some[k], ids[k], rows[k], begin[k]) for k in _lots(some))

    return run


def bundle_spans(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, piece: list[bytes | None], length: int) -> tuple[np.ndarray, ...]:
    """Spans to remove, of whole anchor groups: doc, row, start, end."""
    order = np.lexsort((row, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1])]
    docs, rows = doc[order][new], row[order][new]
    doc = np.empty(len(order), np.int64)  # from here on a text's rank by doc_id and row
    doc[order] = np.cumsum(new) - 1
    which = np.unique(digest, return_inverse=True)[1]
    _, at, times = np.unique(anchor, return_inverse=True, return_counts=True)
    many = times[at] > 1
    order = np.lexsort((start, doc, which))
    first = np.r_[True, which[order][1:] != which[order][:-1]]
    lead = order[first]  # the earliest occurrence of each distinct piece
    of = lead[np.cumsum(first) - 1]
    later = order[(doc[order] != doc[of]) | (start[order] != start[of])]  # not so the pieces of a row that is there twice
    out = [(doc[later], start[later], end[later])]  # equal to an earlier piece from end to end
    text: list[bytes] = [b""] * (int(which.max()) + 1)
    for w, p in zip(which.tolist(), piece, strict=True):
        if p is not None:
            text[w] = p
    lead = lead[many[lead]]
    if len(lead):
        k, offset, group = bwt.classes([text[w] for w in which[lead].tolist()], length)
        if len(k):
            d, s = doc[lead][k], start[lead][k] + offset
            order = np.lexsort((s, d, group))
            d, s, g = d[order], s[order], group[order]
            # one string may be in several pieces: a place that equals its class's earliest isn't later
            new = np.r_[True, g[1:] != g[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            later = (d != d[at]) | (s != s[at])
            d, s = d[later], s[later]
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            new = np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)] if len(d) else np.zeros(0, bool)
            a = np.flatnonzero(new)
            out.append((d[a], s[a], s[np.r_[a[1:] - 1, len(d) - 1]] + length if len(d) else s))
    d, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    return docs[d], rows[d], s, e


#: A span, where digest is null; else a piece whose strings are yet to be compared.
SPAN = "doc_id long, row long, start int, end int, digest long, piece binary"


def _bundles(length: int, most: int):
    """Rows come sorted by ``deal``. Memory is bounded by BUNDLE and ``most`` rows, whatever a group's size: pieces of groups with
    more, like those that are spread, come out as they are."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: rows.column(c).to_numpy()
        found = bundle_spans(get("deal"), get("digest"), *(get(c) for c in PLACE), get("end"), rows.column("piece").to_pylist(), length)
        none = [pa.nulls(len(found[0]), pa.int64()), pa.nulls(len(found[0]), pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)), *none], names=[*PLACE, "end", "digest", "piece"])

    def pieces(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        out = rows.select([*PLACE, "end", "digest", "piece"])
        yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = n = 0
        large = None  # a group that came out as it is, and may go on
        for whole in batches:
            apart = whole.column("spread")
            if apart.true_count:
                yield from pieces(whole.filter(apart))
                whole = whole.filter(pc.invert(apart))
            for at in range(0, len(whole), 5000):
                batch = whole.slice(at, 5000)
                if large is not None:
                    more = int((batch.column("deal").to_numpy() == large).sum())
                    if more:
                        yield from pieces(batch.slice(0, more))
                        batch = batch.slice(more)
                    if not len(batch):
                        continue
                    large = None
                held.append(batch)
                size, n = size + batch.column("piece").nbytes, n + len(batch)
                if size > BUNDLE or n > most:
                    rows = pa.Table.from_batches(held)
                    keys = rows.column("deal").to_numpy()
                    cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])  # the last group may go on
                    if cut:
                        yield spans(rows.slice(0, cut))
                    held, size, n = rows.slice(cut).combine_chunks().to_batches(), 0, len(rows) - cut
                    if n > most:
                        yield from pieces(rows.slice(cut))
                        held, n, large = [], 0, keys[-1]
                    size = sum(x.column("piece").nbytes for x in held)
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def _every_string(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 2000):
                batch = whole.slice(k, 2000)
                digests, at, starts = [], [], []
                for k, (start, piece) in enumerate(zip(longs_of(batch, "start").tolist(), bytes_of(batch, "piece"), strict=True)):
                    n = len(piece) - length + 1
                    digests += [xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(n)]
                    at += [k] * n
                    starts += range(start, start + n)
                at = np.array(at, np.int64)
                cols = [pa.array(digests, pa.binary()), *(pa.array(longs_of(batch, c)[at]) for c in ("doc_id", "row")), pa.array(starts, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["digest", *PLACE])

    return run


def _later(rows: DataFrame) -> DataFrame:
    """Rows whose digest also occurs earlier."""
    place = F.struct(*PLACE)
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_hot(rows, first, "digest", "n", rows.count()).where(place != F.col("first"))


def spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans doc_id, row, start, end (bytes, overlapping) of all strings of ``length`` bytes that also start earlier. ``rows``: doc_id,
    row, text.

    Anchors are counted in a Bloom filter; pieces around those that may repeat are dealt by anchor, and each bundle of anchor groups
    goes through one Burrows-Wheeler transform. Anchors with very many pieces are parted by the longest gram there is, the string
    itself: equal pieces are reduced to the earliest, whose strings are hashed and grouped, which is exact as well. Such anchors are
    told from the filter's counts, and spread (HOT); what those miss shows when a group passes MOST_OCCURRENCES.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    again, hot = bloom.repeated_and_frequent(rows, _Keys(length), size * 2 // (length - GRAM) + 1, HOT)
    sent = rows.sparkSession.sparkContext.broadcast(hot)
    dealt = rows.mapInArrow(frugal(_pieces(again, sent, length)), PIECE).repartition(partitions_for(rows.sparkSession, 2 * size), "deal").sortWithinPartitions("deal")
    got = stage(dealt.mapInArrow(frugal(_bundles(length, MOST_OCCURRENCES)), SPAN), "bundles")
    out = got.where("digest is null").select(*PLACE, "end")
    much = got.where("digest is not null")
    if much.isEmpty():
        return out
    equal = _later(much.drop("piece")).select(*PLACE, "end")
    # a row with the bytes need not be the piece's earliest: its strings count from the earliest place
    lead = much.groupBy("digest").agg(F.min(F.struct(*PLACE)).alias("first"), F.first("piece", ignorenulls=True).alias("piece"))
    strings = stage(lead.select("first.*", "piece").mapInArrow(frugal(_every_string(length)), "digest binary, doc_id long, row long, start int"), "strings")
    same = _later(strings).select(*PLACE, (F.col("start") + length).alias("end"))
    return out.unionByName(equal).unionByName(same)


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id, or in the same
    document before it. Overlaps count; strings are judged on the input.

    Returns for each row doc_id, n_bytes, spans (maximal removed runs as byte offsets of the UTF-8 text) and kept (the bytes that
    stay). A null text is empty. Texts under ``length`` bytes lose nothing. A null doc_id ranks first and comes back null. Rows with
    one doc_id, or none, and different texts are documents of their own, ranked by a digest of the text; rows equal in both are one
    document, so they don't remove each other. Very long texts are read whole, in overlapping chunks; all other columns are left out, whatever their names. An empty table gives no rows.
    """
    rows = known_rows(docs)
    return cut_spans(rows, spans(rows, length))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, hash(b[s:s + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS s FROM d WHERE n >= 100)),
f AS (SELECT h, min(doc_id) AS doc_id FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT w.h, f.doc_id, min(s) AS s FROM w JOIN f ON w.h = f.h AND w.doc_id = f.doc_id GROUP BY ALL),
l AS (SELECT w.doc_id, w.s FROM w JOIN r ON w.h = r.h WHERE w.doc_id <> r.doc_id OR w.s <> r.s),
g AS (SELECT doc_id, s, s - lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) > 100 AS new FROM l),
p AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 99 AS z FROM p GROUP BY ALL),
by_doc AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1)::BIGINT AS n_removed, list(a ORDER BY a) AS las, list(z ORDER BY a) AS zs FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, n_spans + 1), lambda i: hex(b[CASE WHEN i = 0 THEN 1 ELSE zs[i] + 1 END : CASE WHEN i = n_spans THEN n ELSE las[i + 1] - 1 END])), '')) END) AS kept_sha256
FROM d LEFT JOIN by_doc ON by_doc.doc_id = d.doc_id
"""
