"""A Bloom filter of repeated keys, built without a shuffle of the keys.

Each task counts its keys' bits up to two (seen, seen again) and emits only the bytes it touched, by segment; segments are
merged on the executors. What reaches the driver and is broadcast is the "seen again" bitmap of at most MAX_BITS bits
(MAX_BITS / 8 bytes), however large the input. A key that occurs twice always tests true; a unique key tests true by
chance only. Past MAX_BITS / BITS_PER_KEY keys the filter lets more unique keys through: they cost shuffle, never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import frugal

BITS_PER_KEY = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
SEGMENT = 8192  # bytes
CHUNK = 1 << 18  # keys
#: Tasks that build; more partitions are read by fewer tasks, so a segment meets a bounded number of pieces.
MAX_TASKS = 1024
#: Frequent keys are looked for above this share of all keys, or a rarer one: so at most twice as many are gathered.
FREQUENT_SHARE = 1 << 16


def n_bits(n_keys: int, most: int = MAX_BITS) -> int:
    return min(most, max(MIN_BITS, 1 << (max(n_keys, 1) * BITS_PER_KEY - 1).bit_length()))


def _positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return keys & mask, ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask


def maybe_repeated(again: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for each key that may occur more than once. ``again``: packed bitmap."""
    ok = np.ones(len(keys), bool)
    for p in _positions(keys, len(again) * 8):
        ok &= (again[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def _pack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers and bits to set, of sorted positions."""
    at = (pos >> np.uint64(3)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (pos & np.uint64(7)).astype(np.uint8)), first)


def _add(once: np.ndarray, again: np.ndarray, keys: np.ndarray, bits: int) -> None:
    # A key whose two positions are one bit counts once.
    a, b = _positions(keys, bits)
    pos = np.sort(np.concatenate([a, b[a != b]]))
    if not len(pos):
        return
    same = pos[1:] == pos[:-1]
    if same.any():
        at, v = _pack(pos[1:][same])
        again[at] |= v
    at, v = _pack(pos[np.r_[True, ~same]])
    again[at] |= once[at] & v
    once[at] |= v


class _Build:
    def __init__(self, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int, often: int, buckets: int):
        self.keys, self.bits, self.often, self.buckets = keys, bits, often, buckets

    def _frequent(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keys that one chunk holds ``often``, with their counts, as pieces of no segment: dealt to ``buckets`` by key."""
        if self.often:
            s = np.sort(keys)
            if len(s) > self.often and (s[self.often :] == s[: -self.often]).any():
                k, n = np.unique(s, return_counts=True)
                ok = n > self.often
                k, n = k[ok], n[ok].astype(np.int64)
                bucket = (k % np.uint64(self.buckets)).astype(np.int64)
                for x in np.unique(bucket).tolist():
                    yield _piece(-1 - x, b"", k[bucket == x].tobytes(), n[bucket == x].tobytes())

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(self.bits // 8, np.uint8), np.zeros(self.bits // 8, np.uint8)
        held, n = [], 0
        for batch in batches:
            for got in self.keys(batch):
                held.append(got)
                n += len(got)
                if n >= CHUNK:
                    chunk = np.concatenate(held)
                    _add(once, again, chunk, self.bits)
                    yield from self._frequent(chunk)
                    held, n = [], 0
        if n:
            chunk = np.concatenate(held)
            _add(once, again, chunk, self.bits)
            yield from self._frequent(chunk)
        for k in range(0, len(once), SEGMENT):
            o, a = once[k : k + SEGMENT], again[k : k + SEGMENT]
            at = np.flatnonzero(o)
            if len(at):
                sparse = len(at) < SEGMENT // 2
                yield _piece(k // SEGMENT, at.astype(np.uint16).tobytes() if sparse else b"", (o[at] if sparse else o).tobytes(), (a[at] if sparse else a).tobytes())


def _piece(segment: int, at: bytes, once: bytes, again: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), *(pa.array([x], pa.binary()) for x in (at, once, again))], names=["segment", "at", "once", "again"])


def _merger(limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["segment"].iloc[0] >= 0:
            return _merge(pdf)
        keys, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["once"]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["again"]])).astype(np.int64)
        return pd.DataFrame({"segment": [-1], "again": [keys[2 * n > limit].tobytes()]})

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once, again = np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)
    for at, o, a in zip(pdf["at"], pdf["once"], pdf["again"], strict=True):
        i = np.frombuffer(at, np.uint16) if len(at) else slice(None)
        o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
        again[i] |= a | (once[i] & o)
        once[i] |= o
    return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "again": [again.tobytes()]})


def repeated(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n_keys: int) -> Broadcast:
    """The broadcast bitmap of keys seen more than once. ``keys`` gives uint64 arrays of a batch of ``df``; n_keys: about how many."""
    return repeated_and_frequent(df, keys, n_keys, 0)[0]


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """True for each key that is in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def repeated_and_frequent(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n_keys: int, limit: int, most_bits: int = MAX_BITS) -> tuple[Broadcast, np.ndarray]:
    """The bitmap and, sorted, the keys that occur over 1.5 * limit times, with some of those over half the limit.

    ``limit`` is n_keys / FREQUENT_SHARE at least, so fewer than 2 * FREQUENT_SHARE keys (1 MB) are gathered, whatever the input. A key
    over the limit makes up more than its even share of some task's chunk; only such keys are counted, in buckets by key.
    """
    bits = n_bits(n_keys, most_bits)
    limit = limit and max(limit, n_keys // FREQUENT_SHARE)
    chunks = min(df.rdd.getNumPartitions(), MAX_TASKS) + n_keys // CHUNK + 1 if limit else 0
    often = max(2, limit // chunks) if limit else 0
    buckets = min(max(16, chunks // 8), 1 << 16)
    pieces = df.coalesce(MAX_TASKS).mapInArrow(frugal(_Build(keys, bits, often, buckets)), "segment int, at binary, once binary, again binary")
    merged = pieces.groupBy("segment").applyInPandas(_merger(limit), "segment int, again binary")
    out, frequent = np.zeros(bits // 8, np.uint8), [np.zeros(0, np.uint64)]
    for row in merged.toLocalIterator():
        if row["segment"] < 0:
            frequent.append(np.frombuffer(row["again"], np.uint64))
        else:
            out[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["again"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(out), np.sort(np.concatenate(frequent))
