"""Statistics of small image patches held as arrays: one projection each, nothing is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def values(array: str) -> Column:
    return F.expr(f"transform({array}, x -> cast(x as double))")


def mean(v: str) -> Column:
    return F.expr(f"aggregate({v}, cast(0 as double), (a, x) -> a + x) / size({v})")


def central(v: str, m: str, k: int) -> Column:
    """Central moment of order k around the column m."""
    return F.expr(f"aggregate({v}, cast(0 as double), (a, x) -> a + {' * '.join([f'(x - {m})'] * k)}) / size({v})")


def percentile(ordered: str, q: float) -> Column:
    """Linear percentile of a sorted array."""
    at = f"({q}D * (size({ordered}) - 1))"
    lo = f"{ordered}[cast(floor({at}) as int)]"
    hi = f"{ordered}[cast(ceil({at}) as int)]"
    return F.expr(f"{lo} + ({at} - floor({at})) * ({hi} - {lo})")


def entropy(v: str) -> Column:
    """Shannon entropy, base 2, of the distinct values."""
    share = f"(cast(size(filter({v}, y -> y = x)) as double) / size({v}))"
    return F.expr(f"-aggregate(transform(array_distinct({v}), x -> {share} * log2({share})), cast(0 as double), (a, x) -> a + x)")


def quantised(v: str, levels: int, low: float, high: float) -> Column:
    return F.expr(f"transform({v}, x -> least({levels - 1}, greatest(0, cast(floor((x - {low}D) / {high - low:.6f}D * {levels}) as int))))")


def zone_means(v: str, side: int, zones: int) -> Column:
    """Mean of each ring around the centre; the last ring is open."""
    c = (side - 1) / 2
    ring = [min(zones - 1, int((((i // side - c) ** 2 + (i % side - c) ** 2) ** 0.5) / (side / 2) * zones)) for i in range(side * side)]
    cells = [[i for i, r in enumerate(ring) if r == z] for z in range(zones)]
    return F.array(*[F.expr("(" + " + ".join(f"{v}[{i}]" for i in z) + f") / {len(z)}") if z else F.lit(0.0) for z in cells])


def slope(means: str, n: int) -> Column:
    """Least-squares slope over 0, 1, ..., n - 1."""
    c = (n - 1) / 2
    return F.expr("(" + " + ".join(f"({k - c}D) * {means}[{k}]" for k in range(n)) + f") / {sum((k - c) ** 2 for k in range(n))}D")


#: Neighbours in order around a pixel.
AROUND = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def lbp_codes(v: str, side: int) -> Column:
    """Uniform local binary pattern of each inner pixel: ones if there are two changes around it at most, else 9."""
    inner = f"filter(sequence(0, {side * side - 1}), i -> i div {side} between 1 and {side - 2} and i % {side} between 1 and {side - 2})"
    bits = ", ".join(f"if({v}[i + ({a * side + b})] >= {v}[i], 1, 0)" for a, b in AROUND)
    packed = f"transform({inner}, i -> array({bits}))"
    changes = " + ".join(f"abs(b[{k}] - b[{(k + 1) % 8}])" for k in range(8))
    ones = " + ".join(f"b[{k}]" for k in range(8))
    return F.expr(f"transform({packed}, b -> if({changes} <= 2, {ones}, 9))")


def histogram(codes: str, bins: int) -> Column:
    return F.expr(f"transform(sequence(0, {bins - 1}), k -> cast(size(filter({codes}, c -> c = k)) as double) / size({codes}))")


def pairs(q: str, side: int) -> Column:
    """Grey levels of horizontal neighbours."""
    return F.expr(f"transform(filter(sequence(0, {side * side - 1}), i -> i % {side} < {side - 1}), i -> struct({q}[i] as a, {q}[i + 1] as b))")


def laplacian(v: str, side: int) -> Column:
    """Sum of second differences along both axes; the border repeats."""
    up = f"{v}[if(i < {side}, i, i - {side})]"
    down = f"{v}[if(i >= {side * (side - 1)}, i, i + {side})]"
    left = f"{v}[if(i % {side} = 0, i, i - 1)]"
    right = f"{v}[if(i % {side} = {side - 1}, i, i + 1)]"
    return F.expr(f"transform(sequence(0, {side * side - 1}), i -> {up} + {down} + {left} + {right} - 4 * {v}[i])")
