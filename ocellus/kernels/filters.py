"""Smoothing, derivatives, resizing, contrast, colour."""

from __future__ import annotations

import numpy as np


def _along(img: np.ndarray, weights: np.ndarray, axis: int, mode: str) -> np.ndarray:
    r = len(weights) // 2
    pad = [(0, 0)] * img.ndim
    pad[axis] = (r, r)
    p = np.pad(img, pad, mode=mode)
    out = np.zeros(img.shape, np.float64)
    n = img.shape[axis]
    for k, w in enumerate(weights):
        out += w * p[(slice(None),) * axis + (slice(k, k + n),)]
    return out


def gaussian(img: np.ndarray, sigma: float, mode: str = "symmetric") -> np.ndarray:
    """Separable; the kernel reaches four deviations. The border repeats mirrored ("symmetric") or its last value ("edge")."""
    if sigma <= 0:
        return img.astype(np.float64)
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    return _along(_along(img, w, 0, mode), w, 1, mode)


def laplace(img: np.ndarray) -> np.ndarray:
    second = np.array([1.0, -2.0, 1.0])
    return _along(img, second, 0, "symmetric") + _along(img, second, 1, "symmetric")


def sobel(img: np.ndarray) -> np.ndarray:
    """Magnitude of the two smoothed derivatives, their mean square's root."""
    smooth, slope = np.array([1.0, 2.0, 1.0]) / 4, np.array([1.0, 0.0, -1.0]) / 2
    h = _along(_along(img, slope, 0, "symmetric"), smooth, 1, "symmetric")
    v = _along(_along(img, slope, 1, "symmetric"), smooth, 0, "symmetric")
    return np.sqrt((h * h + v * v) / 2)


def resize(img: np.ndarray, size: int, smooth: bool) -> np.ndarray:
    """Bilinear to size x size, pixel centres aligned; shrinking is smoothed first by half of what the scale exceeds one."""
    src = img.astype(np.float64)
    planes = src if src.ndim == 3 else src[..., None]
    scale = np.array(planes.shape[:2]) / size
    if smooth:
        for axis in (0, 1):
            sigma = max(0.0, (scale[axis] - 1) / 2)
            if sigma > 0:
                r = int(4 * sigma + 0.5)
                w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
                planes = _along(planes, w / w.sum(), axis, "symmetric")
    where = []
    for axis in (0, 1):
        at = np.clip((np.arange(size) + 0.5) * scale[axis] - 0.5, 0, planes.shape[axis] - 1)
        lo = np.floor(at).astype(int)
        where.append((lo, np.minimum(lo + 1, planes.shape[axis] - 1), at - lo))
    (y0, y1, fy), (x0, x1, fx) = where
    rows = planes[y0] * (1 - fy)[:, None, None] + planes[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return out if src.ndim == 3 else out[..., 0]


def clahe(plane: np.ndarray, tile: int, clip: float, bins: int = 256) -> np.ndarray:
    """Histogram equalisation of tiles with clipped histograms, blended linearly between tile centres; result in [0, 1]."""
    h, w = plane.shape
    ny, nx = max(1, -(-h // tile)), max(1, -(-w // tile))
    low, high = float(plane.min()), float(plane.max())
    level = np.clip(((plane - low) / (high - low if high > low else 1) * (bins - 1)).round().astype(int), 0, bins - 1)
    level = np.pad(level, ((0, ny * tile - h), (0, nx * tile - w)), mode="symmetric" if min(h, w) >= tile else "edge")
    blocks = level.reshape(ny, tile, nx, tile).swapaxes(1, 2).reshape(ny * nx, -1)
    hist = np.zeros((ny * nx, bins))
    np.add.at(hist, (np.arange(ny * nx)[:, None], blocks), 1)
    most = max(clip * tile * tile, 1.0)
    over = np.maximum(hist - most, 0).sum(axis=1, keepdims=True)
    hist = np.minimum(hist, most) + over / bins
    maps = (np.cumsum(hist, axis=1) / (tile * tile)).reshape(ny, nx, bins)
    at = []
    for n, size in ((ny, h), (nx, w)):
        c = np.clip((np.arange(size) - (tile - 1) / 2) / tile, 0, n - 1)
        lo = np.floor(c).astype(int)
        at.append((lo, np.minimum(lo + 1, n - 1), c - lo))
    (y0, y1, fy), (x0, x1, fx) = at
    v = level[:h, :w]
    pick = lambda a, b: maps[a[:, None], b[None, :], v]
    fy, fx = fy[:, None], fx[None, :]
    return np.clip((pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx) * (1 - fy) + (pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx) * fy, 0, 1)


def hsv(rgb: np.ndarray) -> np.ndarray:
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    d = top - low
    safe = np.where(d > 0, d, 1)
    r, g, b = np.moveaxis(rgb, 2, 0)
    hue = np.select([d == 0, top == r, top == g], [0.0, (g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe) / 6 % 1.0
    return np.stack([hue, np.where(top > 0, d / np.where(top > 0, top, 1), 0), top], axis=2)


def ridges(plane: np.ndarray, sigmas: list[float], beta: float = 0.5) -> np.ndarray:
    """Dark line filter: the larger of the scales' responses, from the eigenvalues of the scaled second derivatives."""
    out = np.zeros(plane.shape)
    for s in sigmas:
        g = gaussian(plane, s)
        gy, gx = np.gradient(g)
        hyy, hyx = np.gradient(gy)
        hxx = np.gradient(gx, axis=1)
        hyy, hyx, hxx = (s * s * x for x in (hyy, hyx, hxx))
        mean, root = (hyy + hxx) / 2, np.sqrt(((hyy - hxx) / 2) ** 2 + hyx * hyx)
        a, b = mean - root, mean + root
        small, large = np.where(np.abs(a) <= np.abs(b), a, b), np.where(np.abs(a) <= np.abs(b), b, a)
        strength = np.sqrt(a * a + b * b)
        gamma = strength.max() / 2 or 1.0
        ratio = small / np.where(large == 0, 1, large)
        r = np.exp(-(ratio**2) / (2 * beta * beta)) * (1 - np.exp(-(strength**2) / (2 * gamma * gamma)))
        out = np.maximum(out, np.where(large > 0, r, 0))
    return np.nan_to_num(out, posinf=0.0, neginf=0.0)


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Centre of the bin that parts a histogram with the largest variance between its sides."""
    n, edges = np.histogram(values, bins)
    mid = (edges[:-1] + edges[1:]) / 2
    left, right = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    ml = np.cumsum(n * mid) / np.maximum(left, 1)
    mr = (np.cumsum((n * mid)[::-1]) / np.maximum(right[::-1], 1))[::-1]
    return float(mid[np.argmax(left[:-1] * right[1:] * (ml[:-1] - mr[1:]) ** 2)])
