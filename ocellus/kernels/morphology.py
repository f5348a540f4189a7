"""Components, morphology with disks, thinning, and the shape of regions."""

from __future__ import annotations

import numpy as np


def label(mask: np.ndarray, neighbours: int) -> tuple[np.ndarray, int]:
    """Numbers the components of a mask from 1, by 4 or 8 neighbours. All pixels link at once; labels then jump to their root."""
    at = np.full(mask.shape, -1)
    n = int(mask.sum())
    at[mask] = np.arange(n)
    pairs = [(at[:, 1:], at[:, :-1]), (at[1:], at[:-1])]
    if neighbours == 8:
        pairs += [(at[1:, 1:], at[:-1, :-1]), (at[1:, :-1], at[:-1, 1:])]
    a = np.concatenate([x[(x >= 0) & (y >= 0)] for x, y in pairs])
    b = np.concatenate([y[(x >= 0) & (y >= 0)] for x, y in pairs])
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    names, number = np.unique(root, return_inverse=True)
    out = np.zeros(mask.shape, int)
    out[mask] = number + 1
    return out, len(names)


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Without components (4 neighbours) of fewer pixels."""
    if not mask.any():
        return mask
    numbers, n = label(mask, 4)
    keep = np.bincount(numbers.ravel(), minlength=n + 1) >= int(least)
    keep[0] = False
    return keep[numbers]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that 4 neighbours don't connect to the border becomes foreground."""
    outside, _ = label(np.pad(~mask, 1, constant_values=True), 4)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def _extreme(img: np.ndarray, radius: int, outside: float, pick) -> np.ndarray:
    """Minimum or maximum over a disk x^2 + y^2 <= r^2: for each row of the disk a running extreme of its width."""
    h, w = img.shape
    p = np.pad(img, radius, constant_values=outside)
    out = None
    for dy in range(-radius, radius + 1):
        half = int(np.sqrt(radius * radius - dy * dy))
        row = p[radius + dy : radius + dy + h, radius - half : p.shape[1] - radius + half]
        width, k = 2 * half + 1, 1
        while 2 * k <= width:
            row = pick(row[:, :-k], row[:, k:])
            k *= 2
        if width > k:
            row = pick(row[:, : row.shape[1] - (width - k)], row[:, width - k :])
        out = row[:, :w] if out is None else pick(out, row[:, :w])
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Outside the frame counts as background."""
    return _extreme(mask, radius, False, np.logical_and)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return _extreme(mask, radius, False, np.logical_or)


def bright_spots(img: np.ndarray, radius: int) -> np.ndarray:
    """What an opening by a disk takes away."""
    return img - _extreme(_extreme(img, radius, np.inf, np.minimum), radius, -np.inf, np.maximum)


def dark_spots(img: np.ndarray, radius: int) -> np.ndarray:
    """What a closing by a disk adds."""
    return _extreme(_extreme(img, radius, -np.inf, np.maximum), radius, np.inf, np.minimum) - img


def around(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from above."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning (1984)."""
    img = mask.astype(bool).copy()
    while True:
        changed = False
        for step in (0, 1):
            n = around(img)
            count = sum(x.astype(np.int8) for x in n)
            turns = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
            up, right, down, left = n[0], n[2], n[4], n[6]
            clear = ~(up & right & down) & ~(right & down & left) if step == 0 else ~(up & right & left) & ~(up & down & left)
            gone = img & (count >= 2) & (count <= 6) & (turns == 1) & clear
            if gone.any():
                img &= ~gone
                changed = True
        if not changed:
            return img


def regions(numbers: np.ndarray, n: int, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """area, y, x (centroid), eccentricity, and mean of ``weight``, of components 1 to n."""
    at = numbers > 0
    k = numbers[at] - 1
    y, x = (c.astype(float) for c in np.nonzero(at))
    total = lambda v=None: np.bincount(k, v, n)
    area = total()
    cy, cx = total(y) / area, total(x) / area
    # a pixel has an extent of its own, hence the twelfth
    yy, xx, xy = total(y * y) / area - cy**2 + 1 / 12, total(x * x) / area - cx**2 + 1 / 12, total(x * y) / area - cx * cy
    root = np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
    large, small = (yy + xx) / 2 + root, (yy + xx) / 2 - root
    out = {"area": area, "y": cy, "x": cx, "eccentricity": np.sqrt(np.clip(1 - small / large, 0, 1))}
    if weight is not None:
        out["weight"] = total(weight[at].astype(float)) / area
    return out
