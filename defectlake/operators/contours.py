"""Connected parts of a mask and their outer borders, in NumPy."""

from __future__ import annotations

import numpy as np

_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def parts(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Eight-connected labels from 1, and their number, by smallest-label propagation with jumps."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(label, 1)
        low = label.copy()
        for dy, dx in _AROUND:
            near = padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
            low = np.where(mask & (near > 0), np.minimum(low, near), low)
        flat = np.concatenate(([0], low.ravel()))
        jumped = flat[low]
        jumped = np.where(mask, np.minimum(jumped, low), 0)
        if (jumped == label).all():
            break
        label = jumped
    names, out = np.unique(label, return_inverse=True)
    out = out.reshape(h, w)
    if not len(names) or names[0] != 0:
        out = out + 1
    return out, int(out.max(initial=0))


def outer_borders(mask: np.ndarray, least: int = 3) -> list[list[float]]:
    """Corners of each part's outer border, followed clockwise from its first pixel."""
    if not mask.any():
        return []
    label, n = parts(mask)
    out = []
    for k in range(1, n + 1):
        own = np.pad(label == k, 1)
        y, x = map(int, np.unravel_index(int(np.argmax(own)), own.shape))
        start, path, came = (y, x), [(y, x)], 4
        first = None
        while True:
            for turn in range(1, 9):
                d = (came + turn) % 8
                ny, nx = y + _AROUND[d][0], x + _AROUND[d][1]
                if own[ny, nx]:
                    break
            else:
                break
            if first is None:
                first = d
            elif (y, x) == start and d == first:
                break
            y, x, came = ny, nx, (d + 4) % 8
            path.append((y, x))
        if len(path) > 1 and path[-1] == path[0]:
            path.pop()
        corners = []
        for i, p in enumerate(path):
            a, b = path[i - 1], path[(i + 1) % len(path)]
            if len(path) < 3 or (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1]):
                corners.append(p)
        if len(corners) >= least:
            out.append([float(v) for cy, cx in corners for v in (cx - 1, cy - 1)])
    return out


def region_areas(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and the pixel count of each part, index 0 for the background."""
    label, n = parts(mask)
    return label, np.bincount(label.ravel(), minlength=n + 1)
