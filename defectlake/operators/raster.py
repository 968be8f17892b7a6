"""Image kernels in NumPy: convolution, morphology, drawing, colour, warping, PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    return np.rint(image.astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32))


def blur(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, borders mirrored."""
    if sigma <= 0:
        return values.astype(np.float32)
    r = min(max(1, int(3 * sigma + 0.5)), min(values.shape[:2]) - 1)
    if r < 1:
        return values.astype(np.float32)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2).astype(np.float32)
    k /= k.sum()
    out = values.astype(np.float32)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect")
        n = out.shape[axis]
        out = sum(k[i] * np.take(padded, np.arange(i, i + n), axis) if out.ndim > 2 else k[i] * (padded[i : i + n] if axis == 0 else padded[:, i : i + n]) for i in range(2 * r + 1))
    return out


def _shifts(mask: np.ndarray, r: int, fill: bool) -> np.ndarray:
    """Union (or intersection) over a square of radius r, one axis after the other."""
    out = mask
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(2)], constant_values=not fill)
        n = out.shape[axis]
        parts = [padded[i : i + n] if axis == 0 else padded[:, i : i + n] for i in range(2 * r + 1)]
        out = np.logical_or.reduce(parts) if fill else np.logical_and.reduce(parts)
    return out


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    padded = np.pad(mask, r)
    return _shifts(padded, r, True)[r : r + mask.shape[0], r : r + mask.shape[1]]


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    return _shifts(mask, r, False)


def close_gaps(mask: np.ndarray, r: int) -> np.ndarray:
    padded = np.pad(mask, r)
    return erode(_shifts(padded, r, True), r)[r : r + mask.shape[0], r : r + mask.shape[1]]


def otsu(values: np.ndarray) -> int:
    """The threshold of the greatest between-class variance."""
    n = np.bincount(np.clip(values, 0, 255).astype(np.int64).ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def strokes(shape: tuple[int, int], points: np.ndarray, width: float | np.ndarray) -> tuple[np.ndarray, tuple[slice, slice]]:
    """Cover (0..1) of a polyline of (x, y) points, smooth at its rim, on its bounding box."""
    h, w = shape
    width = np.broadcast_to(np.asarray(width, float), len(points))
    pad = float(width.max()) / 2 + 1.5
    x0, y0 = np.maximum(0, np.floor(points.min(0) - pad)).astype(int)
    x1, y1 = np.minimum([w, h], np.ceil(points.max(0) + pad) + 1).astype(int)
    box = (slice(y0, max(y0, y1)), slice(x0, max(x0, x1)))
    cover = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), np.float32)
    for (ax, ay), (bx, by), t in zip(points[:-1], points[1:], width[1:], strict=True):
        r = t / 2 + 1.5
        left, top = int(max(x0, np.floor(min(ax, bx) - r))), int(max(y0, np.floor(min(ay, by) - r)))
        right, low = int(min(x1, np.ceil(max(ax, bx) + r) + 1)), int(min(y1, np.ceil(max(ay, by) + r) + 1))
        if right <= left or low <= top:
            continue
        yy, xx = np.ogrid[top:low, left:right]
        dx, dy = bx - ax, by - ay
        u = np.clip(((xx - ax) * dx + (yy - ay) * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
        d = np.hypot(xx - ax - u * dx, yy - ay - u * dy)
        part = cover[top - y0 : low - y0, left - x0 : right - x0]
        np.maximum(part, np.clip(t / 2 + 0.5 - d, 0, 1), out=part)
    return cover, box


def to_hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0..6), saturation (0..1) and value (0..255)."""
    b, g, r = np.moveaxis(bgr.astype(np.float32), -1, 0)
    v = np.maximum(np.maximum(b, g), r)
    c = v - np.minimum(np.minimum(b, g), r)
    safe = np.where(c > 0, c, 1)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    return np.where(c > 0, hue % 6, 0), np.where(v > 0, c / np.where(v > 0, v, 1), 0), v


def from_hsv(hue: np.ndarray, sat: np.ndarray, value: np.ndarray) -> np.ndarray:
    c = value * sat

    def channel(n: int) -> np.ndarray:
        k = (n + hue) % 6
        return value - c * np.clip(np.minimum(k, 4 - k), 0, 1)

    return np.stack([channel(1), channel(3), channel(5)], -1)


def warp(image: np.ndarray, inverse: np.ndarray, smooth: bool) -> np.ndarray:
    """Values at inverse @ (x, y, 1): smooth with mirrored borders, or nearest with zeros outside."""
    h, w = image.shape[:2]
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float32)
    sx = inverse[0, 0] * xx + inverse[0, 1] * yy + inverse[0, 2]
    sy = inverse[1, 0] * xx + inverse[1, 1] * yy + inverse[1, 2]
    if not smooth:
        ix, iy = np.rint(sx).astype(int), np.rint(sy).astype(int)
        ok = (ix >= 0) & (ix < w) & (iy >= 0) & (iy < h)
        out = image[np.clip(iy, 0, h - 1), np.clip(ix, 0, w - 1)]
        return np.where(ok if image.ndim == 2 else ok[..., None], out, 0)

    def mirror(k: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return np.zeros_like(k)
        k = np.abs(k) % (2 * n - 2)
        return np.where(k >= n, 2 * n - 2 - k, k)

    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    ax, ay = (sx - fx)[..., None], (sy - fy)[..., None]
    x0, x1, y0, y1 = mirror(fx, w), mirror(fx + 1, w), mirror(fy, h), mirror(fy + 1, h)
    top = image[y0, x0] * (1 - ax) + image[y0, x1] * ax
    low = image[y1, x0] * (1 - ax) + image[y1, x1] * ax
    return top * (1 - ay) + low * ay


def enlarge(small: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear enlargement of a coarse field."""
    n, m = small.shape
    y, x = np.linspace(0, n - 1, h), np.linspace(0, m - 1, w)
    rows = np.stack([np.interp(x, np.arange(m), r) for r in small])
    i = np.minimum(y.astype(int), max(0, n - 2))
    f = (y - i)[:, None]
    return rows[i] * (1 - f) + rows[np.minimum(i + 1, n - 1)] * f


def byte(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """PNG of a BGR or gray image."""
    h, w = image.shape[:2]
    rows = image if image.ndim == 2 else image[..., ::-1]
    raw = np.zeros((h, 1 + rows.size // h), np.uint8)
    raw[:, 1:] = rows.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")
