"""Defect generators and randomisers: pure functions of pixels, a random stream and settings.

A generator takes (image, rng, severity, frequency) and returns the changed image and the boolean
mask of what it changed; both have the size of the input, and the mask is not empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import raster
from .contours import region_areas

Generator = Callable[[np.ndarray, np.random.Generator, float, float], tuple[np.ndarray, np.ndarray]]
_REGISTRY: dict[str, Generator] = {}


def register(name: str) -> Callable[[Generator], Generator]:
    """Adds a generator; a later one of the same name replaces it."""

    def add(f: Generator) -> Generator:
        _REGISTRY[name] = f
        return f

    return add


def available() -> list[str]:
    return sorted(_REGISTRY)


def generator(name: str) -> Generator:
    if name not in _REGISTRY:
        raise KeyError(f"no generator {name!r}; there are {', '.join(available())}")
    return _REGISTRY[name]


def _blend(image: np.ndarray, box: tuple[slice, slice], alpha: np.ndarray, colour: np.ndarray | float) -> None:
    part = image[box]
    image[box] = raster.byte(part * (1 - alpha[..., None]) + alpha[..., None] * colour)


def _sure(mask: np.ndarray, image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A mask with at least one pixel, darkened in the image if it has to be made."""
    if not mask.any():
        y, x = rng.integers(mask.shape[0]), rng.integers(mask.shape[1])
        mask[y, x] = True
        image[y, x] = image[y, x] // 2
    return mask


@register("scratch")
def scratch(image, rng, severity, frequency):
    """Thin dark bent lines."""
    out, (h, w) = image.copy(), image.shape[:2]
    mask = np.zeros((h, w), bool)
    for _ in range(max(1, round(frequency))):
        n = int(rng.integers(2, max(3, int(5 * severity) + 1)))
        angle, length = rng.uniform(0, np.pi), rng.uniform(0.2, 0.4 + 0.5 * severity) * min(h, w)
        centre = rng.uniform([0.2 * w, 0.2 * h], [0.8 * w, 0.8 * h])
        along = np.linspace(-0.5, 0.5, n)[:, None] * length * np.array([np.cos(angle), np.sin(angle)])
        bend = rng.normal(0, 0.06 * length, (n, 2))
        t = np.linspace(0, n - 1, 24)
        points = np.column_stack([np.interp(t, np.arange(n), (centre + along + bend)[:, k]) for k in (0, 1)])
        cover, box = raster.strokes((h, w), points, 1 + int(4 * severity) * rng.uniform(0.6, 1))
        alpha = raster.blur(cover, 0.6) * np.clip(0.3 + 0.6 * severity, 0.3, 0.9)
        _blend(out, box, alpha, image[box] * 0.25)
        mask[box] |= cover > 0.5
    return out, _sure(mask, out, rng)


@register("stain")
def stain(image, rng, severity, frequency):
    """Blotches with a ragged rim and a brown tint."""
    out, (h, w) = image.copy(), image.shape[:2]
    mask = np.zeros((h, w), bool)
    for _ in range(max(1, int(rng.integers(1, 3) * frequency))):
        r = rng.uniform(0.06, 0.1 + 0.15 * severity) * min(h, w)
        cx, cy = rng.uniform(0.15, 0.85) * w, rng.uniform(0.15, 0.85) * h
        k = int(1.6 * r) + 3
        y0, y1, x0, x1 = max(0, int(cy) - k), min(h, int(cy) + k + 1), max(0, int(cx) - k), min(w, int(cx) + k + 1)
        yy, xx = np.ogrid[y0:y1, x0:x1]
        theta = np.arctan2(yy - cy, xx - cx)
        rim = 1 + sum(rng.uniform(0, 0.25 / m) * np.cos(m * theta + rng.uniform(0, 6.28)) for m in (2, 3, 5, 7))
        soft = np.clip((r * rim - np.hypot(yy - cy, xx - cx)) / max(1.5, 0.25 * r) + 0.5, 0, 1)
        noise = raster.enlarge(rng.random((6, 6)), y1 - y0, x1 - x0)
        alpha = (soft * (0.55 + 0.45 * noise) * (0.35 + 0.5 * severity)).astype(np.float32)
        colour = np.array([40, 70, 105]) * rng.uniform(0.7, 1.2)
        _blend(out, (slice(y0, y1), slice(x0, x1)), alpha, colour)
        mask[y0:y1, x0:x1] |= alpha > 0.15
    return out, _sure(mask, out, rng)


@register("discoloration")
def discoloration(image, rng, severity, frequency):
    """A soft ellipse of another hue and more saturation."""
    out, (h, w) = image.copy(), image.shape[:2]
    a, b = rng.uniform(0.1, 0.15 + 0.2 * severity, 2) * min(h, w)
    cx, cy, turn = rng.uniform(0.2, 0.8) * w, rng.uniform(0.2, 0.8) * h, rng.uniform(0, np.pi)
    k = int(max(a, b) * 1.3) + 2
    y0, y1, x0, x1 = max(0, int(cy) - k), min(h, int(cy) + k + 1), max(0, int(cx) - k), min(w, int(cx) + k + 1)
    yy, xx = np.ogrid[y0:y1, x0:x1]
    u = ((xx - cx) * np.cos(turn) + (yy - cy) * np.sin(turn)) / a
    v = (-(xx - cx) * np.sin(turn) + (yy - cy) * np.cos(turn)) / b
    soft = np.clip((1 - np.hypot(u, v)) * 4 + 0.5, 0, 1)[..., None]
    hue, sat, value = raster.to_hsv(image[y0:y1, x0:x1])
    hue = (hue + rng.choice([-1.0, 0.85, 1.5, -0.5])) % 6
    sat = np.clip(np.maximum(sat, 0.15) * (1 + 0.6 * severity), 0, 1)
    part = image[y0:y1, x0:x1]
    out[y0:y1, x0:x1] = raster.byte(part * (1 - soft) + soft * raster.from_hsv(hue, sat, value * (1 - 0.15 * severity)))
    mask = np.zeros((h, w), bool)
    mask[y0:y1, x0:x1] = soft[..., 0] > 0.5
    return out, _sure(mask, out, rng)


@register("crack")
def crack(image, rng, severity, frequency):
    """Random walks with branches, dark, with a light halo when severe."""
    out, (h, w) = image.copy(), image.shape[:2]
    mask, step = np.zeros((h, w), bool), min(h, w) / 60
    for _ in range(max(1, round(frequency))):
        edge = rng.random() < 0.6
        at = np.array([rng.uniform(0, w), rng.choice([1.0, h - 2.0])]) if edge else rng.uniform([0.2 * w, 0.2 * h], [0.8 * w, 0.8 * h])
        aim = np.array([w / 2, h / 2]) - at
        heading = np.arctan2(aim[1], aim[0]) + rng.normal(0, 0.4) if edge else rng.uniform(0, 2 * np.pi)
        walks = [(at, heading, int(rng.integers(15, int(25 + 40 * severity) + 1)), 1 + 1.5 * severity)]
        while walks:
            at, heading, n, width = walks.pop()
            turns = heading + np.cumsum(rng.normal(0, 0.35, n))
            points = np.vstack([at, at + np.cumsum(np.column_stack([np.cos(turns), np.sin(turns)]) * step, 0)])
            cover, box = raster.strokes((h, w), points, np.linspace(width, max(0.8, width * 0.5), len(points)))
            if not cover.size:
                continue
            if severity > 0.4:
                halo = np.clip(raster.blur(cover, 1.5) * 1.5, 0, 1) * (1 - cover) * 0.15
                _blend(out, box, halo, 235.0)
            _blend(out, box, cover * (0.5 + 0.4 * severity), 20.0)
            mask[box] |= cover > 0.5
            if width > 1 and n > 10:
                for k in rng.integers(4, n, int(rng.integers(0, 2 + int(3 * severity)))):
                    walks.append((points[k], turns[k - 1] + rng.choice([-1, 1]) * rng.uniform(0.4, 1.0), max(4, n // 3), width * 0.6))
    return out, _sure(mask, out, rng)


@register("pinhole")
def pinhole(image, rng, severity, frequency):
    """Small dark pits with a bright rim, mostly in a cluster."""
    out, (h, w) = image.copy(), image.shape[:2]
    mask, centre = np.zeros((h, w), bool), rng.uniform([0.25 * w, 0.25 * h], [0.75 * w, 0.75 * h])
    for _ in range(max(1, round(rng.integers(3, 9) * frequency))):
        x, y = centre + rng.normal(0, 0.08 * min(h, w), 2) if rng.random() < 0.65 else rng.uniform([0, 0], [w, h])
        x, y, r = float(np.clip(x, 2, w - 3)), float(np.clip(y, 2, h - 3)), rng.uniform(1.0, 1.5 + 3 * severity)
        k = int(r * 1.6) + 3
        y0, y1, x0, x1 = max(0, int(y) - k), min(h, int(y) + k + 1), max(0, int(x) - k), min(w, int(x) + k + 1)
        yy, xx = np.ogrid[y0:y1, x0:x1]
        d, box = np.hypot(yy - y, xx - x), (slice(y0, y1), slice(x0, x1))
        _blend(out, box, np.clip(1 - np.abs(d - r * 1.25) / max(0.8, 0.4 * r), 0, 1) * 0.35 * severity, 240.0)
        _blend(out, box, np.clip(r + 0.5 - d, 0, 1) * (0.6 + 0.35 * severity), 15.0)
        mask[box] |= d <= r
    return out, _sure(mask, out, rng)


@register("dent")
def dent(image, rng, severity, frequency):
    """Shallow elliptic hollows shaded from one side."""
    out, (h, w) = image.copy(), image.shape[:2]
    mask = np.zeros((h, w), bool)
    for _ in range(max(1, round(frequency))):
        a, b = rng.uniform(0.08, 0.12 + 0.18 * severity, 2) * min(h, w)
        cx, cy, turn, light = rng.uniform(0.2, 0.8) * w, rng.uniform(0.2, 0.8) * h, rng.uniform(0, np.pi), rng.uniform(0, 2 * np.pi)
        k = int(max(a, b)) + 2
        y0, y1, x0, x1 = max(0, int(cy) - k), min(h, int(cy) + k + 1), max(0, int(cx) - k), min(w, int(cx) + k + 1)
        yy, xx = np.ogrid[y0:y1, x0:x1]
        u = ((xx - cx) * np.cos(turn) + (yy - cy) * np.sin(turn)) / a
        v = (-(xx - cx) * np.sin(turn) + (yy - cy) * np.cos(turn)) / b
        d = u * u + v * v
        depth = np.clip(1 - d, 0, None) ** 1.5
        side = (u * np.cos(light) + v * np.sin(light)) * depth
        shade = side * (60 + 90 * severity) - depth * (12 + 18 * severity)
        out[y0:y1, x0:x1] = raster.byte(out[y0:y1, x0:x1] + shade[..., None])
        mask[y0:y1, x0:x1] |= d < 0.85
    return out, _sure(mask, out, rng)


def vary(clean, image, masks, rng, amount):
    """Grows or shrinks the masks, then shifts hue, light and opacity inside them only.

    It works on the instance masks, from which the union is taken, so the two cannot drift apart.
    """
    if amount <= 0:
        return image, masks
    grow = rng.random() < 0.5
    changed = []
    for m in masks:
        new = raster.dilate(m, 1) if grow else raster.erode(m, 1)
        changed.append(new if new.any() else m)
    union = np.logical_or.reduce(changed)
    ys, xs = np.nonzero(union)
    if not len(ys):
        return image, changed
    box = (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
    hue, sat, value = raster.to_hsv(image[box])
    jitter = rng.normal(0, amount, 3)
    tinted = raster.from_hsv((hue + 0.3 * jitter[0]) % 6, np.clip(sat * (1 + 0.2 * jitter[1]), 0, 1), np.clip(value * (1 + 0.1 * jitter[2]), 0, 255))
    opacity = np.clip(1 - amount * 0.4 * rng.random(tinted.shape[:2]), 0, 1)[..., None]
    mixed = tinted * opacity + clean[box] * (1 - opacity)
    out = image.copy()
    out[box] = np.where(union[box][..., None], raster.byte(mixed), image[box])
    outside = np.logical_or.reduce(masks) & ~union
    out[outside] = clean[outside]
    return out, changed


def move(image, masks, rng, amount):
    """One rotation, scale and shift for the image and all masks."""
    if amount <= 0:
        return image, masks
    h, w = image.shape[:2]
    angle, scale = np.deg2rad(rng.uniform(-15, 15) * amount), 1 + rng.uniform(-0.1, 0.1) * amount
    shift = rng.uniform(-0.05, 0.05, 2) * amount * [w, h]
    c, s = np.cos(angle) / scale, np.sin(angle) / scale
    cx, cy = (w - 1) / 2, (h - 1) / 2
    inverse = np.array([[c, s, cx - c * (cx + shift[0]) - s * (cy + shift[1])], [-s, c, cy + s * (cx + shift[0]) - c * (cy + shift[1])]])
    return raster.byte(raster.warp(image, inverse, True)), [raster.warp(m, inverse, False).astype(bool) for m in masks]


def light(image, rng, amount):
    """A gradient of light across the image, half the time with darker corners."""
    if amount <= 0:
        return image
    h, w = image.shape[:2]
    angle = rng.uniform(0, 2 * np.pi)
    yy, xx = np.ogrid[0:h, 0:w]
    ramp = ((xx / max(1, w - 1) - 0.5) * np.cos(angle) + (yy / max(1, h - 1) - 0.5) * np.sin(angle)) * 2 * 40 * amount
    out = image + ramp[..., None].astype(np.float32)
    if rng.random() < 0.5:
        d = np.hypot(xx / max(1, w - 1) - 0.5, yy / max(1, h - 1) - 0.5)
        out = out * (1 - 0.5 * amount * np.clip(d / 0.7071, 0, 1) ** 2)[..., None].astype(np.float32)
    return raster.byte(out)


def grain(image, rng, amount):
    """Fine Gaussian noise and a coarse uneven field."""
    if amount <= 0:
        return image
    h, w = image.shape[:2]
    fine = rng.standard_normal((h, w), np.float32) * np.float32(8 * amount)
    coarse = raster.enlarge(rng.uniform(-6, 6, (8, 8)) * amount, h, w).astype(np.float32)
    return raster.byte(image + (fine + coarse)[..., None])


def sense(image, rng, amount):
    """Sensor effects: noise; with more, a colour shift between channels; with much, motion blur."""
    if amount <= 0:
        return image
    if image.ndim != 3 or image.shape[2] != 3:
        raise ValueError("sensor effects need three channels")
    out = image.astype(np.float32)
    noise = rng.standard_normal(out.shape, np.float32)
    out += noise * (np.float32(3 * amount) + np.sqrt(out) * np.float32(0.4 * amount))
    if amount > 0.25:
        out[..., 0] = np.roll(out[..., 0], 1, 1)
        out[..., 2] = np.roll(out[..., 2], -1, 1)
    if amount > 0.5:
        n = 2 + int(4 * amount)
        padded = np.pad(out, ((0, 0), (n // 2, n - 1 - n // 2), (0, 0)), mode="edge")
        out = sum(padded[:, k : k + out.shape[1]] for k in range(n)) / n
    return raster.byte(out)


def region_of_interest(image: np.ndarray) -> np.ndarray:
    """The object: brighter or darker than the corners, gaps closed, parts of 5 % or more, filled.

    An image without such a part is its own region.
    """
    h, w = image.shape[:2]
    g = raster.blur(raster.gray(image), 2.0)
    whole = np.ones((h, w), bool)
    if float(g.max() - g.min()) < 8:
        return whole
    mask = g > raster.otsu(g)
    k = max(1, min(h, w) // 10)
    corners = np.mean([mask[:k, :k].mean(), mask[:k, -k:].mean(), mask[-k:, :k].mean(), mask[-k:, -k:].mean()])
    centre = mask[h // 4 : h - h // 4, w // 4 : w - w // 4].mean()
    if corners > centre:
        mask = ~mask
    mask = raster.close_gaps(raster.close_gaps(mask, 3), 3)
    label, areas = region_areas(mask)
    big = np.flatnonzero(areas >= 0.05 * h * w)
    mask = np.isin(label, big[big > 0])
    if not mask.any():
        return whole
    outside, holes = region_areas(np.pad(~mask, 1, constant_values=True))
    return outside[1:-1, 1:-1] != outside[0, 0] if len(holes) else mask


def randomise(clean, image, masks, rng, config):
    """All randomisers in order; each is an identity at zero."""
    image, masks = vary(clean, image, masks, rng, config.variability)
    image, masks = move(image, masks, rng, config.geometry)
    return sense(grain(light(image, rng, config.lighting), rng, config.texture), rng, config.sensor), masks
