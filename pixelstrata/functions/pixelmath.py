"""Numeric rules of the raster kernels: doubles in between, float32 where a buffer is stored, bytes by round half up."""

from __future__ import annotations

import numpy as np

UNIT = 1.0 / 255.0
GUARD = 1e-4  # least divisor of ratios
SOLID = 0.5


def half_up(x):
    """floor(x + 0.5), mirrored below zero."""
    return np.where(x >= 0, np.floor(x + 0.5), -np.floor(-x + 0.5))


def to_byte(x):
    return half_up(np.clip(x, 0.0, 1.0) * 255.0).astype(np.uint8)


def stored(x):
    """What a float32 buffer keeps of x, as doubles."""
    return np.asarray(x, np.float64).astype(np.float32).astype(np.float64)


def mix(a, b, w):
    return a + (b - a) * w


def chebyshev(rgb, colour):
    """Largest difference of a channel, for rgb of shape (..., 3) in 0..1."""
    return np.abs(rgb - np.asarray(colour)).max(-1)


def box_mean(x, radius):
    """Mean over the (2 radius + 1) square, cut at the borders, stored as float32."""
    h, w = x.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = np.cumsum(np.cumsum(x, 1), 0)
    top, bottom = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius, h - 1) + 1
    left, right = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius, w - 1) + 1
    total = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    return stored(total / ((bottom - top)[:, None] * (right - left)))


def shifted(x, dy, dx, outside):
    """x at (y + dy, x + dx); `outside` beyond the border."""
    h, w = x.shape[:2]
    out = np.full_like(x, outside)
    ys, xs = slice(max(-dy, 0), h - max(dy, 0)), slice(max(-dx, 0), w - max(dx, 0))
    yd, xd = slice(max(dy, 0), h - max(-dy, 0)), slice(max(dx, 0), w - max(-dx, 0))
    if abs(dy) < h and abs(dx) < w:
        out[ys, xs] = x[yd, xd]
    return out


def rgb_to_hsv(rgb):
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    high, low = rgb.max(-1), rgb.min(-1)
    span = high - low
    safe = np.where(span > 0, span, 1.0)
    sector = np.where(high == r, (g - b) / safe, np.where(high == g, 2.0 + (b - r) / safe, 4.0 + (r - g) / safe)) / 6.0
    hue = np.where(span > 0, np.where(sector < 0, sector + 1.0, sector), 0.0)
    return hue, np.where(high > 0, span / np.where(high > 0, high, 1.0), 0.0), high


#: For each sixth of the hue circle, which of (top, rising, falling, bottom) each channel takes.
SECTORS = np.array([[0, 1, 3], [2, 0, 3], [3, 0, 1], [3, 2, 0], [1, 3, 0], [0, 3, 2]])


def _by_sector(hue, top, rising, falling, bottom):
    step = np.floor(hue * 6.0).astype(np.int64) % 6
    levels = np.stack(np.broadcast_arrays(top, rising, falling, bottom), -1)
    return np.take_along_axis(levels, SECTORS[step], -1)


def hsv_to_rgb(hue, sat, val):
    along = hue * 6.0 - np.floor(hue * 6.0)
    out = _by_sector(hue, val, val * (1.0 - sat * (1.0 - along)), val * (1.0 - sat * along), val * (1.0 - sat))
    return np.where((sat <= 0)[..., None], np.asarray(val)[..., None], out)


def hsl_to_rgb(hue, sat, light):
    chroma = (1.0 - np.abs(2.0 * light - 1.0)) * sat
    along = hue * 6.0 - np.floor(hue * 6.0)
    out = _by_sector(np.broadcast_to(hue, light.shape), chroma, chroma * along, chroma * (1.0 - along), 0.0 * chroma) + (light - chroma * 0.5)[..., None]
    return np.where((chroma <= 0)[..., None], light[..., None], out)


def shift_colours(rgb, turn, sat_scale, val_scale, tint):
    """The HSV adjustment of colours in 0..1: hue turned, saturation and value scaled, then mixed with an HSL tint."""
    hue, sat, val = rgb_to_hsv(rgb)
    hue = hue + turn
    out = hsv_to_rgb(hue - np.floor(hue), np.clip(sat * sat_scale, 0.0, 1.0), np.clip(val * val_scale, 0.0, 1.0))
    tint = np.clip(tint, 0.0, 1.0)
    light = np.clip((rgb.max(-1) + rgb.min(-1)) * 0.5 * val_scale, 0.0, 1.0)
    tinted = hsl_to_rgb(np.asarray(turn - np.floor(turn), np.float64), np.clip(sat_scale, 0.0, 1.0), light)
    return mix(out, tinted, np.asarray(tint)[..., None]) if np.any(tint > 0) else out


def splitmix(x):
    """The 64-bit mixing step, on wrapping unsigned numbers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit_draw(x):
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
