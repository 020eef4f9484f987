"""Normal maps of sprite sheets: generators by shape or brightness, layers combined in order, rims cleaned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.floods import FOUR, grassfire
from ..functions.pixelmath import SOLID, box_mean, shifted, stored, to_byte

#: Height along the way in from the rim, 0..1, by curve.
CURVES = {
    "round": lambda t: np.sqrt(np.maximum(1.0 - (1.0 - t) ** 2, 0.0)),
    "soft": lambda t: t * t * (3.0 - 2.0 * t),
    "straight": lambda t: t,
    "hollow": lambda t: t * t,
}
FLAT = (128, 128, 255)


def _packed(v):
    return to_byte(v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 0.001) * 0.5 + 0.5)


def _slopes(dx, dy, green_down):
    return _packed(np.stack([-dx, -dy if green_down else dy, np.ones_like(dx)], -1))


def from_shape(sprite, roll_off=8, curve="round", strength=0.5, tolerance=None, green_down=False):
    """Heights rise from the outline (and, with a tolerance, from edges of colour) over roll_off pixels."""
    inner = np.pad(sprite, ((1, 1), (1, 1), (0, 0)))
    solid = inner[..., 3] / 255.0 >= SOLID
    h, w = solid.shape
    seeds = np.flatnonzero(~solid)
    if tolerance is not None:
        rgb, part = inner[..., :3].astype(np.float64), np.zeros_like(solid)
        for dy, dx in FOUR:
            gap = np.abs(rgb - shifted(rgb, dy, dx, 0.0)).max(-1) / 255.0
            part |= solid & shifted(solid, dy, dx, False) & (gap > tolerance)
        seeds = np.concatenate([seeds, np.flatnonzero(part)])
    near = grassfire(seeds, h, w, roll_off)
    y, x = np.divmod(np.arange(h * w), w)
    sy, sx = np.divmod(np.maximum(near, 0), w)
    away = np.where(near >= 0, np.sqrt((x - sx) ** 2.0 + (y - sy) ** 2.0), float(roll_off))
    high = stored(np.where(solid.ravel(), strength * roll_off * CURVES[curve](np.clip(away / roll_off, 0, 1)), 0.0)).reshape(h, w)
    smooth = box_mean(high, 1)
    dx, dy = ((shifted(smooth, *a, 0.0) - shifted(smooth, *b, 0.0)) * 0.5 for a, b in (((0, 1), (0, -1)), ((1, 0), (-1, 0))))
    return _slopes(dx, dy, green_down)[1:-1, 1:-1]


def from_brightness(sprite, coarse=4.0, size=6, fine=3.0, green_down=False):
    """Slopes of brightness at two scales, added; pixels that are not solid take the mean of those that are."""
    solid = sprite[..., 3] / 255.0 >= SOLID
    brightness = lambda rgb: (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]) / 255.0
    level = brightness(sprite[..., :3].astype(np.float64))
    if not solid.any():
        return np.broadcast_to(np.array(FLAT, np.uint8), sprite[..., :3].shape)
    light = np.pad(stored(np.where(solid, level, brightness(sprite[solid, :3].sum(0) / solid.sum()))), 1, mode="edge")
    dx, dy = np.zeros_like(light), np.zeros_like(light)
    for strength, field in ((fine, light), (coarse, box_mean(light, max(size, 1)) if coarse > 0 else None)):
        if strength > 0:
            at = lambda a, b, f=field: shifted(f, a, b, 0.0)
            dx += strength * (3.0 * (at(-1, 1) - at(-1, -1)) + 10.0 * (at(0, 1) - at(0, -1)) + 3.0 * (at(1, 1) - at(1, -1))) / 32.0
            dy += strength * (3.0 * (at(1, -1) - at(-1, -1)) + 10.0 * (at(1, 0) - at(-1, 0)) + 3.0 * (at(1, 1) - at(-1, 1))) / 32.0
    return _slopes(dx, dy, green_down)[1:-1, 1:-1]


def _unpacked(n):
    v = n / 255.0 * 2.0 - 1.0
    v[..., 2] = np.maximum(v[..., 2], 0.001)
    return v


def combined(base, detail, mode="slope", opacity=1.0):
    b, d = _unpacked(base), _unpacked(detail)
    slope = d[..., :2] / d[..., 2:] * opacity
    if mode != "reoriented":
        return _packed(np.concatenate([b[..., :2] / b[..., 2:] + slope, np.ones_like(b[..., :1])], -1))
    u = np.concatenate([-slope, np.ones_like(slope[..., :1])], -1)
    u /= np.sqrt((slope**2).sum(-1, keepdims=True) + 1.0)
    t = b + np.array([0.0, 0.0, 1.0])
    return _packed(t * ((t * u).sum(-1, keepdims=True) / t[..., 2:]) - u)


def cleaned(normal, alpha, reach=1):
    """The rim, within reach of the outside, takes the normals just inside it."""
    solid = np.pad(alpha / 255.0 >= SOLID, 1)
    h, w = solid.shape
    rim = (grassfire(np.flatnonzero(~solid), h, w, max(reach, 1)) >= 0).reshape(h, w)
    inside = np.flatnonzero(solid & ~rim)
    if not len(inside):
        return normal
    near = grassfire(inside, h, w, 2 * max(reach, 1)).reshape(h, w)
    take = (solid & rim & (near >= 0))[1:-1, 1:-1]
    y, x = np.divmod(np.maximum(near, w + 1), w)
    out = normal.copy()
    out[take] = normal[(y - 1)[1:-1, 1:-1][take], (x - 1)[1:-1, 1:-1][take]]
    return out


def layer(sprite, spec, model=None):
    s = {k: v for k, v in spec.items() if k not in ("kind", "combine", "opacity")}
    kind = spec["kind"]
    if kind == "round_edges":
        return from_shape(sprite, **s)
    if kind == "color_regions":
        return from_shape(sprite, **({"tolerance": 0.15} | s))
    if kind == "brightness":
        return from_brightness(sprite, **s)
    if kind == "neural":  # a model maps (h, w, 4) bytes to (h, w, 3) bytes; without one the map is flat
        return np.broadcast_to(np.array(FLAT, np.uint8), sprite[..., :3].shape) if model is None else self_combined(model(sprite), s.get("strength", 1.0))
    raise ValueError(f"no normal layer {kind!r}")


def self_combined(normal, strength):
    """A map made stronger by its own slopes: strength 1 leaves it."""
    return normal if strength <= 1 else combined(normal, normal, "slope", strength - 1.0)


def normal_map(sprite, layers, clean=True, flip_green=False, model=None):
    """(h, w, 4) bytes: layers in order, the first one's way of combining ignored; alpha is the sprite's."""
    out = None
    for spec in layers:
        own = layer(sprite, spec, model)
        out = own if out is None else combined(out, own, spec.get("combine", "slope"), spec.get("opacity", 1.0))
    out = np.broadcast_to(np.array(FLAT, np.uint8), sprite[..., :3].shape) if out is None else out
    out = np.where((sprite[..., 3] > 0)[..., None], out, np.array(FLAT, np.uint8))
    out = cleaned(out, sprite[..., 3]) if clean else out
    if flip_green:
        out = np.stack([out[..., 0], 255 - out[..., 1], out[..., 2]], -1)
    return np.concatenate([out, sprite[..., 3:]], -1).astype(np.uint8)


def normal_maps(images: DataFrame, layers: list[dict], clean: bool = True, flip_green: bool = False, model=None) -> DataFrame:
    """(image_id, width, height, data): the normal map of each packed image, taken as one sprite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                w, h, data = (batch.column(c)[i].as_py() for c in ("width", "height", "data"))
                out.append(
                    None if data is None or len(data) != 4 * w * h
                    else normal_map(np.frombuffer(data, np.uint8).reshape(h, w, 4), layers, clean, flip_green, model).tobytes()
                )
            yield pa.record_batch(
                [batch.column("image_id"), batch.column("width"), batch.column("height"), pa.array(out, pa.binary())],
                names=["image_id", "width", "height", "data"]
            )

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, width int, height int, data binary")
