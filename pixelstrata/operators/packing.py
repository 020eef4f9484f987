"""Objects of images: boxes, cut-outs, stray pixels, and placing sprites on sheets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.floods import boxes, islands
from .batch import bounded_padding, sheet_sizes


def _labelled(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            image, w, h, data = (batch.column(c)[i].as_py() for c in ("image_id", "width", "height", "data"))
            if data is None or len(data) != 4 * w * h:
                continue
            pixels = np.frombuffer(data, np.uint8).reshape(-1, 4)
            alpha = pixels[:, 3] / 255.0
            yield image, w, h, pixels, alpha, islands(alpha, h, w)


def objects(images: DataFrame) -> DataFrame:
    """(image_id, label, x, y, w, h, area, stray): every object, and the image's visible pixels that belong to none."""

    def run(batches):
        for image, w, _, _, alpha, label in _labelled(batches):
            found, stray = boxes(label, w), int(((label < 0) & (alpha > 0)).sum())
            area = np.bincount(label[label >= 0], alpha[label >= 0], len(found))
            rows = [(image, n, b[0], b[1], b[2] - b[0] + 1, b[3] - b[1] + 1, float(area[n]), stray) for n, b in enumerate(found.tolist())]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["image_id", "label", "x", "y", "w", "h", "area", "stray"]).astype({"image_id": "int64", "label": "int32", "x": "int32", "y": "int32", "w": "int32", "h": "int32", "area": "float64", "stray": "int64"}),
                preserve_index=False
            )

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, label int, x int, y int, w int, h int, area double, stray long")


def cut_sprites(images: DataFrame) -> DataFrame:
    """(image_id, sprite_id, x, y, width, height, data): each object alone, in its box, with its visible alpha."""

    def run(batches):
        for image, w, h, pixels, _, label in _labelled(batches):
            grid, marks = pixels.reshape(h, w, 4), label.reshape(h, w)
            for n, (a, b, x, y) in enumerate(boxes(label, w).tolist()):
                part = np.where((marks[b : y + 1, a : x + 1] == n)[..., None], grid[b : y + 1, a : x + 1], 0).astype(np.uint8)
                values = (image, n, a, b, x - a + 1, y - b + 1)
                yield pa.record_batch(
                    [*(pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.int32()] * 5), strict=True)), pa.array([part.tobytes()], pa.binary())],
                    names=["image_id", "sprite_id", "x", "y", "width", "height", "data"]
                )

    return images.select("image_id", "width", "height", "data").mapInArrow(
        run, "image_id long, sprite_id int, x int, y int, width int, height int, data binary"
    )


def shelves(sizes, width, height, ordered):
    """Places by rows: tallest first (then widest, then first found) or in found order; stops at the first that does not fit."""
    places: list[tuple[int, int] | None] = [None] * len(sizes)
    x = y = row = 0
    for i in _order(sizes, ordered):
        w, h = sizes[i]
        if w > width:
            break
        if x + w > width:
            x, y, row = 0, y + row, 0
        if y + h > height:
            break
        places[i], x, row = (x, y), x + w, max(row, h)
    return places


def _order(sizes, ordered):
    """The sprites that have an area."""
    real = [i for i, (w, h) in enumerate(sizes) if w > 0 and h > 0]
    return sorted(real, key=lambda i: (-sizes[i][1], -sizes[i][0], i)) if ordered else real


def grid_cells(sizes, width, height):
    """Places in cells of the largest size, one after the other while there are any."""
    cw, ch = max((w for w, _ in sizes), default=0), max((h for _, h in sizes), default=0)
    across, down = (width // cw, height // ch) if cw > 0 and ch > 0 else (0, 0)
    places: list[tuple[int, int] | None] = [None] * len(sizes)
    for n, i in enumerate(_order(sizes, False)[: across * down]):
        places[i] = (n % across * cw, n // across * ch)
    return places


def skyline(sizes, width, height):
    """Places each sprite, tallest first, at the lowest gap of the skyline, leftmost of equals."""
    top = np.zeros(width, np.int64)
    places: list[tuple[int, int] | None] = [None] * len(sizes)
    for i in _order(sizes, True):
        w, h = sizes[i]
        if w > width:
            break
        high = np.lib.stride_tricks.sliding_window_view(top, w).max(1)
        x = int(high.argmin())
        if high[x] + h > height:
            break
        places[i] = (x, int(high[x]))
        top[x : x + w] = high[x] + h
    return places


METHODS = {
    "shelf": lambda s, w, h: shelves(s, w, h, True),
    "original": lambda s, w, h: shelves(s, w, h, False),
    "grid": grid_cells,
    "tight": skyline,
}


def place(sizes, method, width, height, padding=0, expand=True):
    """(places, width, height) on the first sheet of sheet_sizes that holds all sprites with an area, or the last one. Padding is
    kept around every sprite once: at its right and below it, and at the sheet's left and top. Sprites without an area, and
    those from the first on that does not fit, have no place."""
    padding = bounded_padding(padding)
    padded = [(w + padding, h + padding) if w > 0 and h > 0 else (w, h) for w, h in sizes]
    wanted = len(_order(sizes, False))
    for w, h in sheet_sizes(width, height, expand):
        places = METHODS[method](padded, max(w - padding, 0), max(h - padding, 0))
        if sum(p is not None for p in places) >= wanted:
            break
    return [(p[0] + padding, p[1] + padding) if p else None for p in places], w, h


def plan(sizes: DataFrame, method: str, width: int, height: int, padding: int = 0, expand: bool = True) -> DataFrame:
    """(sheet, sprite_id, x, y, w, h, placed, sheet_width, sheet_height) from (sheet, sprite_id, w, h).

    A sheet's plan is one ordered fold over its sprites' sizes, so each sheet is one group; a sheet of at most 16384 pixels a
    side bounds it, and only sizes travel, not pixels."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sprite_id", ignore_index=True)
        places, w, h = place(list(zip(group["w"].tolist(), group["h"].tolist(), strict=True)), method, width, height, padding, expand)
        out = group[["sheet", "sprite_id"]].copy()
        out["x"], out["y"] = [p[0] if p else -1 for p in places], [p[1] if p else -1 for p in places]
        return out.assign(w=group["w"], h=group["h"], placed=[p is not None for p in places], sheet_width=w, sheet_height=h)

    return sizes.groupBy("sheet").applyInPandas(
        run, "sheet long, sprite_id long, x int, y int, w int, h int, placed boolean, sheet_width int, sheet_height int"
    )


def build_sheets(cutouts: DataFrame, planned: DataFrame) -> DataFrame:
    """(image_id, width, height, data): a sheet of its sprites (sheet, sprite_id, width, height, data) at their places; a sheet
    with an unplaced sprite has null data; sprites without an area are none."""
    from pyspark.sql import functions as F

    held = cutouts.drop("x", "y").join(planned.select("sheet", "sprite_id", "x", "y", "placed", "sheet_width", "sheet_height"), ["sheet", "sprite_id"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number, w, h = (int(group[c].iloc[0]) for c in ("sheet", "sheet_width", "sheet_height"))
        out = None
        group = group[(group["width"] > 0) & (group["height"] > 0)]
        if group["placed"].all():
            sheet = np.zeros((h, w, 4), np.uint8)
            for s in group.itertuples():
                sheet[s.y : s.y + s.height, s.x : s.x + s.width] = np.frombuffer(s.data, np.uint8).reshape(s.height, s.width, 4)
            out = sheet.tobytes()
        return pd.DataFrame({"image_id": [number], "width": [w], "height": [h], "data": [out]})

    columns = ["sheet", "sprite_id", "width", "height", "data", "x", "y", "placed", "sheet_width", "sheet_height"]
    return held.select(*[F.col(c) for c in columns]).groupBy("sheet").applyInPandas(run, "image_id long, width int, height int, data binary")
