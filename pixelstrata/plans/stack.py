"""An ordered stack of operations as one plan over packed images: each image runs the whole stack in one task, composed once
at its end, so a batch needs no shuffle at all."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.canvas import Canvas
from ..operators.stages import STAGES

Step = tuple[str, dict]


def resolved(stack: list[Step | dict]) -> list[Step]:
    """The enabled, known operations with whole settings. Records are (id, settings) or {id, enabled, settings}."""
    records = [{"id": s[0], "settings": s[1]} if isinstance(s, tuple) else s for s in stack]
    return [(r["id"], STAGES[r["id"]].settings(r.get("settings"))) for r in records if r.get("enabled", True) and r["id"] in STAGES]


def run_stack(width: int, height: int, data: bytes, stack: list[Step]) -> Canvas:
    canvas = Canvas(width, height, data)
    for name, settings in stack:
        STAGES[name].run(canvas, settings)
    return canvas


def apply_stack(images: DataFrame, stack: list[Step | dict]) -> DataFrame:
    """(image_id, width, height, data, reports, error) for each row of packed images; reports is what operations found, as
    JSON. A row whose data is null or does not match its size keeps its data and says so in error."""
    steps = resolved(stack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, data = (batch.column(c)[i].as_py() for c in ("width", "height", "data"))
                reports, error = "[]", None
                if data is None or not w or not h or len(data) != 4 * w * h:
                    error = "no image"
                else:
                    canvas = run_stack(w, h, data, steps)
                    data, reports = np.ascontiguousarray(canvas.compose()).tobytes(), json.dumps(canvas.reports)
                yield pa.record_batch(
                    [
                        batch.column("image_id").slice(i, 1), batch.column("width").slice(i, 1), batch.column("height").slice(i, 1),
                        pa.array([data], pa.binary()), pa.array([reports]), pa.array([error], pa.string())
                    ],
                    names=["image_id", "width", "height", "data", "reports", "error"]
                )

    return images.select("image_id", "width", "height", "data").mapInArrow(
        run, "image_id long, width int, height int, data binary, reports string, error string"
    )


def output_suffix(stack: list[Step | dict]) -> str:
    """What a processed image's name ends with: the first enabled operation's suffix."""
    steps = resolved(stack)
    return STAGES[steps[0][0]].suffix if steps else "_out"
