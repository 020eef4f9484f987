"""Streams: images that arrive as files run the same stack as a batch; edits merge into commands as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.batch import supported
from ..plans.stack import apply_stack
from ..sources.files import decoded_images


def image_stream(spark: SparkSession, folder: str, stack: list, per_trigger: int = 100) -> DataFrame:
    """A stream of processed images from the files that arrive in a folder; stateless, so it restarts from its checkpoint."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
    return apply_stack(decoded_images(files.filter(supported(F.col("path"))).select("path", "content")), stack)


def merged_edits(edits: DataFrame, gap_ms: int = 600) -> DataFrame:
    """(log, key, opened, ts, edits): from a stream or table of edits (log, ts, seq, key), the commands of batch.merged_history,
    one row each once the log's next command opened, or nothing came within gap_ms by the event-time watermark of the stream.
    The state of a log is its newest command."""

    def run(log: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((log[0], *state.get))
            state.remove()
        else:
            rows = sorted((t, s, "" if k is None else k) for b in batches for t, s, k in zip(b["us"].tolist(), b["seq"].tolist(), b["key"], strict=True))
            top = list(state.get) if state.exists else None
            for t, _, key in rows:
                if top and key and key == top[0] and t - top[2] <= gap_ms * 1000:
                    top[2], top[3] = max(t, top[2]), top[3] + 1
                    continue
                if top:
                    out.append((log[0], *top))
                top = [key, t, t, 1]
            state.update(tuple(top))
            state.setTimeoutTimestamp(max(top[2] // 1000 + gap_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["log", "key", "opened_us", "us", "edits"])

    kind = edits.schema["log"].dataType.simpleString()
    held = edits.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    merged = held.groupBy("log").applyInPandasWithState(
        run, f"log {kind}, key string, opened_us long, us long, edits long", "key string, opened long, last long, n long", "append",
        GroupStateTimeout.EventTimeTimeout
    )
    return merged.select("log", "key", F.timestamp_micros("opened_us").alias("opened"), F.timestamp_micros("us").alias("ts"), "edits")
