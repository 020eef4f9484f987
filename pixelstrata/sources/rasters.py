"""Raster tables: one row an image (packed: image_id, width, height, data) or one row a pixel (long: image_id, x, y, r, g, b, a),
and rasters derived from relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "image_id long, width int, height int, data binary"
LONG = "image_id long, x int, y int, r int, g int, b int, a int"


def _slots(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows, and one more row with nothing but its key for each key that is missing in an image of `size` keys."""
    image = F.floor(F.col(key) / size)
    keys = rows.select(image.alias("i")).distinct().select(F.explode(F.sequence(F.col("i") * size, F.col("i") * size + size - 1)).alias(key))
    return keys.join(rows, key, "left")


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, lum): a 64 x 64 image of every 64 vectors of embeddings; cells of missing vectors are 0."""
    v = _slots(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", 64)
    cells = v.select("vec_id", F.posexplode(F.coalesce("embedding", F.array_repeat(F.lit(-0.5).cast("float"), 64))).alias("i", "v"))
    lum = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.5) * 255.0)))
    return cells.select(
        F.expr("cast(vec_id div 64 as int)").alias("image_id"), F.expr("cast((vec_id % 8) * 8 + i % 8 as int)").alias("x"),
        F.expr("cast(((vec_id % 64) div 8) * 8 + i div 8 as int)").alias("y"), lum.cast("int").alias("lum"))


def shape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, cell, rad, pr): the 16 cells of each image of shapes, a row for every part; rad is null where a part is missing."""
    part = _slots(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 16)
    return part.selectExpr(
        "cast(p_partkey div 16 as int) image_id", "cast(p_partkey % 16 as int) cell", "2 + p_size % 6 rad", "cast(floor(p_retailprice) as int) pr")


def shape_places(spark: SparkSession) -> DataFrame:
    """(cell, x, y): the places of an image of shapes, the same in all of them."""
    places = spark.range(64 * 64, numPartitions=1).selectExpr("cast(id % 64 as int) x", "cast(id div 64 as int) y")
    return places.selectExpr("cast(y div 16 * 4 + x div 16 as int) cell", "x", "y")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b, a): 16 discs on white for every 16 parts, with one ring of half tones; cells of missing parts
    are clear."""
    cells = shape_cells(spark, sf_dir)
    grid = cells.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(255)))).selectExpr(
        "image_id", "cast((cell % 4) * 16 + g % 16 as int) x", "cast((cell div 4) * 16 + g div 16 as int) y", "rad", "pr",
        "(g % 16 - 8) * (g % 16 - 8) + (g div 16 - 8) * (g div 16 - 8) dd")
    tone = lambda c: f"cast(case when rad is null then 0 when dd <= rad * rad then {c} when dd <= (rad + 1) * (rad + 1) then ({c} + 255) div 2 else 255 end as int)"
    clear = "case when rad is null then 0 else 255 end a"
    return grid.selectExpr("image_id", "x", "y", f"{tone('pr % 200')} r", f"{tone('pr * 7 % 200')} g", f"{tone('pr * 13 % 200')} b", clear)


def packed(pixels: DataFrame) -> DataFrame:
    """Long to packed. Pixels travel as one integer each; an image's size follows from its largest coordinates."""
    code = F.expr("cast(y as bigint) * 1048576 + x").alias("at")
    value = F.expr("r + g * 256 + b * 65536 + cast(a as bigint) * 16777216").alias("v")
    held = pixels.select(F.col("image_id").cast("long"), "x", "y", F.struct(code, value).alias("p"))
    images = held.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.collect_list("p").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column("p").flatten(), np.asarray(batch.column("p").value_lengths())
            at, v = np.asarray(flat.field("at")), np.asarray(flat.field("v")).astype(np.uint32)
            w, h = np.asarray(batch.column("width")), np.asarray(batch.column("height"))
            out, lo = [], 0
            for i, n in enumerate(sizes):
                image = np.zeros(w[i] * h[i], np.uint32)
                y, x = at[lo : lo + n] >> 20, at[lo : lo + n] & 0xFFFFF
                image[y * w[i] + x] = v[lo : lo + n]
                out.append(image.tobytes())
                lo += n
            yield pa.record_batch(
                [batch.column("image_id"), batch.column("width"), batch.column("height"), pa.array(out, pa.binary())],
                names=["image_id", "width", "height", "data"]
            )

    return images.mapInArrow(run, PACKED)


def unpacked(images: DataFrame) -> DataFrame:
    """Packed to long, an image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(-1, 4).astype(np.int32)
                y, x = np.divmod(np.arange(w * h, dtype=np.int32), w)
                yield pa.record_batch(
                    [
                        pa.array(np.full(w * h, batch.column("image_id")[i].as_py(), np.int64)), pa.array(x), pa.array(y),
                        *(pa.array(np.ascontiguousarray(data[:, j])) for j in range(4))
                    ],
                    names=["image_id", "x", "y", "r", "g", "b", "a"]
                )

    return images.select("image_id", "width", "height", "data").mapInArrow(run, LONG)
