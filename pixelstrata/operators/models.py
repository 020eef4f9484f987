"""Operations that need a trained network: upscaling and remote generation. Networks are injected; what is here without one is
said to be no substitute for it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixelmath import half_up, shifted

TILE, OVERLAP = 256, 64


def sharpened(rgba: np.ndarray, amount: float) -> np.ndarray:
    """Alpha pulled away from one half."""
    amount = min(max(amount, 0.0), 1.0)
    if amount <= 0:
        return rgba
    cover = rgba[..., 3] / 255.0
    curve = (cover >= 0.5).astype(float) if amount >= 1 else np.clip((cover - 0.5) * (1.0 / (1.0 - amount)) + 0.5, 0.0, 1.0)
    return np.concatenate([rgba[..., :3], half_up(curve * 255.0)[..., None].astype(np.uint8)], -1)


def tiles(height: int, width: int, tile: int = TILE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(y, x, h, w) of overlapping tiles that cover an image."""
    at = lambda n: sorted({min(i, max(n - tile, 0)) for i in range(0, max(n - overlap, 1), tile - overlap)})
    return [(y, x, min(tile, height), min(tile, width)) for y in at(height) for x in at(width)]


def blended(parts: list[tuple[tuple[int, int, int, int], np.ndarray]], height: int, width: int) -> np.ndarray:
    """Tiles merged by weights that fall off towards their edges."""
    total, weight = None, np.zeros((height, width, 1))
    for (y, x, h, w), part in parts:
        fade = np.minimum.outer(*[np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) for n in (h, w)])[..., None].astype(float)
        total = np.zeros((height, width, part.shape[-1])) if total is None else total
        total[y : y + h, x : x + w] += part * fade
        weight[y : y + h, x : x + w] += fade
    return total / weight


def soft_denoiser(rgb: np.ndarray, quality: str) -> np.ndarray:
    """A small filter in place of a trained one: the mean of each pixel and its neighbours left, right, above and below."""
    total, count = rgb.copy(), np.ones(rgb.shape[:2])
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        there = shifted(np.ones(rgb.shape[:2]), dy, dx, 0.0)
        total += shifted(rgb, dy, dx, 0.0)
        count += there
    return total / count[..., None]


def dark_subject(rgba: np.ndarray) -> np.ndarray:
    """A small segmentation in place of a trained one: the darker the largest channel, the more of the subject."""
    return 255 - rgba[..., :3].max(-1)


def leaning_normals(rgba: np.ndarray) -> np.ndarray:
    """A small map in place of a trained network's: colours read as slopes."""
    return np.stack([rgba[..., 0] // 2 + 64, rgba[..., 1] // 2 + 64, np.full(rgba.shape[:2], 255)], -1).astype(np.uint8)


def doubled(rgba: np.ndarray) -> np.ndarray:
    """Nearest neighbour at twice the size: the stand-in where no network is given. It is not equivalent to one."""
    return np.repeat(np.repeat(rgba, 2, 0), 2, 1)


def upscaled(
    rgba: np.ndarray, scale: int, model: Callable[[np.ndarray, int], np.ndarray] | None = None, single_pass: bool = False, noise: int = -1,
    tta: bool = False
) -> np.ndarray:
    """Repeated doubling up to scale (a power of two, 1..32), or one pass of a network of that scale (2..4); tta averages the eight
    turns and mirrors of the image."""
    step = (lambda x: model(x, noise)) if model else doubled
    if tta and model:
        plain = step

        def step(x):
            return half_up(np.mean([_unturned(plain, x, k, m) for k in range(4) for m in (False, True)], 0)).astype(np.uint8)

    if single_pass:
        return step(rgba)
    while scale > 1:
        rgba, scale = step(rgba), scale // 2
    return rgba


def _unturned(step, x, k, mirrored):
    made = step(np.rot90(np.fliplr(x) if mirrored else x, k))
    back = np.rot90(made, -k)
    return np.fliplr(back).astype(float) if mirrored else back.astype(float)


def upscale(images: DataFrame, scale: int = 2, sharpen: float = 0.0, model=None, single_pass: bool = False, noise: int = -1, tta: bool = False) -> DataFrame:
    """Packed images at another size, alpha sharpened after; `exact` says whether a network made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, data = (batch.column(c)[i].as_py() for c in ("width", "height", "data"))
                if data is not None:
                    made = sharpened(upscaled(np.frombuffer(data, np.uint8).reshape(h, w, 4), scale, model, single_pass, noise, tta), sharpen)
                    h, w, data = made.shape[0], made.shape[1], np.ascontiguousarray(made).tobytes()
                yield pa.record_batch(
                    [
                        batch.column("image_id").slice(i, 1), pa.array([w], pa.int32()), pa.array([h], pa.int32()),
                        pa.array([data], pa.binary()), pa.array([model is not None])
                    ],
                    names=["image_id", "width", "height", "data", "exact"]
                )

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, width int, height int, data binary, exact boolean")


def network_signature(engine: str, model: str, noise: int, scale: int, tta: bool) -> str:
    """The key of a cached result: what the network depends on; sharpening comes after it and is left out."""
    return json.dumps([engine, model, noise, scale, tta])


def generation_graph(
    checkpoint: str, prompt: str, negative: str = "", width: int = 512, height: int = 512, seed: int = 0, steps: int = 20, cfg: float = 7.0,
    sampler: str = "euler", scheduler: str = "normal", loras: tuple[tuple[str, float], ...] = (), clip_skip: int = 1,
    prefix: str = "pixelstrata"
) -> str:
    """The node graph of an image job as JSON: checkpoint, up to two LoRAs, clip skip, prompts, sampler, decode, save. Sizes go
    down to multiples of 8. Sending it is left to a client of the service, which is not part of this library."""
    nodes: dict[str, dict] = {}

    def node(kind: str, **inputs) -> str:
        nodes[str(len(nodes) + 1)] = {"class_type": kind, "inputs": inputs}
        return str(len(nodes))

    loaded = node("CheckpointLoaderSimple", ckpt_name=checkpoint)
    model, clip, vae = [loaded, 0], [loaded, 1], [loaded, 2]
    for name, strength in loras[:2]:
        lora = node("LoraLoader", lora_name=name, strength_model=strength, strength_clip=strength, model=model, clip=clip)
        model, clip = [lora, 0], [lora, 1]
    if clip_skip > 1:
        clip = [node("CLIPSetLastLayer", stop_at_clip_layer=-clip_skip, clip=clip), 0]
    positive, against = ([node("CLIPTextEncode", text=t, clip=clip), 0] for t in (prompt, negative))
    empty = [node("EmptyLatentImage", width=max(width // 8 * 8, 8), height=max(height // 8 * 8, 8), batch_size=1), 0]
    made = [
        node(
            "KSampler", seed=seed, steps=steps, cfg=cfg, sampler_name=sampler, scheduler=scheduler, denoise=1.0, model=model,
            positive=positive, negative=against, latent_image=empty
        ),
        0
    ]
    node("SaveImage", filename_prefix=prefix, images=[node("VAEDecode", samples=made, vae=vae), 0])
    return json.dumps({"prompt": nodes})


def generation_jobs(jobs: DataFrame, checkpoint: str, **settings) -> DataFrame:
    """jobs (prompt, width, height, seed and any more columns) with the graph of each."""

    @F.pandas_udf("string")
    def graph(prompt, width, height, seed):
        rows = zip(prompt, width, height, seed, strict=True)
        return pd.Series([generation_graph(checkpoint, p, width=int(w), height=int(h), seed=int(s), **settings) for p, w, h, s in rows])

    return jobs.withColumn("graph", graph("prompt", "width", "height", "seed"))


def network_files(names: list[str], folder: str, scale: int) -> tuple[str, str] | None:
    """The two files of a network among the names in its folder: those that end in the scale, or else, where the folder's own name
    holds the scale, those named like the folder alone."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    plain = [name] if f"x{scale}" in name else []
    return next(((f"{n}.param", f"{n}.bin") for n in [f"{name}-x{scale}", *plain] if {f"{n}.param", f"{n}.bin"} <= set(names)), None)


def network_scales(names: list[str], folder: str, scales=range(2, 5)) -> list[int]:
    """The scales that a folder has networks for."""
    return [s for s in scales if network_files(names, folder, s)]


def cached_upscale(images: DataFrame, cache: DataFrame | None, signature: str, **settings) -> DataFrame:
    """(image_id, width, height, data, exact, source, signature): upscale of each image, taken from cache (rows of an earlier
    call, by the source's sha256 and the network's signature) where it is there. sharpen is left to the caller, as it is no part
    of the signature; new rows are what a caller adds to its cache."""
    keyed = images.withColumn("source", F.sha2("data", 256)).withColumn("signature", F.lit(signature))
    made = lambda rows: upscale(rows, **settings).join(rows.select("image_id", "source", "signature"), "image_id")
    if cache is None:
        return made(keyed)
    held = cache.filter(F.col("signature") == signature).select(
        "source", "signature", *(F.col(c) for c in ("width", "height", "data", "exact"))
    ).dropDuplicates(["source"])
    known = keyed.select("image_id", "source").join(held, "source").select("image_id", "width", "height", "data", "exact", "source", "signature")
    return known.unionByName(made(keyed.join(held, "source", "left_anti")))
