"""Operations on long pixels as column expressions and windows: no Python runs on the executors.

Every expression keeps the numeric rules of the kernels: doubles, float32 where a buffer is stored, bytes by floor(v + 0.5).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1.0 / 255.0


def stored(x: Column) -> Column:
    return x.cast("float").cast("double")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def byte(x: Column) -> Column:
    return F.floor(clamp(x) * 255.0 + 0.5).cast("int")


def distance(colour, r="r", g="g", b="b") -> Column:
    """Largest channel difference from a colour in 0..1."""
    return F.greatest(*[F.abs(F.col(c) * UNIT - F.lit(float(k)).cast("float").cast("double")) for c, k in zip((r, g, b), colour, strict=True)])


def claiming_key(keys) -> Column:
    """The number of the first of (colour, tolerance) that claims a pixel, -1 for none."""
    far = [stored(distance(c)) if i == 0 else distance(c) for i, (c, _) in enumerate(keys)]
    out = None
    for i, (_, tolerance) in enumerate(keys):
        out = F.when(far[i] <= tolerance, i) if out is None else out.when(far[i] <= tolerance, i)
    return out.otherwise(-1)


def key_matte(pixels: DataFrame, keys) -> DataFrame:
    """The matte of pixels anywhere (not only what the border reaches), without an edge band: claimed pixels get alpha 0."""
    gone = (claiming_key(keys) >= 0) | (F.col("a") == 0)
    return pixels.withColumn("a", F.when(gone, 0).otherwise(F.col("a")))


def sharpen_alpha(pixels: DataFrame, amount: float) -> DataFrame:
    """Alpha pulled away from one half; 1 cuts it there."""
    amount = min(max(amount, 0.0), 1.0)
    if amount <= 0:
        return pixels
    cover = F.col("a") / 255.0
    curve = F.when(cover >= 0.5, 1.0).otherwise(0.0) if amount >= 1 else (cover - 0.5) * (1.0 / (1.0 - amount)) + 0.5
    return pixels.withColumn("a", byte(curve))


def posterize_even(pixels: DataFrame, levels: int) -> DataFrame:
    """Each channel of visible pixels on an even ladder of levels."""
    top = float(min(max(levels, 2), 32) - 1)
    step = lambda c: F.floor(F.floor(F.col(c) / 255.0 * top + 0.5) / top * 255.0 + 0.5).cast("int")
    return pixels.withColumns({c: F.when(F.col("a") > 0, step(c)).otherwise(F.col(c)) for c in "rgb"})


def adjust_hsv(pixels: DataFrame, regions: list[dict]) -> DataFrame:
    """HSV regions in order, each on the bytes the one before left: hue turned, saturation and value scaled."""
    for s in regions:
        x, y, w, h = s["rect"]
        turn, sat_scale, val_scale = float(s.get("hue", 0.0)), float(s.get("saturation", 1.0)), float(s.get("value", 1.0))
        r, g, b = (F.col(c) * UNIT for c in "rgb")
        high, low = F.greatest(r, g, b), F.least(r, g, b)
        span = high - low
        sector = F.when(high == r, (g - b) / span).when(high == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span) / 6.0
        hue = F.when(span <= 0, 0.0).otherwise(F.when(sector < 0, sector + 1.0).otherwise(sector)) + turn
        made = pixels.withColumns({"_h": hue - F.floor(hue), "_s": clamp(F.when(high <= 0, 0.0).otherwise(span / high) * sat_scale), "_v": clamp(high * val_scale)})
        at, v, sat = F.col("_h") * 6.0, F.col("_v"), F.col("_s")
        along, step = at - F.floor(at), F.floor(at) % 6
        low_, fall, rise = v * (1.0 - sat), v * (1.0 - sat * along), v * (1.0 - sat * (1.0 - along))
        ladder = {"r": (v, fall, low_, low_, rise, v), "g": (rise, v, v, fall, low_, low_), "b": (low_, low_, rise, v, v, fall)}
        inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
        pick = lambda cases: reduce(lambda e, i: e.when(step == i, cases[i]), range(1, 5), F.when(sat <= 0, v).when(step == 0, cases[0])).otherwise(cases[5])
        pixels = made.withColumns({c: F.when(inside, byte(pick(cases))).otherwise(F.col(c)) for c, cases in ladder.items()}).drop("_h", "_s", "_v")
    return pixels


def _rows(radius_before: int, radius_after: int):
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius_before, radius_after)
    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius_before, radius_after)
    return row, column


def box_sum(pixels: DataFrame, value: str, radius: int) -> DataFrame:
    """The sum of a column and the number of pixels in the square around each, cut at the borders: rows, then columns."""
    row, column = _rows(radius, radius)
    part = pixels.withColumns({"_sum": F.sum(value).over(row), "_n": F.count(value).over(row)})
    return part.withColumns({"box_total": F.sum("_sum").over(column), "box_count": F.sum("_n").over(column)}).drop("_sum", "_n")


def opened(pixels: DataFrame, mark: str, span: int) -> DataFrame:
    """Morphological opening of a 0/1 column by a square of `span`; what lies outside the image counts as 0."""
    lead = (span - 1) // 2
    row, column = _rows(lead, span - 1 - lead)
    full = lambda of, w: F.when(F.count(of).over(w) < span, 0).otherwise(F.min(of).over(w))
    eroded = pixels.withColumn("_e", full(mark, row)).withColumn("_e", full("_e", column))
    row, column = _rows(span - 1 - lead, lead)
    return eroded.withColumn("_e", F.max("_e").over(row)).withColumn("opened", F.max("_e").over(column)).drop("_e")


def colour_seeds(pixels: DataFrame, tolerance: float) -> DataFrame:
    """Whether a solid pixel differs from a solid neighbour (left, right, up, down) by over the tolerance."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    solid = F.col("a") / 255.0 >= 0.5
    value = F.when(solid, F.struct("r", "g", "b"))
    near = {f"_{i}": f(value).over(w) for i, (f, w) in enumerate(((F.lag, row), (F.lead, row), (F.lag, column), (F.lead, column)))}
    gap = lambda n: F.greatest(*[F.abs(F.col(c) - F.col(f"{n}.{c}")) for c in "rgb"]) / 255.0 > tolerance
    held = pixels.withColumns(near)
    return held.withColumn("seed", solid & reduce(lambda a, b: a | b, [F.coalesce(gap(n), F.lit(False)) for n in near])).drop(*near)


def inside_polygon(pixels: DataFrame, points: list[tuple[int, int]]) -> Column:
    """Even-odd test of pixel centres: an odd number of the row's crossings is to the left of the centre, or one is at it
    (both ends of a span belong to it)."""
    left, on = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        line = F.col("y") + 0.5
        at = stored(F.lit(float(ax)) + (line - float(ay)) / float(by - ay or 1) * float(bx - ax)) - 0.5
        crosses = (F.lit(ay) > line) != (F.lit(by) > line)
        left, on = left + F.when(crosses & (at < F.col("x")), 1).otherwise(0), on | (crosses & (at == F.col("x")))
    return (left % 2 == 1) | on


def colour_counts(
    pixels: DataFrame, rect: tuple[int, int, int, int], limit: int | None = None, budget: int = 4096, remaining: DataFrame | None = None
) -> DataFrame:
    """(image_id, r, g, b, n, place): distinct colours of visible pixels in a rectangle (x, y, w, h; within the image), most
    frequent first, then by colour; the first `limit` of an image, or all. At most `budget` pixels are read, on a grid that
    holds the rectangle's edges. remaining (image_id, x, y, a): only pixels that are still solid there (a 255) count."""
    x, y, w, h = rect
    size = pixels.groupBy("image_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y"))
    here = [F.greatest(F.lit(v), F.lit(0)) for v in (x, y)]
    last = [F.least(F.lit(v + n - 1), F.col(c)) for v, n, c in ((x, w, "_x"), (y, h, "_y"))]
    wide, high = (b - a + 1 for a, b in zip(here, last, strict=True))
    size = size.select(
        "image_id", *(c.alias(n) for c, n in zip((*here, *last, wide, high), ("_x0", "_y0", "_x1", "_y1", "_w", "_h"), strict=True))
    ).filter("_w > 0 and _h > 0")
    least = F.greatest(F.ceil(F.sqrt(F.col("_w") * F.col("_h") / budget)), F.lit(1))
    taken = lambda n, s: F.ceil((n - 1) / s) + 1
    steps = F.sequence(least, least + 64)
    fits = F.filter(steps, lambda s: taken(F.col("_w"), s) * taken(F.col("_h"), s) <= budget)
    size = size.withColumn("_step", F.coalesce(F.get(fits, F.lit(0)), least + 64))
    held = pixels.join(size, "image_id").filter("x between _x0 and _x1 and y between _y0 and _y1 and a > 0")
    held = held.filter("((x - _x0) % _step = 0 or x = _x1) and ((y - _y0) % _step = 0 or y = _y1)")
    if remaining is not None:
        held = held.join(remaining.filter("a = 255").select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")
    counts = held.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    place = Window.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")
    out = counts.withColumn("place", F.row_number().over(place))
    return out if limit is None else out.filter(F.col("place") <= limit)


def covering_colours(counts: DataFrame, tolerance: float = 0.02, listed: list[tuple[tuple, float]] = (), limit: int = 64) -> DataFrame:
    """(image_id, place, r, g, b): of the colours of each image (image_id, r, g, b, place), in order, those that neither the
    listed (colour in 0..1, tolerance) nor an earlier one here comes within its tolerance of, at most `limit`. What is folded
    is one image's colours, which colour_counts bounds."""
    channels = lambda c: [stored(c[k] * UNIT) for k in "rgb"]
    far = lambda a, b: F.greatest(*[F.abs(x - y) for x, y in zip(a, b, strict=True)])
    known = lambda c: reduce(lambda e, k: e | (far(channels(c), [stored(F.lit(float(v))) for v in k[0]]) <= k[1]), listed, F.lit(False))
    kind = "array<struct<r:int,g:int,b:int>>"
    near = lambda kept, c: F.exists(kept, lambda k: far(channels(k), channels(c)) <= tolerance)
    add = lambda kept, c: F.when((F.size(kept) >= limit) | known(c) | near(kept, c), kept).otherwise(F.concat(kept, F.array(F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")))))
    ordered = counts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "r", "g", "b"))).alias("c"))
    kept = ordered.select("image_id", F.posexplode(F.aggregate("c", F.array().cast(kind), add)).alias("at", "k"))
    return kept.select("image_id", (F.col("at") + 1).alias("place"), "k.r", "k.g", "k.b")


def colour_moments(pixels: DataFrame) -> DataFrame:
    """Counts, channel sums and square sums of solid pixels by image and by the upper five bits of each channel."""
    cell = {f"{c}5": F.shiftright(F.col(c), 3) for c in "rgb"}
    solid = pixels.filter(F.col("a") / 255.0 >= 0.5).withColumns(cell)
    return solid.groupBy("image_id", *cell).agg(
        F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"), F.sum(F.expr("r * r + g * g + b * b")).alias("squares")
    )


def flip_green(normals: DataFrame) -> DataFrame:
    return normals.withColumn("ny", 255 - F.col("ny"))


def combine_normals(base: DataFrame, detail: DataFrame, opacity: float, reoriented: bool = False) -> DataFrame:
    """Two maps of (image_id, x, y, nx, ny, nz) joined by pixel: detail's slopes added to base's, or turned onto it."""
    d = detail.select("image_id", "x", "y", *(F.col(c).alias(f"d{c}") for c in ("nx", "ny", "nz")))
    part = lambda c: F.col(c) / 255.0 * 2.0 - 1.0
    deep = lambda c: F.greatest(part(c), F.lit(0.001))
    both = base.join(d, ["image_id", "x", "y"])
    sx, sy = (part(c) / deep("dnz") * opacity for c in ("dnx", "dny"))
    if reoriented:
        length = F.sqrt(sx * sx + sy * sy + 1.0)
        bx, by, tz, ux, uy = part("nx"), part("ny"), deep("nz") + 1.0, -sx, -sy
        reach = (bx * ux / length + by * uy / length + tz / length) / tz  # products first, as in the SQL: a last bit can move a byte
        v = (bx * reach - ux / length, by * reach - uy / length, tz * reach - 1.0 / length)
    else:
        v = (part("nx") / deep("nz") + sx, part("ny") / deep("nz") + sy, F.lit(1.0))
    made = both.withColumns({f"_{i}": c for i, c in enumerate(v)})
    length = F.greatest(F.sqrt(F.col("_0") * F.col("_0") + F.col("_1") * F.col("_1") + F.col("_2") * F.col("_2")), F.lit(0.001))
    return made.select("image_id", "x", "y", *(byte(F.col(f"_{i}") / length * 0.5 + 0.5).alias(c) for i, c in enumerate(("nx", "ny", "nz"))))


def _framed(pixels: DataFrame, value: str) -> DataFrame:
    """(image_id, x, y, value, _own): the pixels and one more around each image, which repeats its border."""
    out = pixels.select("image_id", "x", "y", value, F.lit(True).alias("_own"))
    for along, across in (("x", "y"), ("y", "x")):
        line = Window.partitionBy("image_id", across).orderBy(along)
        first, last = (F.when(f(along).over(line).isNull(), F.col(along) + d) for f, d in ((F.lag, -1), (F.lead, 1)))
        grown = out.withColumn("_at", F.array_compact(F.array(first, F.col(along), last))).withColumn("_to", F.explode("_at"))
        out = grown.withColumn("_own", F.col("_own") & (F.col("_to") == F.col(along))).withColumn(along, F.col("_to")).drop("_at", "_to")
    return out


def _scharr(frame: DataFrame, value: str, name: str) -> DataFrame:
    """frame with the slopes {name}x and {name}y of a column, where all neighbours are there."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    held = frame.withColumns({"_l": F.lag(value).over(row), "_c": F.col(value), "_r": F.lead(value).over(row)})
    held = held.withColumns({f"_u{c}": F.lag(f"_{c}").over(column) for c in "lcr"} | {f"_d{c}": F.lead(f"_{c}").over(column) for c in "lcr"})
    c = lambda n: F.col(f"_{n}")
    dx = (3.0 * (c("ur") - c("ul")) + 10.0 * (c("r") - c("l")) + 3.0 * (c("dr") - c("dl"))) / 32.0
    dy = (3.0 * (c("dl") - c("ul")) + 10.0 * (c("dc") - c("uc")) + 3.0 * (c("dr") - c("ur"))) / 32.0
    return held.withColumns({f"{name}x": dx, f"{name}y": dy}).drop(*(f"_{a}{b}" for a in ("u", "d", "") for b in "lcr"))


def box_mean(pixels: DataFrame, value: str, radius: int, name: str) -> DataFrame:
    """pixels with the mean of a column over the square around each pixel, cut at the borders, as a float32 buffer keeps it."""
    summed = box_sum(pixels, value, radius)
    return summed.withColumn(name, stored(F.col("box_total") / F.col("box_count"))).drop("box_total", "box_count")


def brightness_normals(pixels: DataFrame, coarse: float = 4.0, size: int = 6, fine: float = 3.0, green_down: bool = False) -> DataFrame:
    """Normals from the slopes (Scharr) of brightness and of its box mean, added by strength. Pixels that are not solid take the
    mean of those that are; the border is repeated once around; pixels of alpha 0 and images without a solid pixel stay flat."""
    solid = F.col("a") / 255.0 >= 0.5
    level = lambda r, g, b: (0.299 * r + 0.587 * g + 0.114 * b) / 255.0
    mean = [F.sum(F.when(solid, F.col(c))).cast("double") / F.sum(solid.cast("int")) for c in "rgb"]
    means = pixels.groupBy("image_id").agg(level(*mean).alias("_mean"))
    lit = pixels.join(means, "image_id").withColumn("_light", stored(F.when(solid, level(*(F.col(c) for c in "rgb"))).otherwise(F.col("_mean"))))
    frame = _framed(lit, "_light")
    frame = _scharr(box_mean(_scharr(frame, "_light", "_f"), "_light", max(size, 1), "_form"), "_form", "_g").filter("_own")
    slope = lambda axis: F.col(f"_f{axis}") * max(fine, 0.0) + F.col(f"_g{axis}") * max(coarse, 0.0)
    held = lit.select("image_id", "x", "y", "a", "_mean").join(frame, ["image_id", "x", "y"]).withColumns({"_x": -slope("x"), "_y": -slope("y") if green_down else slope("y")})
    length = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + 1.0)
    n = {"nx": F.col("_x") / length, "ny": F.col("_y") / length, "nz": 1.0 / length}
    flat, still = {"nx": 128, "ny": 128, "nz": 255}, (F.col("a") == 0) | F.col("_mean").isNull() | F.lit(max(fine, coarse) <= 0)
    return held.select("image_id", "x", "y", *(F.when(still, flat[k]).otherwise(byte(v * 0.5 + 0.5)).alias(k) for k, v in n.items()), "a")


def refined(pixels: DataFrame, guide: str, cover: str, radius: int) -> DataFrame:
    """pixels whose coverage follows a guide: the guided filter, in box means of (2 radius + 1) squares."""
    held = pixels.withColumns({"_gg": stored(F.col(guide) * F.col(guide)), "_gc": stored(F.col(guide) * F.col(cover))})
    for value, name in ((guide, "_mg"), (cover, "_mc"), ("_gg", "_mgg"), ("_gc", "_mgc")):
        held = box_mean(held, value, radius, name)
    slope = (F.col("_mgc") - F.col("_mg") * F.col("_mc")) / (F.col("_mgg") - F.col("_mg") * F.col("_mg") + 1e-6)
    held = held.withColumn("_slope", slope).withColumns({"_s": stored(F.col("_slope")), "_o": stored(F.col("_mc") - F.col("_slope") * F.col("_mg"))})
    held = box_mean(box_mean(held, "_s", radius, "_ms"), "_o", radius, "_mo")
    q = clamp(F.col("_ms") * F.col(guide) + F.col("_mo"))
    return held.withColumn(cover, stored(F.when(q < 0.5 / 255.0, 0.0).otherwise(q))).drop(
        "_gg", "_gc", "_mg", "_mc", "_mgg", "_mgc", "_slope", "_s", "_o", "_ms", "_mo"
    )


def beside_subject(pixels: DataFrame, ground: Column) -> DataFrame:
    """Background pixels with a subject pixel to the left, right, above or below."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    held = pixels.withColumn("_ground", ground)
    near = [f("_ground").over(w) for f in (F.lag, F.lead) for w in (row, column)]
    subject = reduce(lambda a, b: a | b, [~F.coalesce(n, F.lit(True)) for n in near])
    return held.withColumn("_beside", subject).filter("_ground and _beside").drop("_ground", "_beside")


def clipped(coverage: Column, floor: float, ceiling: float) -> Column:
    """Coverage stretched between a floor and a ceiling, at least 0.0001 apart."""
    return stored(clamp((coverage - floor) / max(ceiling - floor, 1e-4)))


def wide_blocks(pixels: DataFrame, value: str, threshold: float) -> DataFrame:
    """(image_id, bx, by_, low, high) of 8 x 8 blocks whose range of values reaches the threshold (of 255)."""
    block = pixels.groupBy(
        "image_id", F.expr("cast(x div 8 as int)").alias("bx"), F.expr("cast(y div 8 as int)").alias("by_")
    ).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return block.filter(F.col("high") / 255.0 - F.col("low") / 255.0 >= threshold)
