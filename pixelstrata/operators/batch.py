"""Batch tools as column expressions: renaming, output names, packing tables, look-up tables, pivots, advice, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of the images that are read.
FORMATS = ("png", "jpg", "jpeg", "bmp", "tga", "webp")
MAX_SIDE, MAX_PADDING = 16384, 16


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*FORMATS)


def default_target(path: Column, suffix: str) -> Column:
    """Where a processed image goes: its own name, a suffix, and the format that everything is written in."""
    return F.concat(base_name(path), F.lit(f"{suffix}.png"))


def cased(name: Column, case: str) -> Column:
    """keep, lower, upper or title; title splits words at -, _ and spaces, and before an upper letter that follows a lower one."""
    words = F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])", " "), r"[-_ ]+", " ")))
    return {"keep": name, "lower": F.lower(name), "upper": F.upper(name), "title": F.initcap(words)}[case]


def renamed(
    batch: DataFrame, base="", find="", replace="", prefix="", suffix="", counter=True, start=1, step=1, digits=2, at_end=True,
    separator="_", case="keep"
) -> DataFrame:
    """(batch_index, source, target): new names of a batch (batch_index from 0, source path); extensions stay, in lower case."""
    name = F.lit(base) if base else base_name(F.col("source"))
    name = F.replace(name, F.lit(find), F.lit(replace)) if find else name
    name = F.concat(F.lit(prefix), name, F.lit(suffix))
    if counter:
        number = F.lit(start) + F.col("batch_index") * step
        digit = F.abs(number).cast("string")
        text = F.concat(F.when(number < 0, "-").otherwise(""), F.when(F.length(digit) < digits, F.lpad(digit, digits, "0")).otherwise(digit))
        name = F.concat(name, F.lit(separator), text) if at_end else F.concat(text, F.lit(separator), name)
    dotted = F.when(extension(F.col("source")) != "", F.concat(F.lit("."), extension(F.col("source")))).otherwise("")
    return batch.select("batch_index", "source", F.concat(cased(name, case), dotted).alias("target"))


def collisions(jobs: DataFrame) -> DataFrame:
    """(target, n): targets that several sources share; none may be replaced or removed then."""
    return jobs.groupBy("target").agg(F.count("*").alias("n")).filter("n > 1")


def overwrites(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Jobs whose target is already there (existing: target)."""
    return jobs.join(existing.select("target").distinct(), "target", "left_semi")


def removable(sources: DataFrame, copies: DataFrame, jobs: DataFrame) -> DataFrame:
    """(source, verdict) for each job (source, target), and its batch if jobs have that column: a plan that removes nothing by
    itself. 'remove' only if no target of the batch is shared and the sha256 of every copy equals its source's; otherwise
    every source of the batch stays ('keep')."""
    own = ["batch"] if "batch" in jobs.columns else []
    held = jobs if own else jobs.withColumn("batch", F.lit(""))
    shared = collisions(jobs).select("target", F.lit(True).alias("shared"))
    checked = (
        held.join(sources.select(F.col("path").alias("source"), F.sha2("content", 256).alias("was")), "source", "left")
        .join(copies.select(F.col("path").alias("target"), F.sha2("content", 256).alias("now")), "target", "left")
        .join(shared, "target", "left")
    )
    bad = F.coalesce(F.col("was") != F.col("now"), F.lit(True)) | F.col("shared").isNotNull()
    trouble = checked.groupBy("batch").agg(F.bool_or(bad).alias("trouble"))
    return held.join(trouble, "batch").select(*own, "source", F.when(F.col("trouble"), "keep").otherwise("remove").alias("verdict"))


def batch_key(files: DataFrame) -> DataFrame:
    """(batch, config_key): the export settings' key, 16 hex digits of the sha256 of the sorted file names."""
    return files.groupBy("batch").agg(F.substring(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("name"))), 256), 1, 16).alias("config_key"))


def sheet_sizes(width: int, height: int, expand: bool) -> list[tuple[int, int]]:
    """The sizes a sheet is tried at: both sides within MAX_SIDE, doubled in turn, width first, each up to that limit."""
    out = [(min(max(width, 1), MAX_SIDE), min(max(height, 1), MAX_SIDE))]
    wide = True
    while expand and min(out[-1]) < MAX_SIDE:
        w, h = out[-1]
        wide = h >= MAX_SIDE or (wide and w < MAX_SIDE)
        out.append((min(2 * w, MAX_SIDE), h) if wide else (w, min(2 * h, MAX_SIDE)))
        wide = not wide
    return out


def bounded_padding(padding: int) -> int:
    return min(max(padding, 0), MAX_PADDING)


def grid_plan(sizes: DataFrame, width: int, height: int, padding: int = 0, expand: bool = True) -> DataFrame:
    """(sheet, sprite_id, x, y, w, h, sheet_width, sheet_height): each sheet's cells, of its largest padded sprite, filled row by
    row by sprite_id. Sprites without an area take no cell, and those beyond the last cell stand nowhere (x and y -1)."""
    padding = bounded_padding(padding)
    grown = lambda side: F.when(F.col("real"), F.col(side) + padding).otherwise(F.col(side))
    held = sizes.select("sheet", "sprite_id", "w", "h", ((F.col("w") > 0) & (F.col("h") > 0)).alias("real"))
    cells = held.groupBy("sheet").agg(F.max(grown("w")).alias("cw"), F.max(grown("h")).alias("ch"), F.count_if("real").alias("wanted"))
    tries = F.array(*[F.struct(F.lit(w).alias("sw"), F.lit(h).alias("sh")) for w, h in sheet_sizes(width, height, expand)])
    fits = lambda side, cell: F.greatest(F.floor((side - padding) / F.greatest(F.col(cell), F.lit(1))), F.lit(0))
    room = F.filter(tries, lambda t: fits(t["sw"], "cw") * fits(t["sh"], "ch") >= F.col("wanted"))
    cells = cells.withColumn("t", F.coalesce(F.get(room, F.lit(0)), F.element_at(tries, -1)))
    cells = cells.select("sheet", "cw", "ch", "t.sw", "t.sh", fits(F.col("t.sw"), "cw").alias("across"), fits(F.col("t.sh"), "ch").alias("down"))
    order = Window.partitionBy("sheet", "real").orderBy("sprite_id")
    placed = held.withColumn("n", F.row_number().over(order) - 1).join(cells, "sheet")
    inside = F.col("real") & (F.col("n") < F.col("across") * F.col("down"))
    at = lambda cell, size: F.when(inside, cell * F.col(size) + padding).otherwise(-1).cast("int")
    column, row = F.col("n") % F.greatest(F.col("across"), F.lit(1)), F.floor(F.col("n") / F.greatest(F.col("across"), F.lit(1)))
    return placed.select(
        "sheet", "sprite_id", at(column, "cw").alias("x"), at(row, "ch").alias("y"), "w", "h", F.col("sw").alias("sheet_width"),
        F.col("sh").alias("sheet_height")
    )


def table_side(sprites: int) -> tuple[int, int]:
    """Width and height of the look-up image: powers of two for two pixels a sprite (at least one), width grown first."""
    bits = (max(2 * sprites, 2) - 1).bit_length()
    return 1 << (bits + 1) // 2, 1 << bits // 2


def table_width(sprites: Column) -> Column:
    """The width of table_side as a column."""
    return F.pow(F.lit(2), F.floor((F.length(F.bin(F.greatest(sprites * 2, F.lit(2)) - 1)) + 1) / 2)).cast("int")


def lookup_pixels(rects: DataFrame, pivots: DataFrame) -> DataFrame:
    """(sheet, sprite_id, px, py, c0..c3): pixel 2n holds a sprite's rectangle, pixel 2n + 1 its pivot and direction, in a table as
    large as its sheet's sprites ask for; all values of a sprite that stands nowhere (x -1) are 0."""
    sheet = Window.partitionBy("sheet")
    held = rects.join(pivots, "sprite_id").withColumn(
        "n", F.row_number().over(sheet.orderBy("sprite_id")) - 1
    ).withColumn("width", table_width(F.count("*").over(sheet)))
    stands = (F.col("x") >= 0) & (F.col("w") > 0) & (F.col("h") > 0)
    four = lambda *names: F.array(*[F.when(stands, F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in names])
    both = F.array(four("x", "y", "w", "h"), four("pivot_x", "pivot_y", "dir_x", "dir_y"))
    out = held.select("sheet", "sprite_id", "n", "width", F.posexplode(both).alias("k", "c"))
    at = F.col("n") * 2 + F.col("k")
    return out.select(
        "sheet", "sprite_id", (at % F.col("width")).cast("int").alias("px"), F.floor(at / F.col("width")).cast("int").alias("py"),
        *(F.col("c")[i].alias(f"c{i}") for i in range(4))
    )


def pivots(rects: DataFrame, overrides: DataFrame) -> DataFrame:
    """(sprite_id, pivot_x, pivot_y, dir_x, dir_y): the centre and (0, 1), or the last enabled override (row, sprite_id, dx, dy,
    vx, vy) of a sprite: its offset from the rectangle and its direction at unit length."""
    last = overrides.filter("enabled").groupBy("sprite_id").agg(F.max_by(F.struct("dx", "dy", "vx", "vy"), "row").alias("o"))
    length = F.sqrt(F.col("o.vx") * F.col("o.vx") + F.col("o.vy") * F.col("o.vy"))
    way = lambda c, other: F.when(length > 0, F.col(f"o.{c}") / length).otherwise(other)
    return rects.join(last, "sprite_id", "left").select(
        "sprite_id", F.coalesce(F.col("x") + F.col("o.dx"), F.col("x") + F.col("w") / 2.0).cast("double").alias("pivot_x"), F.coalesce(F.col("y") + F.col("o.dy"), F.col("y") + F.col("h") / 2.0).cast("double").alias("pivot_y"),
        F.coalesce(way("vx", 0.0), F.lit(0.0)).alias("dir_x"), F.coalesce(way("vy", 1.0), F.lit(1.0)).alias("dir_y"))


def advice(names: DataFrame, keywords: list[tuple[str, str]]) -> DataFrame:
    """names with the advice of the first keyword that a name holds (case aside), null without any."""
    out = None
    for word, text in keywords:
        hit = F.contains(F.lower("name"), F.lit(word))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return names.withColumn("advice", out)


def merged_history(edits: DataFrame, gap_ms: int = 600, cap: int = 1000) -> DataFrame:
    """(log, place, key, ts, edits): the commands of each log of edits (log, ts, seq, key), newest first (place from 1), `cap` a log
    at most, each dated by its last edit.

    An edit goes into the newest command of its log if it has that command's key, not an empty one, and came at most gap_ms
    after the command's last edit. Edits of one time are taken by seq. For logs that are rewound see replayed_history."""
    order = Window.partitionBy("log").orderBy("ts", "seq")
    late = F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), F.col("ts")) > gap_ms * 1000
    joins = (F.col("key") != "") & (F.col("key") == F.lag("key").over(order)) & ~late
    runs = edits.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("command", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    commands = runs.groupBy("log", "command").agg(F.first("key").alias("key"), F.max("ts").alias("ts"), F.count("*").alias("edits"))
    place = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("command")))
    return commands.select("log", place.alias("place"), "key", "ts", "edits").filter(F.col("place") <= cap)


def replayed(rows: list[tuple], gap_ms: float, cap: int) -> tuple[list[list], int]:
    """The commands [key, time, edits] and the pointer (-1: before the first) after rows (time in ms, key, move) in order: a move
    takes the pointer there; an edit behind it drops what comes after."""
    commands: list[list] = []
    at = -1
    for time, key, move in rows:
        if move is not None:
            at = min(max(int(move), -1), len(commands) - 1)
            continue
        top = commands[at] if commands and at == len(commands) - 1 else None
        if top and key and top[0] == key and time - top[1] <= gap_ms:
            top[1], top[2] = time, top[2] + 1
            continue
        del commands[at + 1 :]
        commands.append([key, time, 1])
        del commands[: max(len(commands) - cap, 0)]
        at = len(commands) - 1
    return commands, at


def replayed_history(log: DataFrame, gap_ms: int = 600, cap: int = 1000) -> DataFrame:
    """(log, place, key, ts, edits, undone) after edits and moves (log, ts, seq, key, move): move is null for an edit, else the
    number of the command that the user went back or forward to (-1: before the first). An edit after going back drops the
    commands that were undone. This is a fold over one document's log, so a log is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "seq"], kind="stable")
        moves = [None if pd.isna(m) else int(m) for m in group["move"]]
        keys = ["" if k is None else k for k in group["key"]]
        commands, at = replayed(list(zip((group["ts"].astype("int64") / 1000).tolist(), keys, moves, strict=True)), gap_ms, cap)
        n = len(commands)
        rows = [(group["log"].iloc[0], n - i, k, pd.Timestamp(int(round(t * 1000)), unit="us"), e, i > at) for i, (k, t, e) in enumerate(commands)]
        return pd.DataFrame(rows, columns=["log", "place", "key", "ts", "edits", "undone"])

    kind = log.schema["log"].dataType.simpleString()
    us = log.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return us.select("log", "ts", "seq", "key", "move").groupBy("log").applyInPandas(
        run, f"log {kind}, place int, key string, ts timestamp, edits long, undone boolean"
    )
