"""DataFrame forms: they agree with the kernels, and streams agree with batches."""

import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pixelstrata.operators import batch, packing, pixels
from pixelstrata.plans import catalog
from pixelstrata.plans.stack import apply_stack, run_stack, resolved
from pixelstrata.sources import files, rasters
from pixelstrata.streaming.ingest import image_stream, merged_edits


def some_images(spark, n=3, h=9, w=11):
    rng = np.random.default_rng(5)
    rows = [(i, w, h, rng.integers(0, 256, (h, w, 4), np.uint8).tobytes()) for i in range(n)]
    return spark.createDataFrame(rows, rasters.PACKED), {r[0]: np.frombuffer(r[3], np.uint8).reshape(h, w, 4) for r in rows}


def as_arrays(long, h, w):
    out = {}
    for r in long.collect():
        out.setdefault(r.image_id, np.zeros((h, w, 4), np.uint8))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    return out


def test_packed_and_long_round_trip(spark):
    images, arrays = some_images(spark)
    back = {r.image_id: r for r in rasters.packed(rasters.unpacked(images)).collect()}
    assert all(back[i].data == a.tobytes() and (back[i].width, back[i].height) == (11, 9) for i, a in arrays.items())


def test_expressions_equal_kernels(spark):
    images, arrays = some_images(spark)
    long = rasters.unpacked(images)
    regions = [{"rect": (1, 1, 7, 6), "hue": 0.37, "saturation": 1.4, "value": 0.8}, {"rect": (3, 0, 20, 5), "hue": -0.2, "saturation": 0.3, "value": 1.5}]
    for name, settings, frame in (
        ("hsv_adjust", {"regions": regions}, pixels.adjust_hsv(long, regions)), ("posterize", {"levels": 6}, pixels.posterize_even(long, 6))
    ):
        got = as_arrays(frame, 9, 11)
        for i, a in arrays.items():
            assert (run_stack(11, 9, a.tobytes(), resolved([(name, settings)])).data.reshape(9, 11, 4) == got[i]).all(), name


def most_rows(plan):
    """The most rows that a step of a plan put out when it ran."""
    name, inner = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        inner = [plan.plan()]
    children = plan.children()
    inner += [children.apply(i) for i in range(children.size())]
    out = plan.metrics().get("numOutputRows")
    return max([out.get().value() if out.isDefined() else 0, *map(most_rows, inner)])


def test_polygon_judges_places_once(spark, tmp_path):
    rows = [(i, 1 + i % 9, 900.0 + i) for i in [*range(4000), *range(5000, 5003), 7, 7]]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    long = rasters.shapes(spark, str(tmp_path))
    want = long.filter(pixels.inside_polygon(long, catalog.POLYGON)).groupBy("image_id").count().collect()
    made = catalog.polygon_region(spark, str(tmp_path))
    got = made.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 251
    assert most_rows(made._jdf.queryExecution().executedPlan()) < 10_000  # 1,028,608 pixels


def test_reoriented_normals_round_as_their_sql(spark, tmp_path):
    lums = (57, 160, 200)  # each has a place whose byte hangs on the order of multiplication and division
    rows = [(i, [(lums[i // 64] + 0.5) / 255 - 0.5] * 64) for i in range(64 * len(lums))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(catalog.ORACLES["normal_combine_reoriented"]).fetchall()
    got = catalog.normal_combine_reoriented(spark, str(tmp_path)).collect()
    assert len(want) == 4096 * len(lums) and set(map(tuple, got)) == set(want) and len(got) == len(want)


def test_bad_images_say_so(spark):
    images = spark.createDataFrame([(1, 2, 2, b"x"), (2, None, None, None), (3, 1, 1, b"\x01\x02\x03\xff")], rasters.PACKED)
    rows = {r.image_id: r for r in apply_stack(images, [("posterize", {}), {"id": "unknown"}, {"id": "denoise", "enabled": False}]).collect()}
    assert rows[1].error and rows[2].error and rows[3].error is None and len(rows[3].data) == 4


def test_files_streams_and_sinks(spark, tmp_path):
    images, arrays = some_images(spark)
    named = files.as_png(images).select(F.concat(F.lit("i"), "image_id", F.lit(".png")).alias("target"), F.col("png").alias("content"))
    folder = f"file://{tmp_path}/in"
    written = {r.target: r for r in files.write_files(named, folder).collect()}
    (tmp_path / "in" / "bad.PNG").write_bytes(b"no")
    (tmp_path / "in" / "note.txt").write_text("x")
    (tmp_path / "in" / "a.webp").write_bytes(b"RIFF")
    read = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, folder).collect()}
    assert set(read) == {"i0.png", "i1.png", "i2.png", "bad.PNG", "a.webp"} and set(written) == {"i0.png", "i1.png", "i2.png"}
    assert all(read[f"i{i}.png"].data == a.tobytes() for i, a in arrays.items()) and read["bad.PNG"].error and read["a.webp"].error
    stack = [("posterize", {"levels": 3})]
    query = image_stream(spark, folder, stack).writeStream.format("memory").queryName("made").option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    streamed = {r.data for r in spark.table("made").collect() if r.error is None}
    assert streamed == {r.data for r in apply_stack(images, stack).collect()}


EDITS = [("p", "a", 10_000 + t, i) for i, t in enumerate((0, 500, 900, 2000, 2100))] + [
    ("p", "b", 12_200, 5), ("p", "a", 12_300, 6), ("p", "", 12_310, 7), ("p", "", 12_320, 8), ("q", "a", 10_000, 9), ("q", "a", 10_000, 10),
    ("q", None, 10_100, 11), ("q", "a", 10_200, 12)
]


def edits_frame(spark):
    return spark.createDataFrame(EDITS, "log string, key string, ms long, seq long").select("log", "key", F.timestamp_millis("ms").alias("ts"), "seq")


def test_streamed_edits_equal_batch(spark, tmp_path):
    held = edits_frame(spark)
    want = {(r.log, r.key or "", r.ts, r.edits) for r in batch.merged_history(held).collect()}
    assert len(want) == 9
    source = f"file://{tmp_path}/edits"
    held.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(held.schema).parquet(source).withWatermark("ts", "0 seconds")
    query = merged_edits(stream).writeStream.format("memory").queryName("edits").option("checkpointLocation", f"file://{tmp_path}/c2").start()
    query.processAllAvailable()
    spark.createDataFrame(
        [("z", "z", 60_000, 99)], "log string, key string, ms long, seq long"
    ).select("log", "key", F.timestamp_millis("ms").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(source)
    for _ in range(20):
        query.processAllAvailable()
        got = {(r.log, r.key, r.ts, r.edits) for r in spark.table("edits").collect()}
        if want <= got:
            break
        time.sleep(0.5)
    query.stop()
    assert want <= got


def test_history_is_one_log(spark):
    rows = sorted(((r.log, r.place, r.key, r.edits) for r in batch.merged_history(edits_frame(spark)).collect()), key=str)
    assert [(k, n) for log, _, k, n in rows if log == "p"] == [("", 1), ("", 1), ("a", 1), ("b", 1), ("a", 2), ("a", 3)]
    assert [(k, n) for log, _, k, n in rows if log == "q"] == [("a", 1), (None, 1), ("a", 2)]
    assert [r.place for r in batch.merged_history(edits_frame(spark), cap=2).filter("log = 'p'").collect()] == [1, 2]
    model = lambda moves, cap=1000: batch.replayed(moves, 600, cap)
    assert model([(0, "a", None), (10, "b", None), (20, "a", None)]) == ([["a", 0, 1], ["b", 10, 1], ["a", 20, 1]], 2)
    assert model([(0, "a", None), (10, "b", None), (15, "", 0), (20, "a", None)]) == ([["a", 0, 1], ["a", 20, 1]], 1)
    assert model([(0, "a", None), (5, "", -1), (9, "b", None)]) == ([["b", 9, 1]], 0)
    assert model([(i * 1000, "a", None) for i in range(5)], 3) == ([["a", 2000, 1], ["a", 3000, 1], ["a", 4000, 1]], 2)
    moved = edits_frame(spark).withColumn("move", F.lit(None).cast("int"))
    same = {(r.log, r.place, r.key or "", r.ts, r.edits) for r in batch.replayed_history(moved).collect()}
    assert same == {(r.log, r.place, r.key or "", r.ts, r.edits) for r in batch.merged_history(edits_frame(spark)).collect()}
    undone = batch.replayed_history(moved.withColumn("move", F.when(F.col("seq") == 8, 1)).filter("log = 'p'")).orderBy("place").collect()
    assert [r.undone for r in undone] == [True] * 3 + [False] * 2


def grid_model(sizes, width, height, padding):
    """Cells on the first sheet that has enough, by plain counting."""
    side, turn = [width, height], 0
    cell = [max((s[k] + padding if min(s) > 0 else s[k]) for s in sizes) for k in (0, 1)]
    live = [i for i, s in enumerate(sizes) if min(s) > 0]
    while True:
        across, down = [max(side[k] - padding, 0) // cell[k] for k in (0, 1)]
        if across * down >= len(live) or min(side) >= 16384:
            return {i: (n % across * cell[0] + padding, n // across * cell[1] + padding) for n, i in enumerate(live[: across * down])}, *side
        turn = 1 - turn if side[turn] >= 16384 else turn
        side[turn] = min(2 * side[turn], 16384)
        turn = 1 - turn


def test_grid_plans(spark):
    rng = np.random.default_rng(3)
    for width, height, padding in ((16, 16, 0), (64, 8, 2), (3, 3, 1), (10_000, 9, 16)):
        sizes = [(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))]
        rows = spark.createDataFrame([(0, i, w, h) for i, (w, h) in enumerate(sizes)], "sheet long, sprite_id long, w int, h int")
        want, w, h = grid_model(sizes, width, height, padding)
        got = batch.grid_plan(rows, width, height, padding).collect()
        assert {r.sprite_id: (r.x, r.y) for r in got if r.x >= 0} == want and {(r.sheet_width, r.sheet_height) for r in got} == {(w, h)}
        places, *side = packing.place(sizes, "grid", width, height, padding)
        assert {i: p for i, p in enumerate(places) if p} == want and side == [w, h]
    assert batch.grid_plan(rows, 24, 24, 0, expand=False).filter("x >= 0").count() == 4
    assert batch.sheet_sizes(10_000, 3, True)[:4] == [(10_000, 3), (16_384, 3), (16_384, 6), (16_384, 12)]


def test_jpg_and_bmp_are_read(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(8, 6, 1)
    for y in range(6):
        for x in range(8):
            picture.setRGB(x, y, (200 << 16) | (10 * y << 8) | 30)
    for name, kind in (("a.JPG", "jpg"), ("b.bmp", "bmp")):
        assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "c.jpeg").write_bytes(b"no")
    read = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, f"file://{tmp_path}").collect()}
    exact = np.frombuffer(read["b.bmp"].data, np.uint8).reshape(6, 8, 4)
    assert exact[5, 0].tolist() == [200, 50, 30, 255] and read["c.jpeg"].error and read["c.jpeg"].data is None
    near = np.frombuffer(read["a.JPG"].data, np.uint8).reshape(6, 8, 4).astype(int)
    assert np.abs(near[..., :3] - exact[..., :3].astype(int)).max() < 40 and (near[..., 3] == 255).all()


def test_sinks_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"1"), ("y.bin", None), ("z.bin", b"")], "target string, content binary")
    done = {r.target: r for r in files.write_files(rows, f"file://{tmp_path}/out").collect()}
    assert done["y.bin"].error == "no content" and done["a/x.bin"].bytes == 1 and done["z.bin"].error is None
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"1" and {p.name for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"x.bin", "z.bin"}
    given = spark.createDataFrame([("s", b"1"), ("t", b"2")], "path string, content binary")
    assert [
        (r.target, bytes(r.content))
        for r in files.copies(given, spark.createDataFrame([("t", "u")], "source string, target string")).collect()
    ] == [("u", b"2")]
    made = files.sidecars(spark.createDataFrame([("in/a.png", "{}"), ("in/b.c.png", None)], "path string, text string")).collect()
    assert [r.target for r in made] == ["a.stack", "b.c.stack"] and files.unpack_sidecar(bytes(made[0].content)) == ("{}", None) and made[1].content is None
    newer, damaged = b"PXST\x02\0\0\0", files.pack_sidecar("x")[:-1]
    held = spark.createDataFrame([("a", bytes(made[0].content)), ("b", newer), ("c", damaged), ("d", b"{}"), ("e", None)], "path string, content binary")
    assert {r.path: (r.text, r.error) for r in files.read_sidecars(held).collect()} == {
        "a": ("{}", None), "b": (None, "newer container"), "c": (None, "damaged sidecar"), "d": (None, "no sidecar"),
        "e": (None, "no sidecar")
    }
    old = spark.createDataFrame(
        [
            ("a_old.json", b'{"stack": []}'), ("b_old.json", b'{"version": 1, "operations": {}}'), ("c_old.json", b"no"),
            ("d_old.json", b'{"x": 1}'), ("e.json", b'{"stack": []}')
        ],
        "path string, content binary"
    )
    there = spark.createDataFrame([("a.stack", files.pack_sidecar("{}")), ("b.stack", b"other")], "path string, content binary")
    moved = files.converted(old, there, "_old.json").collect()
    assert [(r.path, r.target, files.unpack_sidecar(bytes(r.content))[0]) for r in moved] == [("b_old.json", "b.stack", '{"version": 1, "operations": {}}')]


def test_sheets_as_files(spark):
    sizes = spark.createDataFrame(
        [(s, i, 3 + i % 4, 4) for s in (0, 1) for i in range(5)], "sheet long, sprite_id long, w int, h int"
    ).withColumn("sprite_id", F.col("sheet") * 10 + F.col("sprite_id"))
    rects = batch.grid_plan(sizes, 16, 16, 1)
    none = spark.createDataFrame([], "row int, sprite_id long, dx int, dy int, vx int, vy int, enabled boolean")
    lookups = batch.lookup_pixels(rects, batch.pivots(rects, none))
    blank = np.full((4, 4, 4), 255, np.uint8).tobytes()
    sheets = spark.createDataFrame([(0, "s0", 4, 4, blank), (1, "s1", 4, 4, None)], "image_id long, name string, width int, height int, data binary")
    made = {r.target: r for r in files.sheet_files(sheets, lookups, sheets.drop("name").filter("image_id = 0")).collect()}
    assert set(made) == {"s0.png", "s0_lut.bin", "s0_normal.png", "s1.png"} and made["s1.png"].error and made["s1.png"].content is None
    table = bytes(made["s0_lut.bin"].content)
    w, h = np.frombuffer(table[:8], "<u4")
    values = np.frombuffer(table[8:], "<f4").reshape(h, w, 4)
    assert (w, h) == batch.table_side(5) and values[0, 0].tolist() == [1, 1, 3, 4] and values[0, 1].tolist() == [2.5, 3, 0, 1] and not values.reshape(-1, 4)[10:].any()


def test_networks_and_cache(spark):
    from pixelstrata.operators import models

    both = lambda *names: [f"{n}.{e}" for n in names for e in ("param", "bin")]
    assert models.network_scales(both("m-x2", "m-x4"), "a/m") == [2, 4] and models.network_scales(both("p-x4plus"), "a/p-x4plus") == [4]
    assert models.network_scales(["m-x2.param"], "a/m") == [] and models.network_files(both("n-x3"), "n/", 3) == ("n-x3.param", "n-x3.bin")
    images, arrays = some_images(spark)
    key = models.network_signature("e", "m", 0, 2, False)
    first = models.cached_upscale(images, None, key, scale=2)
    cache = spark.createDataFrame(first.filter("image_id < 2").collect(), first.schema)
    again = {
        r.image_id: bytes(r.data)
        for r in models.cached_upscale(
            images, cache.withColumn("data", F.when(F.col("image_id") == 0, F.lit(b"held")).otherwise(F.col("data"))), key, scale=2
        ).collect()
    }
    assert again[0] == b"held" and again[1] == again[1] == models.doubled(arrays[1]).tobytes() and again[2] == models.doubled(arrays[2]).tobytes()
    assert models.cached_upscale(images, cache, "other", scale=2).filter("data = X'68656c64'").count() == 0


def test_colour_scan(spark):
    rng = np.random.default_rng(9)
    image = rng.integers(0, 3, (21, 17, 4)).astype(np.uint8) * 40
    image[..., 3] = rng.choice([0, 255], (21, 17), p=[0.1, 0.9])
    left = rng.choice([0, 200, 255], (21, 17))
    frame = rasters.unpacked(spark.createDataFrame([(0, 17, 21, image.tobytes())], rasters.PACKED))
    remaining = spark.createDataFrame([(0, x, y, int(left[y, x])) for y in range(21) for x in range(17)], "image_id long, x int, y int, a int")
    for (x, y, w, h), budget in (((2, 3, 10, 9), 4096), ((-3, 5, 40, 40), 30), ((0, 0, 17, 21), 7), ((4, 4, 1, 1), 1)):
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, 17) - 1, min(y + h, 21) - 1
        stops = lambda a, b, s: sorted({*range(a, b, s), b})
        step = max(int(np.ceil(np.sqrt((x1 - x0 + 1) * (y1 - y0 + 1) / budget))), 1)
        while len(stops(x0, x1, step)) * len(stops(y0, y1, step)) > budget and step < 64:
            step += 1
        for rest in (None, remaining):
            count = {}
            for v in stops(y0, y1, step):
                for u in stops(x0, x1, step):
                    if image[v, u, 3] and (rest is None or left[v, u] == 255):
                        c = tuple(image[v, u, :3].tolist())
                        count[c] = count.get(c, 0) + 1
            want = [(*c, n) for c, n in sorted(count.items(), key=lambda e: (-e[1], e[0]))]
            got = pixels.colour_counts(frame, (x, y, w, h), budget=budget, remaining=rest).orderBy("place").collect()
            assert [(r.r, r.g, r.b, r.n) for r in got] == want
    assert pixels.colour_counts(frame, (30, 0, 5, 5)).count() == 0
    kept = []
    for r in (counts := pixels.colour_counts(frame, (0, 0, 17, 21)).orderBy("place").collect()):
        if len(kept) < 3 and max(r.r, r.g, r.b) > 40 and all(max(abs(r.r - k[0]), abs(r.g - k[1]), abs(r.b - k[2])) > 40 for k in kept):
            kept.append((r.r, r.g, r.b))
    cover = pixels.covering_colours(pixels.colour_counts(frame, (0, 0, 17, 21)), 41 / 255, [((0, 0, 0), 41 / 255)], 3).orderBy("place").collect()
    assert counts and [(r.r, r.g, r.b) for r in cover] == kept


def test_jobs(spark):
    jobs = spark.createDataFrame([("s1", "t1"), ("s2", "t2")], "source string, target string")
    was = spark.createDataFrame([("s1", b"1"), ("s2", b"2")], "path string, content binary")
    now = spark.createDataFrame([("t1", b"1"), ("t2", b"2")], "path string, content binary")
    verdicts = lambda j, n: {r.verdict for r in batch.removable(was, n, j).collect()}
    assert verdicts(jobs, now) == {"remove"}
    assert verdicts(jobs, now.filter("path = 't1'")) == {"keep"}
    assert verdicts(jobs.withColumn("target", F.lit("t1")), now) == {"keep"}
    names = spark.createDataFrame([(0, "a/heroWalk-cycle_two.PNG"), (1, "b"), (2, "c.tga")], "batch_index long, source string")
    titled = [r.target for r in batch.renamed(names, counter=False, case="title").orderBy("batch_index").collect()]
    assert titled == ["Hero Walk Cycle Two.png", "B", "C.tga"]
    assert [
        r.target for r in batch.renamed(names, base="x", start=-1, step=1, at_end=False).orderBy("batch_index").collect()
    ] == ["-01_x.png", "00_x", "01_x.tga"]
    assert [batch.table_side(n) for n in (0, 1, 2, 3, 5, 9)] == [(2, 1), (2, 1), (2, 2), (4, 2), (4, 4), (8, 4)]
    widths = spark.range(40).select(batch.table_width(F.col("id").cast("int")).alias("w")).collect()
    assert [r.w for r in widths] == [batch.table_side(n)[0] for n in range(40)]


def test_cut_and_build(spark):
    flat = np.zeros((12, 12, 4), np.uint8)
    flat[1:4, 1:5], flat[7:11, 6:9] = 255, 200
    images = spark.createDataFrame([(0, 12, 12, flat.tobytes())], rasters.PACKED)
    cut = packing.cut_sprites(images).withColumn("sheet", F.lit(0).cast("long"))
    planned = packing.plan(
        cut.select("sheet", F.col("sprite_id").cast("long").alias("sprite_id"), F.col("width").alias("w"), F.col("height").alias("h")),
        "tight", 8, 8
    )
    sheet = packing.build_sheets(cut, planned).first()
    made = np.frombuffer(sheet.data, np.uint8).reshape(sheet.height, sheet.width, 4)
    assert (made[..., 3] > 0).sum() == 12 + 12
