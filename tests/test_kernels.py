"""Kernels against plain queue models on random grids, and the properties that operations promise."""

import json
from collections import deque

import numpy as np
import pytest

from pixelstrata.functions.canvas import Canvas
from pixelstrata.functions.floods import boxes, components, grassfire, islands
from pixelstrata.functions.pixelmath import box_mean, half_up
from pixelstrata.operators import documents, models, normals, packing
from pixelstrata.operators.stages import STAGES
from pixelstrata.plans.stack import resolved, run_stack
from pixelstrata.sources.files import decode_png, encode_png

RNG = np.random.default_rng(1)


def around(i, h, w, eight=False):
    y, x = divmod(i, w)
    steps = [(0, -1), (0, 1), (-1, 0), (1, 0)] if not eight else [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    return [(y + a) * w + x + b for a, b in steps if 0 <= y + a < h and 0 <= x + b < w]


def test_grassfire_is_the_queue():
    for _ in range(200):
        h, w, reach = RNG.integers(1, 9), RNG.integers(1, 9), int(RNG.integers(0, 6))
        seeds = RNG.permutation(h * w)[: RNG.integers(0, h * w + 1)]
        out, depth = [-1] * (h * w), [0] * (h * w)
        queue = deque(seeds.tolist())
        for s in seeds:
            out[s] = s
        while queue:
            i = queue.popleft()
            for n in around(i, h, w) if depth[i] < reach else []:
                if out[n] == -1:
                    out[n], depth[n] = out[i], depth[i] + 1
                    queue.append(n)
        assert grassfire(seeds, h, w, reach).tolist() == out


def test_islands_are_the_queue():
    for _ in range(200):
        h, w = RNG.integers(1, 9), RNG.integers(1, 9)
        alpha = RNG.choice([0.0, 0.3, 0.6, 1.0], h * w)
        label, queue, n = [-1] * (h * w), deque(), 0
        order = []
        for i in range(h * w):
            if label[i] < 0 and alpha[i] >= 0.5:
                label[i] = n
                queue.append(i)
                while queue:
                    j = queue.popleft()
                    order.append(j)
                    for k in around(j, h, w, True):
                        if label[k] < 0 and alpha[k] >= 0.5:
                            label[k] = n
                            queue.append(k)
                n += 1
        queue = deque(order)
        while queue:
            j = queue.popleft()
            for k in around(j, h, w, True):
                if label[k] < 0 and alpha[k] > 0:
                    label[k] = label[j]
                    queue.append(k)
        assert islands(alpha, h, w).tolist() == label


def test_contiguous_keys_are_the_queue():
    colours = np.array([[255, 255, 255], [250, 250, 250], [240, 200, 250], [10, 20, 30]], np.uint8)
    for _ in range(150):
        h, w = int(RNG.integers(1, 8)), int(RNG.integers(1, 8))
        data = np.full((h * w, 4), 255, np.uint8)
        data[:, :3] = colours[RNG.integers(0, 4, h * w)]
        data[RNG.random(h * w) < 0.1, 3] = 0
        c = Canvas(w, h, data.tobytes())
        for colour, tolerance in (([1, 1, 1], 0.03), ([0.94, 0.8, 0.97], 0.1)):
            c.add_key(colour, tolerance)
        reach, slack = int(RNG.integers(0, 3)), 0.2
        c.reach, c.reach_tolerance = reach, slack
        c.classify(True, 0)
        far = lambda i, k: float(c.distances(np.array([i]), k)[0])
        claim = lambda i: next((k for k in (0, 1) if far(i, k) <= c.keys[k][1]), -1)

        def take(i, key, weak):
            if data[i, 3] == 0:
                return -2, weak
            if key == -2:
                return claim(i), weak
            if far(i, key) <= c.keys[key][1]:
                return key, weak
            if claim(i) >= 0:
                return claim(i), weak
            return (key, weak + 1) if weak < reach and far(i, key) <= c.keys[key][1] + slack else (-1, weak)

        own, steps, queue = {}, {}, deque()
        for i in [x for col in range(w) for x in (col, (h - 1) * w + col)] + [x for row in range(h) for x in (row * w, row * w + w - 1)]:
            if i not in own and (k := take(i, -2, 0)[0]) != -1:
                own[i], steps[i] = k, 0
                queue.append(i)
        while queue:
            i = queue.popleft()
            for n in around(i, h, w):
                if n not in own:
                    k, s = take(n, own[i], steps[i])
                    if k != -1:
                        own[n], steps[n] = k, s
                        queue.append(n)
        want = [own.get(i, -2 if data[i, 3] == 0 else -1) for i in range(h * w)]
        assert c.key_of.tolist() == want
        weak = [i for i in own if steps[i] > 0 and own[i] >= 0]
        assert set(np.flatnonzero(c.mask == 1)) == set(weak) if reach else (c.mask != 1).all()


def test_means_rounding_and_parts():
    x = RNG.random((7, 9))
    want = np.array([[x[max(i - 2, 0) : i + 3, max(j - 2, 0) : j + 3].mean() for j in range(9)] for i in range(7)])
    assert np.allclose(box_mean(x, 2), want, atol=1e-6)
    assert half_up(np.array([0.49999999999999994, 2.5, -2.5, 1.4])).tolist() == [1, 3, -3, 1]
    assert components(np.array([1, 0, 1, 1], bool), 1, 4).tolist() == [0, -1, 1, 1]
    assert boxes(np.array([0, -1, 1, 1]), 4).tolist() == [[0, 0, 0, 0], [2, 0, 3, 0]]


def picture(h=40, w=48):
    y, x = np.mgrid[:h, :w]
    out = np.full((h, w, 4), 255, np.uint8)
    for cy, cx, r, colour in ((12, 12, 8, (200, 30, 30)), (25, 36, 9, (20, 180, 60)), (35, 7, 3, (30, 30, 190))):
        d = (y - cy) ** 2 + (x - cx) ** 2
        out[d <= r * r, :3] = colour
        ring = (d > r * r) & (d <= (r + 1) ** 2)
        out[ring, :3] = (np.array(colour) + 255) // 2
    return out


def through(image, *stack):
    h, w = image.shape[:2]
    return run_stack(w, h, image.tobytes(), resolved(list(stack))).compose().reshape(h, w, 4)


MATTE = ("remove_background", {})


def test_matte_keeps_objects_and_unmixes_edges():
    out = through(picture(), MATTE)
    assert out[0, 0, 3] == 0 and out[12, 12].tolist() == [200, 30, 30, 255]
    edge = out[(out[..., 3] > 0) & (out[..., 3] < 255)]
    assert len(edge) and all(min(np.abs(p[:3].astype(int) - c).max() for c in ((200, 30, 30), (20, 180, 60), (30, 30, 190))) < 6 for p in edge)


def test_promised_properties():
    image = picture()
    plain = through(image, MATTE)
    twice = through(image, MATTE, ("remove_crevice", {"reach": 1}), ("remove_crevice", {"reach": 1}))
    assert (twice == through(image, MATTE, ("remove_crevice", {"reach": 2}))).all()
    for name in ("smooth_blocks", "smooth_color", "smooth_halos", "posterize"):
        assert (through(image, MATTE, (name, {}))[..., 3] == plain[..., 3]).all()
    none, zero = (
        through(image, MATTE, ("posterize", {"palette": "best", "colors": 3, "dither": d, "strength": s})) for d,
        s in (("none", 1.0), ("floyd", 0.0))
    )
    assert (none == zero).all()
    tiles = [through(image, MATTE, ("random_hsv_tiles", {"seed": s})) for s in (4, 4, 5)]
    assert (tiles[0] == tiles[1]).all() and (tiles[0] != tiles[2]).any()
    assert (through(image, ("denoise", {}), ("neural_remove_background", {})) == image).all()
    half = through(image, ("denoise", {"model": lambda x, q: 1 - x, "blend": 0.5}))
    assert np.abs(half[..., :3].astype(int) - 128).max() <= 1
    flat = np.full((6, 6, 4), 200, np.uint8)
    flat[..., 3] = 255
    assert (through(flat, ("smooth_halos", {}), ("smooth_blocks", {}), ("smooth_color", {})) == flat).all()


def test_regions_strokes_and_objects():
    image = picture()
    cut = through(image, ("polygon_edit", {"regions": [{"points": [(0, 0), (10, 0), (10, 10), (0, 10)]}]}))
    assert (cut[:10, :10, 3] == 0).all() and cut[11, 11, 3] == 255
    later = through(
        image,
        ("polygon_edit", {"regions": [{"points": [(0, 0), (10, 0), (10, 10), (0, 10)]}, {"points": [(0, 0), (4, 0), (4, 4), (0, 4)], "mode": "add"}]})
    )
    assert later[1, 1, 3] == 255 and later[8, 8, 3] == 0
    brushed = through(image, ("brush_edit", {"strokes": [{"points": [(20, 20), (24, 20)], "radius": 3}]}))
    assert (brushed[20, 18:27, 3] == 0).all() and brushed[20, 30, 3] == 255
    small = through(image, MATTE, ("remove_minimum_area", {"size": 8}))
    assert small[35, 7, 3] == 0 and small[12, 12, 3] == 255
    gone = through(image, MATTE, ("exclude_tiles", {"picks": [{"point": (12, 12)}]}))
    left = through(image, MATTE, ("exclude_tiles", {"picks": [{"point": (12, 12)}], "mode": "include"}))
    assert gone[12, 12, 3] == 0 and gone[25, 33, 3] == 255 and left[12, 12, 3] == 255 and left[25, 33, 3] == 0
    holed = image.copy()
    holed[12, 12, 3] = 0
    holed[0, 5, 3] = 0
    filled = through(holed, ("fill_pinholes", {"max_area": 1}))
    assert filled[12, 12].tolist() == [200, 30, 30, 255] and filled[0, 5, 3] == 0
    lined = np.zeros((20, 20, 4), np.uint8)
    lined[3, 2:18], lined[8:16, 5:12] = 255, 255
    kept = through(lined, ("remove_lines", {"thickness": 1}))
    assert (kept[3, :, 3] == 0).all() and (kept[8:16, 5:12, 3] == 255).all()
    picked = through(image, ("island_picker", {"islands": [{"picks": [{"point": (33, 25), "color_tolerance": 0.05}]}]}))
    assert picked[25, 33, 3] == 0 and picked[12, 12, 3] == 255


def test_model_segmentation_keeps_the_subject():
    out = through(picture(), ("neural_remove_background", {"model": lambda a: np.where(a[..., :3].min(-1) < 100, 255, 0)}))
    assert out[12, 12, 3] == 255 and out[0, 0, 3] == 0


def test_settings_round_trip_and_migration():
    records = [{"id": k, "enabled": i % 2 == 0, "settings": v.settings({})} for i, (k, v) in enumerate(STAGES.items())]
    text = documents.encode_stack(records)
    back, warnings = documents.decode_stack(text)
    assert not warnings and [r["id"] for r in back] == list(STAGES) and documents.encode_stack(back) == text
    back, warnings = documents.decode_stack('{"version": 2, "stack": [{"id": "nothing"}, {"id": "posterize", "settings": {"levels": 99, "colors": "x", "strength": -3}}]}')
    assert warnings == ["unknown operation"] and back[0]["settings"]["levels"] == 32 and back[0]["settings"]["colors"] == 16 and back[0]["settings"]["strength"] == 0
    old = lambda block: {r["id"]: r["settings"] for r in documents.decode_stack(json.dumps({"version": 1, "operations": {"remove_background": block}}))[0]}
    assert list(old({})) == ["remove_background", "edge_cleanup"] and old({})["edge_cleanup"] == STAGES["edge_cleanup"].settings({})
    some = old({"edge_width": 5, "crevice_reach": 2, "polygons": {"regions": [{"points": [[0, 0], [1, 0], [1, 1]]}]}, "islands": {"entries": [{"picks": []}]}, "alpha_floor": 0.2, "edge_cleanup": False, "refine_radius": 7})
    assert list(some) == ["polygon_edit", "remove_background", "island_picker", "remove_crevice", "refine_edges"]
    assert some["remove_background"]["edge_width"] == some["island_picker"]["edge_width"] == 5 and some["remove_crevice"] == {"reach": 2, "tolerance": 0.5}
    assert some["refine_edges"] == {"radius": 0, "floor": 0.2, "ceiling": 1.0} and old({"refine_edges": True})["refine_edges"]["radius"] == 2
    assert "refine_edges" in old({"alpha_ceiling": 0.5}) and old({"inner_stroke_width": 2, "auto_stroke_color": True})["edge_cleanup"]["inner"] == 2
    assert [r["id"] for r in documents.decode_stack('{"version": 1}')[0]] == ["remove_background", "edge_cleanup"]
    assert documents.decode_stack('{"version": 1, "operations": 3}')[0] == []
    assert documents.decode_stack('{"version": 3}') == ([], ["newer version"]) and documents.decode_stack("x")[0] == []
    assert STAGES["random_hsv_tiles"].settings({"hue": (0.4, -0.9)})["hue"] == (-0.5, 0.4)


def packing_model(sizes, method, width, height):
    """Places on one sheet by plain search over cells that are taken: None from the first that does not fit on."""
    order = [i for i, s in enumerate(sizes) if min(s) > 0]
    if method in ("shelf", "tight"):
        order.sort(key=lambda i: (-sizes[i][1], -sizes[i][0], i))
    places, rows, tops = [None] * len(sizes), [], [0] * width
    for i in order:
        w, h = sizes[i]
        if w > width:
            return places
        if method == "tight":
            y, x = min((max(tops[x : x + w]), x) for x in range(width - w + 1))
        else:
            if not rows or rows[-1][1] + w > width:
                rows.append([sum(r[2] for r in rows), 0, 0])
            y, x = rows[-1][0], rows[-1][1]
        if y + h > height:
            return places
        if method == "tight":
            tops[x : x + w] = [y + h] * w
        else:
            rows[-1][1:] = [x + w, max(rows[-1][2], h)]
        places[i] = (x, y)
    return places


@pytest.mark.parametrize("method", ["shelf", "original", "tight"])
def test_packing_is_the_model(method):
    for _ in range(60):
        sizes = [(int(w), int(h)) for w, h in RNG.integers(0, 9, (int(RNG.integers(1, 25)), 2))]
        width, height = int(RNG.integers(1, 30)), int(RNG.integers(1, 30))
        assert packing.METHODS[method](sizes, width, height) == packing_model(sizes, method, width, height)
        padding = int(RNG.integers(0, 4))
        places, w, h = packing.place(sizes, method, width, height, padding)
        padded = [(a + padding, b + padding) if min(a, b) > 0 else (a, b) for a, b in sizes]
        assert places == [p and (p[0] + padding, p[1] + padding) for p in packing_model(padded, method, max(w - padding, 0), max(h - padding, 0))]
        assert all((p is None) == (min(s) == 0) for p, s in zip(places, sizes, strict=True))
        smaller = (w // 2, h) if w > width and (w // width > h // height or h == height) else (w, h // 2)
        if (w, h) != (width, height):
            tried = packing_model(padded, method, max(smaller[0] - padding, 0), max(smaller[1] - padding, 0))
            assert sum(p is not None for p in tried) < sum(min(s) > 0 for s in sizes)


def test_padding_stands_once_between_sprites():
    assert packing.place([(10, 10), (10, 10)], "shelf", 64, 64, 2)[0] == [(2, 2), (14, 2)]
    assert packing.place(
        [(9000, 5), (9000, 5)], "original", 10_000, 4
    )[1:] == (16_384, 16) and packing.place([(10, 10), (0, 4)], "tight", 16, 16)[1:] == (16, 16)


@pytest.mark.parametrize("method", sorted(packing.METHODS))
def test_packing_places_all_apart(method):
    sizes = [(int(w), int(h)) for w, h in RNG.integers(3, 20, (60, 2))]
    places, w, h = packing.place(sizes, method, 32, 32, padding=1)
    used = np.zeros((h, w), int)
    for (x, y), (a, b) in zip(places, sizes, strict=True):
        assert x >= 1 and y >= 1 and x + a < w + 1 and y + b < h + 1
        used[y : y + b, x : x + a] += 1
    assert used.max() == 1
    assert packing.place([(40, 40)], method, 16, 16, expand=False)[0] == [None]


def test_normals():
    sprite = picture()
    sprite[..., 3] = np.where(sprite[..., :3].min(-1) < 200, 255, 0)
    shape = normals.from_shape(sprite)
    assert (shape[0, 0] == normals.FLAT).all() and shape[12, 5, 0] < 128 < shape[12, 19, 0]
    base = normals.normal_map(sprite, [{"kind": "round_edges"}], clean=False)
    mixed = normals.combined(base[..., :3], normals.from_brightness(sprite), "slope", 0.0)
    assert np.abs(mixed.astype(int) - base[..., :3]).max() <= 1
    flipped = normals.normal_map(sprite, [{"kind": "round_edges"}], clean=False, flip_green=True)
    assert (flipped[..., 1].astype(int) == 255 - base[..., 1]).all()
    assert (normals.normal_map(sprite, [{"kind": "brightness"}, {"kind": "color_regions", "combine": "reoriented"}])[..., 3] == sprite[..., 3]).all()


def test_png_and_models():
    image = RNG.integers(0, 256, (5, 7, 4), np.uint8)
    assert decode_png(encode_png(7, 5, image.tobytes())) == (7, 5, image.tobytes())
    with pytest.raises(ValueError):
        decode_png(b"GIF89a")
    assert models.upscaled(image, 4).shape == (20, 28, 4) and (models.sharpened(image, 0) == image).all()
    assert (models.upscaled(image, 2, tta=True) == models.doubled(image)).all()
    parts = [(t, np.ones((t[2], t[3], 3))) for t in models.tiles(300, 500)]
    assert np.allclose(models.blended(parts, 300, 500), 1.0)
    assert '"CheckpointLoaderSimple"' in models.generation_graph("m", "p", width=515, loras=(("l", 1.0),), clip_skip=2)
