"""Stack operations and normal maps against plain models, pixel by pixel, on small random rasters."""

import math
from collections import deque

import numpy as np

from pixelstrata.functions.canvas import BACKGROUND, CLEAR, EDGE, NONE, SUBJECT, Canvas
from pixelstrata.functions.floods import grassfire
from pixelstrata.operators import normals, palette, stages
from pixelstrata.sources.files import SIGNATURE, decode_png

RNG = np.random.default_rng(11)
F32 = lambda v: float(np.float32(v))
BYTE = lambda v: int(math.floor(min(max(v, 0.0), 1.0) * 255.0 + 0.5))


def canvas(h=None, w=None, colours=4, clear=0.1):
    h, w = h or int(RNG.integers(1, 10)), w or int(RNG.integers(1, 10))
    data = np.full((h * w, 4), 255, np.uint8)
    data[:, :3] = RNG.integers(0, 256, (colours, 3))[RNG.integers(0, colours, h * w)]
    data[:, 3] = RNG.choice([255, 255, 200, 60, 0], h * w, p=[0.5, 0.2, 0.1, 0.2 - clear, clear])
    return Canvas(w, h, data.tobytes())


def beside(i, h, w, eight=True):
    y, x = divmod(i, w)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    return [(y + a) * w + x + b for a, b in steps if 0 <= y + a < h and 0 <= x + b < w]


def labels(alpha, h, w, fringe=None, strays=False):
    """Objects: solid pixels joined eight ways in order, then what is visible around them (fringe steps at most), then the rest."""
    label, depth, queue, n = [-1] * (h * w), [0] * (h * w), deque(), 0
    grown = deque()

    def flood(start, ok):
        nonlocal n
        label[start] = n
        queue.append(start)
        while queue:
            i = queue.popleft()
            grown.append(i)
            for k in beside(i, h, w):
                if label[k] < 0 and ok(alpha[k]):
                    label[k] = n
                    queue.append(k)
        n += 1

    for i in range(h * w):
        if label[i] < 0 and alpha[i] >= 0.5:
            flood(i, lambda a: a >= 0.5)
    while grown:
        i = grown.popleft()
        if fringe is None or depth[i] < fringe:
            for k in beside(i, h, w):
                if label[k] < 0 and alpha[k] > 0:
                    label[k], depth[k] = label[i], depth[i] + 1
                    grown.append(k)
    if strays:
        for i in range(h * w):
            if label[i] < 0 and alpha[i] > 0:
                flood(i, lambda a: a > 0)
    return label, n


def test_minimum_area():
    taken = 0
    for _ in range(150):
        c = canvas(clear=0.15)
        alpha, size = c.alpha().tolist(), int(RNG.integers(1, 4))
        label, n = labels(alpha, c.h, c.w, fringe=2, strays=True)
        area = [sum(a for a, k in zip(alpha, label, strict=True) if k == m) for m in range(n)]
        doomed = {m for m in range(n) if area[m] <= size * size}
        gone = {i for i in range(c.n) if label[i] in doomed}
        gone |= {k for i in list(gone) for k in beside(i, c.h, c.w) if label[k] < 0 or label[k] in doomed}
        stages.remove_minimum_area(c, {"size": size})
        assert [a == 0 for a in c.data[:, 3].tolist()] == [i in gone or a == 0 for i, a in enumerate(alpha)]
        assert len(c.reports) == len(doomed)
        taken += len(gone)
    assert taken


def test_exclude_tiles():
    for _ in range(150):
        c = canvas(int(RNG.integers(4, 14)), int(RNG.integers(4, 14)), clear=0.2)
        c.data[RNG.random(c.n) < 0.7, 3] = 0
        alpha = c.alpha().tolist()
        label, n = labels(alpha, c.h, c.w)
        boxes = []
        for m in range(n):
            cells = [divmod(i, c.w) for i in range(c.n) if label[i] == m]
            ys, xs = [y for y, _ in cells], [x for _, x in cells]
            boxes.append([max(min(xs) - 1, 0), max(min(ys) - 1, 0), min(max(xs) + 1, c.w - 1), min(max(ys) + 1, c.h - 1)])
        meets = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
        while pair := next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if meets(boxes[i], boxes[j])), None):
            a, b = boxes[pair[0]], boxes.pop(pair[1])
            a[:] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
        picks = [(int(RNG.integers(-2, c.w + 2)), int(RNG.integers(-2, c.h + 2))) for _ in range(2)]
        mode = str(RNG.choice(["exclude", "include"]))
        hit = {k for x, y in picks for k, t in enumerate(boxes) if t[0] <= x <= t[2] and t[1] <= y <= t[3]}
        gone = {y * c.w + x for k, t in enumerate(boxes) if (k in hit) == (mode == "exclude") for y in range(t[1], t[3] + 1) for x in range(t[0], t[2] + 1)}
        stages.exclude_tiles(c, {"picks": [{"point": p} for p in picks], "mode": mode})
        assert [a == 0 for a in c.data[:, 3].tolist()] == [i in gone or a == 0 for i, a in enumerate(alpha)]


def mixed64(x):
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def turned(rgb, turn, sat, val):
    """One colour in 0..1 with its hue turned, saturation and value scaled."""
    high, low = max(rgb), min(rgb)
    span, (r, g, b) = high - low, rgb
    hue = 0.0 if span <= 0 else ((g - b) / span if high == r else 2 + (b - r) / span if high == g else 4 + (r - g) / span) / 6
    hue = (hue + 1 if hue < 0 else hue) + turn
    hue -= math.floor(hue)
    s, v = min(max((span / high if high > 0 else 0) * sat, 0), 1), min(max(high * val, 0), 1)
    k, t = int(hue * 6) % 6, hue * 6 - math.floor(hue * 6)
    lo, fa, ri = v * (1 - s), v * (1 - s * t), v * (1 - s * (1 - t))
    return (v, v, v) if s <= 0 else [(v, ri, lo), (fa, v, lo), (lo, v, ri), (lo, fa, v), (ri, lo, v), (v, lo, fa)][k]


def test_random_hsv_tiles():
    for _ in range(60):
        c = canvas(clear=0.2)
        before, alpha, seed = c.data.copy(), c.alpha().tolist(), int(RNG.integers(0, 1_000_000))
        label, _ = labels(alpha, c.h, c.w)
        spans = {"hue": (-0.5, 0.5), "saturation": (0.5, 1.5), "value": (0.2, 2.0)}
        stages.random_hsv_tiles(c, {"seed": seed, **spans, "colorize": (0, 0)})
        root = mixed64(seed)
        for i in range(c.n):
            want = before[i, :3].tolist()
            if label[i] >= 0:
                draws = [(mixed64((root + 3 * label[i] + j) & ((1 << 64) - 1)) >> 11) * 2.0**-53 for j in range(3)]
                turn, sat, val = (lo + (hi - lo) * d for (lo, hi), d in zip(spans.values(), draws, strict=True))
                want = [BYTE(v) for v in turned([v * (1 / 255) for v in want], turn, sat, val)]
            assert c.data[i, :3].tolist() == want


def composed(c, i):
    """One pixel of the finished image."""
    unit = 1.0 / 255.0
    rgb, alpha = [c.data[i, j] * unit for j in range(3)], float(c.coverage[i])
    near = int(c.nearest[i])
    bled = [c.data[near, j] * unit for j in range(3)]
    key = c.keys[c.key_of[i]][0] if 0 <= c.key_of[i] < len(c.keys) else c.keys[0][0]
    if alpha <= 0:
        alpha = 0.0
        if c.bleed > 0 and near >= 0:
            rgb = bled
    elif alpha < 1 and c.decontaminate:
        pure = [min(max((v - (1 - alpha) * k) * (1 / alpha), 0.0), 1.0) for v, k in zip(rgb, key, strict=True)]
        rgb = [b + (p - b) * (alpha / 0.25) for b, p in zip(bled, pure, strict=True)] if alpha < 0.25 and near >= 0 else pure
    paint = c.stroke
    if c.inner is not None and c.inner[i] > 0:
        rgb = [v + (p - v) * c.inner[i] for v, p in zip(rgb, paint, strict=True)]
    seen = 1.0 if c.force[i] else min(max(c.data[i, 3] * unit * alpha, 0.0), 1.0)
    if c.outer is not None and c.outer[i] > 0:
        share = c.outer[i] * (1 - seen)
        if seen + share > 1e-4:
            rgb = [(v * seen + p * share) / (seen + share) for v, p in zip(rgb, paint, strict=True)]
        seen = seen + share
    return [BYTE(v) for v in (*rgb, seen)]


def test_compose():
    for n in range(80):
        c = canvas()
        c.add_key([1.0, 1.0, 1.0], 0.1)
        c.add_key(RNG.random(3), 0.2)
        c.coverage = stages.stored(RNG.choice([0.0, 0.1, 0.2, 0.6, 1.0], c.n))
        c.key_of, c.nearest = RNG.integers(-2, 3, c.n), RNG.integers(-1, c.n, c.n)
        c.mask = np.full(c.n, SUBJECT, np.uint8)
        c.bleed, c.decontaminate, c.stroke = int(RNG.integers(0, 2)), bool(n % 3), stages.stored(RNG.random(3))
        c.inner, c.outer = (stages.stored(RNG.choice([0.0, 0.3, 1.0], c.n)) if RNG.random() < 0.6 else None for _ in "io")
        c.force = (RNG.random(c.n) < 0.2).astype(np.uint8)
        assert c.compose().tolist() == [composed(c, i) for i in range(c.n)]


def test_coverage_of_edges():
    """An edge's coverage is how far it is from its key against the nearest subject's distance, both less the key's tolerance."""
    for _ in range(60):
        c = canvas()
        c.add_key([1.0, 1.0, 1.0], 0.05)
        c.add_key(RNG.random(3), 0.1)
        c.mask, c.key_of = RNG.choice([SUBJECT, BACKGROUND, EDGE], c.n).astype(np.uint8), RNG.integers(-1, 2, c.n)
        c.nearest, c.edge_width = RNG.integers(-1, c.n, c.n), 2
        c.cover(np.arange(c.n))
        rgb = c.data[:, :3] * (1.0 / 255.0)
        far = lambda i, k: (F32 if k == 0 else float)(np.abs(rgb[i] - c.keys[k][0]).max())  # noqa: E731, B023
        for i in range(c.n):
            k = int(c.key_of[i])
            want = 0.0 if c.mask[i] == BACKGROUND else 1.0
            if c.mask[i] == EDGE and k >= 0:
                y, x = divmod(i, c.w)
                square = [v * c.w + u for v in range(max(y - 2, 0), min(y + 3, c.h)) for u in range(max(x - 2, 0), min(x + 3, c.w))]
                top = far(int(c.nearest[i]), k) if c.nearest[i] >= 0 else max(float(np.abs(rgb[j] - c.keys[k][0]).max()) for j in square)
                slack = c.keys[k][1]
                want = min(max((far(i, k) - slack) / max(top - slack, 1e-4), 0.0), 1.0) if far(i, k) > slack else 0.0
            assert abs(c.coverage[i] - F32(want)) < 1e-6


def restored(c):
    """Coverage with its hard steps softened, pixel by pixel."""
    out, unit = c.coverage.tolist(), 1.0 / 255.0
    rgb, cover = c.data[:, :3] * unit, c.coverage.tolist()
    shown = lambda i: c.data[i, 3] * unit * cover[i]
    for i in range(c.n):
        solid = cover[i] >= 0.995
        if not solid and cover[i] > 0.005:
            continue
        y, x = divmod(i, c.w)
        sides = [(y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)]
        inside = [v * c.w + u for v, u in sides if 0 <= v < c.h and 0 <= u < c.w]
        face = next((j for j in inside if (cover[j] <= 0.005 if solid else cover[j] >= 0.995)), None)
        if face is None or shown(i if solid else face) < 0.5:
            continue
        own = int(c.key_of[face]) if c.key_of[face] >= 0 else int(c.key_of[i])
        key = c.keys[own if 0 <= own < len(c.keys) else 0][0]
        dx = sum((j % c.w - x) * cover[j] for j in beside(i, c.h, c.w))
        dy = sum((j // c.w - y) * cover[j] for j in beside(i, c.h, c.w))
        length, subject = math.sqrt(dx * dx + dy * dy), -1
        if length > 1e-4:
            for step in (1, 2):
                v, u = (n + int(math.copysign(math.floor(abs(d / length * step) + 0.5), d)) for n, d in ((y, dy), (x, dx)))
                if not (0 <= v < c.h and 0 <= u < c.w) or cover[v * c.w + u] < 0.995:
                    break
                subject = v * c.w + u
        if subject < 0:
            subject = int(c.nearest[i])
        if subject < 0 or len(beside(subject, c.h, c.w)) < 8 or min(shown(j) for j in (subject, *beside(subject, c.h, c.w))) < 0.9:
            continue
        top = float(np.abs(rgb[subject] - key).max())
        if top > 1e-4:
            out[i] = F32(min(max(float(np.abs(rgb[i] - key).max()) / top, 0.0), 1.0))
    return out


def test_edges_are_restored():
    changed = 0
    for _ in range(200):
        c = canvas(int(RNG.integers(5, 12)), int(RNG.integers(5, 12)), clear=0.0)
        c.data[:, 3] = np.where(RNG.random(c.n) < 0.95, 255, 100)
        c.add_key(RNG.random(3), 0.1)
        c.add_key(RNG.random(3), 0.1)
        y, x = np.divmod(np.arange(c.n), c.w)
        c.coverage = np.where(x + y < int(RNG.integers(2, 10)), 0.0, 1.0)
        c.coverage[RNG.random(c.n) < 0.05] = 0.4
        c.key_of, c.nearest = RNG.integers(-1, 2, c.n), RNG.integers(-1, c.n, c.n)
        want = restored(c)
        changed += sum(a != b for a, b in zip(want, c.coverage.tolist(), strict=True))
        assert np.allclose(stages._restored(c), want, atol=1e-6)
    assert changed > 50


def test_stroke_bands():
    for _ in range(120):
        h, w = int(RNG.integers(1, 9)), int(RNG.integers(1, 9))
        alpha = stages.stored(RNG.choice([0.0, 0.3, 0.7, 1.0], h * w))
        width, feather, strength = float(RNG.choice([0.5, 1.0, 2.5])), float(RNG.choice([0.0, 1.5])), 0.8
        fade = lambda d: (1.0 if d <= width else 0.0) if feather <= 1e-4 else min(max((width + feather / 2 - d) / feather, 0.0), 1.0)  # noqa: E731, B023
        for inside in (True, False):
            seeds = [i for i in range(h * w) if (alpha[i] >= 0.5) != inside]
            near = grassfire(np.array(seeds, np.int64), h, w, math.ceil(width + feather / 2) + 1).tolist() if 0 < len(seeds) < h * w else None
            want = [0.0] * (h * w)
            for i in range(h * w) if inside or near else []:
                y, x = divmod(i, w)
                if (alpha[i] <= 0) if inside else (alpha[i] >= 1):
                    continue
                gap = math.dist((y, x), divmod(near[i], w)) if near and near[i] >= 0 else None
                if inside:
                    d = min(x, y, w - 1 - x, h - 1 - y) + 0.5
                    d = min(d, alpha[i] - 0.5) if alpha[i] < 0.5 else d if gap is None else min(d, gap + alpha[near[i]] - 0.5)
                elif alpha[i] >= 0.5:
                    d = 0.5 - alpha[i]
                elif gap is None:
                    continue
                else:
                    d = gap - (alpha[near[i]] - 0.5)
                want[i] = F32(fade(d) * strength)
            got = stages._band(alpha, h, w, width, feather, strength, inside)
            assert (got is None) == (not any(want)) and (got is None or np.allclose(got, want, atol=1e-6))


def test_crevices_are_the_queue():
    taken = 0
    for _ in range(200):
        c = canvas(colours=5)
        c.add_key(c.data[0, :3] / 255.0, 0.05)
        c.add_key(RNG.random(3), 0.2)
        c.mask, c.key_of = np.full(c.n, SUBJECT, np.uint8), np.full(c.n, NONE, np.int64)
        start = np.flatnonzero(RNG.random(c.n) < 0.3)
        c.mask[start], c.key_of[start] = BACKGROUND, RNG.integers(0, 2, len(start))
        c.coverage, c.edge_width, c.search = np.ones(c.n), 0, 2
        reach, slack = int(RNG.integers(1, 4)), 0.3
        mask, key, weak = c.mask.tolist(), c.key_of.tolist(), [0] * c.n
        rgb = c.data[:, :3] * (1.0 / 255.0)
        far = lambda i, k: (F32 if k == 0 else float)(np.abs(rgb[i] - c.keys[k][0]).max())  # noqa: E731, B023
        queue, queued, touched = deque(start.tolist()), set(start.tolist()), []
        while queue:
            i = queue.popleft()
            if key[i] < 0:
                continue
            y, x = divmod(i, c.w)
            for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
                j = v * c.w + u
                if not (0 <= v < c.h and 0 <= u < c.w) or j in queued or mask[j] == BACKGROUND:
                    continue
                claim, step = next((k for k in (0, 1) if far(j, k) <= c.keys[k][1]), -1), weak[i]
                if c.data[j, 3] == 0:
                    took = CLEAR
                elif far(j, key[i]) <= c.keys[key[i]][1]:
                    took = key[i]
                elif claim >= 0:
                    took = claim
                elif weak[i] < reach and far(j, key[i]) <= c.keys[key[i]][1] + slack:
                    took, step = key[i], weak[i] + 1
                else:
                    continue
                queued.add(j)
                mask[j], key[j], weak[j] = BACKGROUND, took, step
                touched.append(j)
                queue.append(j)
        for j in touched:
            if weak[j] > 0 and key[j] >= 0:
                mask[j] = EDGE
        stages.remove_crevice(c, {"reach": reach, "tolerance": slack})
        assert c.mask.tolist() == mask and c.key_of.tolist() == key
        taken += len(touched)
    assert taken


def packed(dx, dy):
    v = (-dx, dy, 1.0)
    length = math.sqrt(sum(a * a for a in v))
    return [BYTE(a / length * 0.5 + 0.5) for a in v]


def test_shape_normals():
    for n in range(60):
        c = canvas(int(RNG.integers(1, 9)), int(RNG.integers(1, 9)), clear=0.2)
        sprite, h, w = c.grid(c.data), c.h, c.w
        roll, tolerance = int(RNG.integers(1, 5)), [None, 0.15][n % 2]
        solid = lambda y, x: 0 <= y < h and 0 <= x < w and sprite[y, x, 3] >= 128  # noqa: E731, B023
        cells = [(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1)]
        seeds = [p for p in cells if not solid(*p)]
        if tolerance is not None:
            gap = lambda a, b: max(abs(int(sprite[a][j]) - int(sprite[b][j])) for j in range(3)) / 255.0  # noqa: E731, B023
            seeds += [
                (y, x) for y,
                x in cells if solid(y, x) and any(
                    solid(y + a, x + b) and gap((y, x), (y + a, x + b)) > tolerance for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))
                )
            ]
        number = {p: i for i, p in enumerate(cells)}
        near = grassfire(np.array([number[p] for p in seeds], np.int64), h + 2, w + 2, roll).tolist()
        high = {}
        for p in cells:
            d = math.dist(p, cells[near[number[p]]]) if near[number[p]] >= 0 else roll
            t = min(d / roll, 1.0)
            high[p] = F32(0.5 * roll * math.sqrt(1 - (1 - t) ** 2)) if solid(*p) else 0.0
        mean = {}
        for y, x in cells:
            area = [high[q] for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in high]
            mean[y, x] = F32(sum(area) / len(area))
        got = normals.from_shape(sprite, roll, "round", 0.5, tolerance)
        for y in range(h):
            for x in range(w):
                want = packed((mean[y, x + 1] - mean[y, x - 1]) * 0.5, (mean[y + 1, x] - mean[y - 1, x]) * 0.5)
                assert np.abs(got[y, x].astype(int) - want).max() <= 1


def test_brightness_normals_equal_windows(spark):
    from pixelstrata.operators import pixels
    from pixelstrata.sources import rasters

    rows = []
    for i in range(4):
        c = canvas(7, 6, colours=9, clear=0.1)
        rows.append((i, 6, 7, c.data.tobytes()))
    rows.append((4, 6, 7, bytes(6 * 7 * 4)))
    images = spark.createDataFrame(rows, rasters.PACKED)
    got = {}
    for r in pixels.brightness_normals(rasters.unpacked(images), 4.0, 2, 3.0).collect():
        got[r.image_id, r.y, r.x] = (r.nx, r.ny, r.nz)
    for i, w, h, data in rows:
        sprite = np.frombuffer(data, np.uint8).reshape(h, w, 4)
        want = normals.from_brightness(sprite, 4.0, 2, 3.0)
        for y in range(h):
            for x in range(w):
                expected = want[y, x].tolist() if sprite[y, x, 3] else [128, 128, 255]
                assert max(abs(a - b) for a, b in zip(got[i, y, x], expected, strict=True)) <= 1


def test_rims_take_the_normal_inside():
    for _ in range(80):
        h, w, reach = int(RNG.integers(1, 10)), int(RNG.integers(1, 10)), int(RNG.integers(1, 3))
        normal, alpha = RNG.integers(0, 256, (h, w, 3)).astype(np.uint8), np.where(RNG.random((h, w)) < 0.85, 255, 0)
        cells = [(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1)]
        solid = [0 <= y < h and 0 <= x < w and alpha[y, x] >= 128 for y, x in cells]
        rim = grassfire(np.array([i for i, s in enumerate(solid) if not s], np.int64), h + 2, w + 2, reach)
        inner = [i for i, s in enumerate(solid) if s and rim[i] < 0]
        near = grassfire(np.array(inner, np.int64), h + 2, w + 2, 2 * reach) if inner else np.full(len(cells), -1)
        want = normal.copy()
        for i, (y, x) in enumerate(cells):
            if solid[i] and rim[i] >= 0 and near[i] >= 0:
                want[y, x] = normal[cells[near[i]]]
        assert (normals.cleaned(normal, alpha, reach) == want).all()


def test_best_colours_are_variance_cuts():
    """Boxes of the colour cube, cut where the two halves' square sums over counts are greatest, by plain sums over pixels."""
    for _ in range(12):
        rgb = RNG.integers(0, 256, (int(RNG.integers(1, 40)), 3))
        wanted = int(RNG.integers(2, 7))
        within = lambda box: rgb[np.all([(rgb[:, j] >> 3 >= box[j][0]) & (rgb[:, j] >> 3 < box[j][1]) for j in range(3)], 0)].astype(float)  # noqa: E731, B023
        gain = lambda p: float((p.sum(0) ** 2).sum() / len(p))
        boxes, left, at = [[(0, 32)] * 3], [0.0], 0
        while len(boxes) < wanted:
            best = (0.0, None)
            for j in range(3):
                for cut in range(boxes[at][j][0] + 1, boxes[at][j][1]):
                    halves = [[*boxes[at][:j], part, *boxes[at][j + 1 :]] for part in ((boxes[at][j][0], cut), (cut, boxes[at][j][1]))]
                    if all(len(within(x)) for x in halves) and (score := sum(gain(within(x)) for x in halves)) > best[0]:
                        best = (score, halves)
            spread = lambda x: float((within(x) ** 2).sum()) - gain(within(x)) if math.prod(b - a for a, b in x) > 1 else 0.0
            if best[1] is None:
                left[at] = 0.0
            else:
                boxes[at], other = best[1]
                boxes.append(other)
                left[at] = spread(boxes[at])
                left.append(spread(other))
            at = left.index(max(left))
            if left[at] <= 0:
                break
        want = [[math.floor(v + 0.5) for v in within(x).sum(0) * (1 / len(within(x)))] for x in boxes]
        assert palette.best_colours(rgb, wanted).tolist() == want


def test_dithering():
    for n in range(40):
        c = canvas(int(RNG.integers(2, 9)), int(RNG.integers(2, 9)), colours=30, clear=0.15)
        alpha, levels, strength = c.alpha().tolist(), int(RNG.integers(2, 6)), float(RNG.choice([0.5, 1.0]))
        half = lambda v: math.floor(v + 0.5)
        steps = [half(half(v / 255 * (levels - 1)) / (levels - 1) * 255) for v in range(256)]
        want, work = c.data[:, :3].astype(float), np.zeros((c.n, 3))
        for y in range(c.h):
            way = -1 if y % 2 else 1
            for x in range(c.w)[::way]:
                i = y * c.w + x
                if alpha[i] <= 0:
                    continue
                value = want[i] + work[i]
                want[i] = [steps[half(min(max(v, 0), 255))] for v in value]
                for dy, dx, share in ((0, way, 7), (1, -way, 3), (1, 0, 5), (1, way, 1)):
                    v, u = y + dy, x + dx
                    if v < c.h and 0 <= u < c.w and alpha[v * c.w + u] > 0:
                        work[v * c.w + u] += (value - want[i]) * strength * share / 16
        palette.posterize(c, {"palette": "even", "levels": levels, "dither": "floyd", "strength": strength})
        assert c.data[:, :3].tolist() == want.astype(int).tolist()


def test_png_filters():
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    for channels, kind in ((4, 6), (3, 2), (1, 0), (2, 4)):
        h, w = 12, 7
        plain = RNG.integers(0, 256, (h, w * channels)).astype(int)
        lines = b""
        for y in range(h):
            above, line, filter_ = plain[y - 1] if y else np.zeros(w * channels, int), plain[y], y % 5
            left = lambda row, i: int(row[i - channels]) if i >= channels else 0  # noqa: E731, B023
            out = []
            for i in range(w * channels):
                a, b, c = left(line, i), int(above[i]), left(above, i)
                nearest = min((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[2]
                out.append((int(line[i]) - (0, a, b, (a + b) // 2, nearest)[filter_]) % 256)
            lines += bytes([filter_, *out])
        png = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        width, height, data = decode_png(png)
        got = np.frombuffer(data, np.uint8).reshape(h, w, 4)
        want = plain.reshape(h, w, channels)
        assert (width, height) == (w, h) and (got[..., 0] == want[..., 0]).all()
        assert (got[..., 3] == (want[..., -1] if channels in (2, 4) else 255)).all()


def four(i, h, w):
    y, x = divmod(i, w)
    return [v * w + u for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= v < h and 0 <= u < w]


def test_islands_are_taken_by_the_queue():
    taken = 0
    for _ in range(150):
        c = canvas(colours=4)
        picks = [{"point": (int(RNG.integers(0, c.w)), int(RNG.integers(0, c.h))), "color_tolerance": 0.3} for _ in range(3)]
        rgb, alpha = c.data[:, :3] * (1.0 / 255.0), c.data[:, 3].tolist()
        mask, key, keys = [a == 0 for a in alpha], [CLEAR if a == 0 else NONE for a in alpha], []
        gone = set()
        for p in picks:
            seed = p["point"][1] * c.w + p["point"][0]
            if mask[seed]:
                continue
            keys.append(rgb[seed])
            mask[seed], key[seed], queue = True, len(keys) - 1, deque([seed])
            gone.add(seed)
            while queue:
                i = queue.popleft()
                for j in four(i, c.h, c.w):
                    if not mask[j] and key[i] >= 0 and np.abs(rgb[j] - keys[key[i]]).max() <= 0.3:
                        mask[j], key[j] = True, key[i]
                        gone.add(j)
                        queue.append(j)
        stages.island_picker(c, {"islands": [{"picks": picks}], "edge_width": 0})
        if gone:
            assert (c.mask == BACKGROUND).tolist() == mask and c.key_of.tolist() == key
        assert [a == 0 for a in c.data[:, 3].tolist()] == [i in gone or a == 0 for i, a in enumerate(alpha)]
        taken += len(gone)
    assert taken


def test_islands_are_kept_by_the_queue():
    for _ in range(150):
        c = canvas(colours=4)
        picks = [{"point": (int(RNG.integers(0, c.w)), int(RNG.integers(0, c.h))), "color_tolerance": 0.3} for _ in range(3)]
        rgb, kept = c.data[:, :3] * (1.0 / 255.0), set()
        for p in picks:
            seed = p["point"][1] * c.w + p["point"][0]
            if seed in kept:
                continue
            kept.add(seed)
            queue = deque([seed])
            while queue:
                for j in four(queue.popleft(), c.h, c.w):
                    if j not in kept and np.abs(rgb[j] - rgb[seed]).max() <= 0.3:
                        kept.add(j)
                        queue.append(j)
        stages.island_picker(c, {"islands": [{"mode": "add", "picks": picks}], "edge_width": 0})
        assert np.flatnonzero(c.protect).tolist() == sorted(kept)
        assert c.compose()[sorted(kept), 3].tolist() == [255] * len(kept)


def test_segmentation_is_background_from_the_border():
    for n in range(150):
        c = canvas()
        p, contiguous = RNG.integers(0, 256, (c.h, c.w)), bool(n % 2)
        flat = p.ravel()
        want = [2 if c.data[i, 3] == 0 else 1 if flat[i] < 0.5 * 255 else 0 for i in range(c.n)]
        if contiguous:
            rim = [i for i in range(c.n) if want[i] and (i % c.w in (0, c.w - 1) or i // c.w in (0, c.h - 1))]
            reached, queue = set(rim), deque(rim)
            while queue:
                for j in four(queue.popleft(), c.h, c.w):
                    if want[j] and j not in reached:
                        reached.add(j)
                        queue.append(j)
            want = [0 if w == 1 and i not in reached else w for i, w in enumerate(want)]
        ground = [i for i in range(c.n) if want[i] == 1]
        rim = [i for i in ground if any(want[j] == 0 for j in four(i, c.h, c.w))] or ground
        stages.neural_remove_background(
            c,
            {
                "model": lambda a, p=p: p, "matte": "analytic", "threshold": 0.5, "contiguous": contiguous, "edge_width": 2,
                "edge_tolerance": 0.0, "bleed_radius": 4, "decontaminate": True
            }
        )
        if not ground or 0 not in want:
            assert c.mask is None
            continue
        assert np.flatnonzero(c.mask == BACKGROUND).tolist() == [i for i in range(c.n) if want[i]]
        assert np.allclose(c.keys[0][0], c.data[rim, :3].mean(0) / 255.0, atol=1e-6)


def test_refinement_is_the_guided_filter():
    for _ in range(60):
        c = canvas(colours=9)
        c.add_key(RNG.random(3), 0.1)
        c.coverage = stages.stored(RNG.random(c.n))
        h, w, r = c.h, c.w, int(RNG.integers(1, 4))
        guide = [F32(np.abs(c.data[i, :3] * (1.0 / 255.0) - c.keys[0][0]).max()) for i in range(c.n)]
        cover = c.coverage.tolist()

        def mean(values):
            out = []
            for i in range(h * w):
                y, x = divmod(i, w)
                area = [values[v * w + u] for v in range(max(y - r, 0), min(y + r + 1, h)) for u in range(max(x - r, 0), min(x + r + 1, w))]  # noqa: B023
                out.append(F32(sum(area) / len(area)))
            return out

        mg, mc = mean(guide), mean(cover)
        mgg, mgc = mean([F32(g * g) for g in guide]), mean([F32(g * v) for g, v in zip(guide, cover, strict=True)])
        slope = [(d - a * b) / (e - a * a + 1e-6) for a, b, e, d in zip(mg, mc, mgg, mgc, strict=True)]
        ms, mo = mean([F32(s) for s in slope]), mean([F32(b - s * a) for s, a, b in zip(slope, mg, mc, strict=True)])
        q = [min(max(s * g + o, 0.0), 1.0) for s, g, o in zip(ms, guide, mo, strict=True)]
        want = [0.0 if v < 0.5 / 255 else F32(min(max((v - 0.1) / 0.8, 0.0), 1.0)) for v in q]
        stages.refine_edges(c, {"radius": r, "floor": 0.1, "ceiling": 0.9})
        assert np.allclose(c.coverage, want, atol=2e-5)
