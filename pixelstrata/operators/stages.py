"""The stack operations, each a function (canvas, settings) -> None on one image's canvas.

STAGES is the registry: id -> Stage with defaults and bounds. Settings are plain dictionaries; missing ones take the
default, numbers are clamped to their bounds, ranges given backwards are swapped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.canvas import BACKGROUND, CLEAR, CUT, EDGE, KEEP, NONE, SUBJECT, Canvas, _Flood
from ..functions.floods import EIGHT, FOUR, boxes, components, grassfire, islands, neighbours, reachable, spread
from ..functions.pixelmath import GUARD, SOLID, UNIT, box_mean, chebyshev, half_up, hsv_to_rgb, mix, rgb_to_hsv, shift_colours, shifted, splitmix, stored, to_byte, unit_draw
from .palette import posterize

MARGIN = 1


def _widen(c: Canvas, edge: int, bleed: int = 0) -> None:
    c.edge_width, c.bleed = max(c.edge_width, edge), max(c.bleed, bleed)
    c.search = max(c.bleed, c.edge_width, 2)


def _settle(c: Canvas, touched) -> None:
    """Regions again, the nearest subject, and coverage around what changed."""
    c.regions_to_mask()
    c.rebuild_nearest()
    c.cover(c.dilated(np.unique(touched), c.search))


def remove_background(c: Canvas, s: dict) -> None:
    _widen(c, s["edge_width"], s["bleed_radius"])
    c.decontaminate |= s["decontaminate"]
    for entry in s["remove_colors"]:
        if entry.get("enabled", True):
            for sample in entry["samples"]:
                c.add_key(sample["color"][:3], sample["color_tolerance"])
    if not c.keys:
        return
    c.classify(s["contiguous"], s["edge_width"])
    c.regions_to_mask()
    c.rebuild_nearest()
    c.cover(np.arange(c.n))


def bilinear(p, h, w):
    """A probability map at another size, sampled at pixel centres."""
    ph, pw = p.shape
    if (ph, pw) == (h, w):
        return p
    y, x = np.clip((np.arange(h) + 0.5) * ph / h - 0.5, 0, ph - 1), np.clip((np.arange(w) + 0.5) * pw / w - 0.5, 0, pw - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, ph - 1), np.minimum(x0 + 1, pw - 1), (y - y0)[:, None], x - x0
    top, low = mix(p[y0][:, x0], p[y0][:, x1], fx), mix(p[y1][:, x0], p[y1][:, x1], fx)
    return np.floor(mix(top, low, fy) + 0.5)


def neural_remove_background(c: Canvas, s: dict) -> None:
    """model: rgba (h, w, 4) -> byte probabilities of subject at any size; without a model nothing happens."""
    if s["model"] is None:
        return
    p = bilinear(np.asarray(s["model"](c.grid(c.data)), np.float64), c.h, c.w).ravel()
    if s["matte"] == "network":
        c.coverage = stored(p * UNIT)
        return
    width = s["edge_width"] + -(-max(c.w, c.h) // 1024)
    _widen(c, width, s["bleed_radius"])
    c.decontaminate |= s["decontaminate"]
    clear = c.data[:, 3] == 0
    away = clear | (p < s["threshold"] * 255.0)
    if s["contiguous"]:
        grid = np.arange(c.n).reshape(c.h, c.w)
        border = np.unique(np.concatenate([grid[0], grid[-1], grid[:, 0], grid[:, -1]]))
        away = clear | reachable(away, border[away[border]], c.h, c.w)
    ground = away & ~clear
    if away.all() or not ground.any():
        return
    subject = c.grid(~away)
    beside = np.zeros_like(subject)
    for dy, dx in FOUR:
        beside |= shifted(subject, dy, dx, False)
    rim = ground & beside.ravel()
    colour = c.data[rim if rim.any() else ground, :3].mean(0) / 255.0
    key = c.add_key(colour, s["edge_tolerance"], True)
    if c.mask is None:
        c.mask, c.key_of = np.full(c.n, SUBJECT, np.uint8), np.full(c.n, NONE, np.int64)
    left = c.mask != BACKGROUND
    took = np.flatnonzero(left & ground)
    c.key_of[left & clear], c.mask[left & clear] = CLEAR, BACKGROUND
    c.mask[took], c.key_of[took] = BACKGROUND, key
    c.grow_edges(took, width)
    c.regions_to_mask()
    c.rebuild_nearest()
    c.cover(np.arange(c.n))


def island_picker(c: Canvas, s: dict) -> None:
    _widen(c, s["edge_width"])
    live = [(e, k) for e in s["islands"] if e.get("enabled", True) for k in e["picks"] if 0 <= k["point"][0] < c.w and 0 <= k["point"][1] < c.h]
    at = lambda k: k["point"][1] * c.w + k["point"][0]
    touched = [np.zeros(0, np.int64)]
    removing = [k for e, k in live if e.get("mode", "subtract") == "subtract"]
    if removing:
        if c.mask is None:
            c.classify(True, 0)
        taken, steps = [], np.zeros(c.n, np.int64)
        for k in removing:
            seed = at(k)
            if c.mask[seed] != BACKGROUND:
                c.mask[seed], c.key_of[seed] = BACKGROUND, c.add_key(c.rgb[seed], k.get("color_tolerance", 0.2), True)
                more, steps = c.flood(np.array([seed]), steps)
                own = np.append(seed, more)
                taken.append(own)
                c.reports.append({"op": "island_picker", "box": _box(own, c.w)})
        if taken:
            taken = np.concatenate(taken)
            if c.reach > 0:
                c.stray(taken, steps)
            c.data[taken[c.mask[taken] == BACKGROUND], 3] = 0
            taken = np.concatenate([taken, c.grow_edges(taken, c.edge_width)])
            c.forget_regions(taken)
            touched.append(taken)
    for k in (k for e, k in live if e.get("mode", "subtract") == "add"):
        seed, protect = at(k), c.ensure("protect")
        near = chebyshev(c.rgb, stored(c.rgb[seed])) <= k.get("color_tolerance", 0.2)
        near[seed] = True
        got = np.flatnonzero(reachable(near & (protect == 0), [seed], c.h, c.w))
        protect[got] = 1
        for name in ("region", "inner", "outer"):
            if getattr(c, name) is not None:
                getattr(c, name)[got] = 0
        touched.append(got)
    touched = np.concatenate(touched)
    if not len(touched):
        return
    if c.mask is not None:
        _settle(c, touched)
    c.regions_to_coverage()


def _box(cells, w) -> tuple[int, int, int, int]:
    y, x = np.divmod(cells, w)
    return int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)


def remove_crevice(c: Canvas, s: dict) -> None:
    c.reach, c.reach_tolerance = s["reach"], s["tolerance"]
    if c.reach <= 0 or c.mask is None or not c.keys:
        return
    strayed = c.ensure("strayed")
    start = np.flatnonzero((c.key_of >= 0) & ((c.mask == BACKGROUND) | (strayed > 0)))

    class Squeeze(_Flood):
        held = np.isin(np.arange(c.n), start)

        def allows(self, parents, cells):
            ok = ~self.held[cells] & (c.key_of[parents] >= 0)
            ok[ok] = super().allows(parents[ok], cells[ok])
            return ok

    steps = np.zeros(c.n, np.int64)
    taken = spread(start, c.h, c.w, Squeeze(c, steps))
    if not len(taken):
        return
    weak = taken[(steps[taken] > 0) & (c.key_of[taken] >= 0)]
    c.mask[weak], strayed[weak] = EDGE, 1
    taken = np.concatenate([taken, c.grow_edges(taken, c.edge_width)])
    for band in (c.inner, c.outer):
        if band is not None:
            band[taken] = 0.0
    _settle(c, taken)


def refine_edges(c: Canvas, s: dict) -> None:
    if not c.keys or c.coverage is None:
        return
    if s["radius"] > 0:
        guide, cover = c.grid(stored(chebyshev(c.rgb, c.keys[0][0]))), c.grid(c.coverage)
        mean = lambda x: box_mean(stored(x), s["radius"])
        mg, mc, mgg, mgc = mean(guide), mean(cover), mean(guide * guide), mean(guide * cover)
        slope = (mgc - mg * mc) / (mgg - mg * mg + 1e-6)
        q = np.clip(mean(slope) * guide + mean(mc - slope * mg), 0.0, 1.0)
        c.coverage = stored(np.where(q < 0.5 / 255.0, 0.0, q)).ravel()
        c.regions_to_coverage()
    if s["floor"] > 0.0 or s["ceiling"] < 1.0:
        c.coverage = stored(np.clip((c.coverage - s["floor"]) / max(s["ceiling"] - s["floor"], GUARD), 0.0, 1.0))


def _restored(c: Canvas):
    """Coverage of hard steps by how far each side's colour is from the key, against the subject behind it."""
    cover, out = c.coverage, c.coverage.copy()
    ruled = np.zeros(c.n, bool) if c.region is None else c.region > 0
    solid = cover >= 0.995
    cells = np.flatnonzero((solid | (cover <= 0.005)) & ~ruled)
    y, x = np.divmod(cells, c.w)
    facing = np.full(len(cells), -1)
    for dy, dx in FOUR[::-1]:
        ny, nx = y + dy, x + dx
        inside = (ny >= 0) & (ny < c.h) & (nx >= 0) & (nx < c.w)
        other = np.where(inside, ny * c.w + nx, 0)
        hit = inside & np.where(solid[cells], cover[other] <= 0.005, cover[other] >= 0.995)
        facing = np.where(hit, other, facing)
    seen = c.data[:, 3] * UNIT * cover
    full = c.grid(seen >= 0.9)
    inner = np.ones_like(full)
    for dy, dx in (*EIGHT, (0, 0)):
        inner &= shifted(full, dy, dx, False)
    inner = inner.ravel()
    grid = c.grid(cover)
    pull = [sum(d[axis] * shifted(grid, *d, 0.0) for d in EIGHT) for axis in (0, 1)]
    i, face = cells[facing >= 0], facing[facing >= 0]
    anchor = np.where(solid[i], i, face)
    forced = np.zeros(len(i), bool) if c.force is None else c.force[anchor] > 0
    fits = ~ruled[face] & (forced | (seen[anchor] >= 0.5))
    i, face = i[fits], face[fits]
    y, x = np.divmod(i, c.w)
    dy, dx = pull[0][y, x], pull[1][y, x]
    length = np.sqrt(dx * dx + dy * dy)
    subject, going = np.full(len(i), -1), length > GUARD
    length = np.where(going, length, 1.0)
    for step in (1, 2):
        sy, sx = y + half_up(dy / length * step).astype(int), x + half_up(dx / length * step).astype(int)
        going = going & (sy >= 0) & (sy < c.h) & (sx >= 0) & (sx < c.w)
        there = np.where(going, sy * c.w + sx, 0)
        going = going & (cover[there] >= 0.995)
        subject = np.where(going, there, subject)
    if c.nearest is not None:
        subject = np.where(subject < 0, c.nearest[i], subject)
    fits = (subject >= 0) & inner[np.maximum(subject, 0)]
    i, face, subject = i[fits], face[fits], subject[fits]
    own = np.full(len(i), NONE) if c.key_of is None else np.where(c.key_of[face] >= 0, c.key_of[face], c.key_of[i])
    keys = np.array([k[0] for k in c.keys] or [np.zeros(3)])
    key = keys[np.where((own >= 0) & (own < len(c.keys)), own, 0)]
    reference = chebyshev(c.rgb[subject], key)
    fits = reference > GUARD
    out[i[fits]] = stored(np.clip(chebyshev(c.rgb[i[fits]], key[fits]) / reference[fits], 0.0, 1.0))
    return out


def _band(alpha, h, w, width, feather, strength, inside):
    """Strength of a line of `width` along the half-alpha contour, inside or outside it; None if nothing is painted."""
    seeds = np.flatnonzero((alpha >= SOLID) != inside)
    near = np.full(h * w, -1)
    if 0 < len(seeds) < h * w:
        near = grassfire(seeds, h, w, int(np.ceil(width + feather * 0.5)) + 1)
    elif not inside:
        return None
    y, x = np.divmod(np.arange(h * w), w)
    sy, sx = np.divmod(np.maximum(near, 0), w)
    span = np.sqrt((x - sx) ** 2.0 + (y - sy) ** 2.0)
    past = alpha[np.maximum(near, 0)] - 0.5
    if inside:
        frame = np.minimum(np.minimum(x, y), np.minimum(w - 1 - x, h - 1 - y)) + 0.5
        away = np.where(alpha < SOLID, alpha - 0.5, np.where(near >= 0, span + past, np.inf))
        away, on = np.minimum(frame, away), alpha > 0
    else:
        away, on = np.where(alpha >= SOLID, 0.5 - alpha, span - past), (alpha < 1) & ((alpha >= SOLID) | (near >= 0))
    fall = (away <= width).astype(float) if feather <= GUARD else np.clip((width + feather * 0.5 - away) / feather, 0.0, 1.0)
    out = np.where(on, stored(fall * strength), 0.0)
    return out if (on & (fall > 0)).any() else None


def edge_cleanup(c: Canvas, s: dict) -> None:
    c.stroke = stored(s["stroke_color"][:3])
    if c.keys and c.coverage is not None:
        c.coverage = _restored(c)
    opacity = s["stroke_color"][3] if len(s["stroke_color"]) > 3 else 1.0
    if max(s["inner"], s["outer"]) <= 0 or not (s["auto_color"] or opacity > 0):
        return
    alpha, feather, strength = c.alpha(), np.clip(s["softness"], 0.0, 1.0) * s["feather"], 1.0 if s["auto_color"] else opacity
    c.inner = _band(alpha, c.h, c.w, s["inner"], feather, strength, True) if s["inner"] > 0 else None
    c.outer = _band(alpha, c.h, c.w, s["outer"], feather, strength, False) if s["outer"] > 0 else None
    c.paint = None
    if s["auto_color"] and (c.inner is not None or c.outer is not None):
        radius = max(int(np.ceil(max(s["inner"], s["outer"]) * 4.0)), 6)
        blur = lambda x: box_mean(c.grid(stored(x)), radius).ravel()
        weight = blur(alpha)
        own = np.stack([blur(c.rgb[:, j] * alpha) for j in range(3)], 1) / np.maximum(weight, GUARD)[:, None]
        hue, sat, val = rgb_to_hsv(stored(own))
        line = stored(hsv_to_rgb(hue, np.minimum(sat * 1.3, 1.0), np.clip(val * 0.35, 0.0, 1.0)))
        on = weight > GUARD
        painted = np.zeros(c.n, bool)
        for band in (c.inner, c.outer):
            painted |= False if band is None else band > 0
        c.paint = np.where((on & painted)[:, None], line, 0.0)


def inside_polygon(points, h, w):
    """Pixels whose centres an even-odd polygon holds."""
    p = np.asarray(points, np.float64)
    q = np.roll(p, -1, 0)
    out = np.zeros((h, w), bool)
    for y in range(max(int(p[:, 1].min()), 0), min(int(p[:, 1].max()), h - 1) + 1):
        line = y + 0.5
        cross = (p[:, 1] > line) != (q[:, 1] > line)
        a, b = p[cross], q[cross]
        xs = np.sort(stored(a[:, 0] + (line - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])))
        for lo, hi in zip(xs[::2], xs[1::2]):
            out[y, max(int(np.ceil(lo - 0.5)), 0) : max(min(int(np.floor(hi - 0.5)), w - 1) + 1, 0)] = True
    return out.ravel()


def polygon_edit(c: Canvas, s: dict) -> None:
    live = [r for r in s["regions"] if r.get("enabled", True) and len(r["points"]) >= 3]
    if not live:
        return
    for r in live:
        cells = np.flatnonzero(inside_polygon(r["points"], c.h, c.w))
        c.forget_regions(cells)
        c.ensure("region")[cells] = KEEP if r.get("mode", "subtract") == "add" else CUT
    c.regions_to_mask()
    c.regions_to_coverage()


def line_cells(a, b):
    """The grid line from a to b, a itself left out."""
    (x, y), (x1, y1) = a, b
    dx, dy = abs(x1 - x), -abs(y1 - y)
    sx, sy, error, out = (1 if x1 >= x else -1), (1 if y1 >= y else -1), dx + dy, []
    while (x, y) != (x1, y1):
        twice = 2 * error
        if twice >= dy:
            error, x = error + dy, x + sx
        if twice <= dx:
            error, y = error + dx, y + sy
        out.append((x, y))
    return out


def stroke_strength(stroke, h, w):
    """Strongest touch of a round stamp along a stroke, by pixel."""
    points = [tuple(p) for p in stroke["points"]]
    dabs = points[:1] + [p for a, b in zip(points, points[1:]) for p in line_cells(a, b)]
    radius = max(stroke.get("radius", 8), 1)
    reach = radius - 0.5
    inner = reach * min(max(stroke.get("sharpness", 1.0), 0.0), 1.0)
    d = np.sqrt(np.add.outer(np.arange(-radius, radius + 1) ** 2.0, np.arange(-radius, radius + 1) ** 2.0))
    stamp = stored(np.where(d > reach, 0.0, np.where(d <= inner, 1.0, (reach - d) / max(reach - inner, 1e-6))))
    out = np.zeros((h + 2 * radius, w + 2 * radius))
    for x, y in dict.fromkeys(dabs):
        if -radius <= x < w + radius and -radius <= y < h + radius:
            y0, x0 = max(-y, 0), max(-x, 0)
            view = out[y + y0 : y + 2 * radius + 1, x + x0 : x + 2 * radius + 1]
            np.maximum(view, stamp[y0 : y0 + view.shape[0], x0 : x0 + view.shape[1]], out=view)
    return out[radius : radius + h, radius : radius + w].ravel()


def brush_edit(c: Canvas, s: dict) -> None:
    shown, painted = c.alpha(), np.zeros(c.n, bool)
    for stroke in s["strokes"]:
        if stroke.get("enabled", True) and stroke["points"]:
            touch = stroke_strength(stroke, c.h, c.w)
            on = touch > 0
            goal = 1.0 if stroke.get("mode", "subtract") == "add" else 0.0
            shown = np.where(on, stored(np.clip(mix(shown, goal, touch), 0.0, 1.0)), shown)
            painted |= on
    cells = np.flatnonzero(painted)
    if not len(cells):
        return
    value = shown[cells]
    c.covered()[cells] = value
    c.data[cells, 3] = np.where(value > 0, 255, 0)
    if c.force is not None:
        c.force[cells] = 0
    if c.mask is not None:
        c.mask[cells] = np.where(value >= 1, SUBJECT, np.where(value <= 0, BACKGROUND, EDGE))
        c.key_of[cells] = np.where(value >= 1, NONE, np.where(value <= 0, CLEAR, c.key_of[cells]))
    c.forget_regions(cells)


def merged_tiles(found, h, w):
    """Object boxes grown by a pixel, overlapping ones joined until none overlap; in order of their first object."""
    rows = [[max(a - MARGIN, 0), max(b - MARGIN, 0), min(x + MARGIN, w - 1), min(y + MARGIN, h - 1)] for a, b, x, y in found.tolist()]
    joined = True
    while joined:
        joined = False
        i = 0
        while i < len(rows):
            a, j = rows[i], i + 1
            while j < len(rows):
                b = rows[j]
                if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                    a[:2], a[2:] = [min(a[0], b[0]), min(a[1], b[1])], [max(a[2], b[2]), max(a[3], b[3])]
                    del rows[j]
                    joined = True
                else:
                    j += 1
            i += 1
    return rows


def exclude_tiles(c: Canvas, s: dict) -> None:
    tiles = merged_tiles(boxes(islands(c.alpha(), c.h, c.w), c.w), c.h, c.w)
    first = lambda x, y: next((n for n, t in enumerate(tiles) if t[0] <= x <= t[2] and t[1] <= y <= t[3]), -1)
    picked = [first(*k["point"]) if 0 <= k["point"][0] < c.w and 0 <= k["point"][1] < c.h else -1 for k in s["picks"]]
    chosen = {n for n, k in zip(picked, s["picks"], strict=True) if n >= 0 and k.get("enabled", True)}
    c.reports.append({"op": "exclude_tiles", "tiles": [(t[0], t[1], t[2] - t[0] + 1, t[3] - t[1] + 1) for t in tiles], "picked": picked})
    gone = np.zeros((c.h, c.w), bool)
    for n, t in enumerate(tiles):
        if (n in chosen) == (s["mode"] == "exclude"):
            gone[t[1] : t[3] + 1, t[0] : t[2] + 1] = True
    if gone.any():
        c.erase(np.flatnonzero(gone))


def remove_minimum_area(c: Canvas, s: dict) -> None:
    alpha = c.alpha()
    label = islands(alpha, c.h, c.w, fringe=2, strays=True)
    if label.max(initial=-1) < 0:
        return
    area = np.bincount(label[label >= 0], alpha[label >= 0])
    doomed = area <= s["size"] ** 2
    if not doomed.any():
        return
    going = (label >= 0) & doomed[np.maximum(label, 0)]
    free, near = (label < 0) | going, c.grid(going).copy()
    for step in EIGHT:
        near |= shifted(c.grid(going), *step, False)
    c.reports += [{"op": "remove_minimum_area", "box": tuple(t)} for t in boxes(label, c.w)[doomed].tolist()]
    c.erase(np.flatnonzero(going | (near.ravel() & free)))


def _window(x, span, lead, pick):
    """Minimum or maximum over `span` cells from `lead` before each, both ways; outside counts as nothing."""
    for axis in (0, 1):
        x = pick.reduce([shifted(x, *((d, 0) if axis == 0 else (0, d)), False) for d in range(-lead, span - lead)], axis=0)
    return x


def remove_lines(c: Canvas, s: dict) -> None:
    span = s["thickness"] + 1
    lead = (span - 1) // 2
    alpha = c.alpha()
    held = np.zeros(c.n, bool)
    held |= False if c.protect is None else c.protect > 0
    held |= False if c.region is None else c.region == KEEP
    solid, support = held | (alpha >= SOLID), held | (alpha > 0)
    core = _window(c.grid(solid), span, lead, np.logical_and)
    if s["detached_only"]:
        kept = reachable(solid, np.flatnonzero(core.ravel() | held), c.h, c.w)
    else:
        kept = (_window(core, span, span - 1 - lead, np.logical_or).ravel() & solid) | held
    skirt = support & ~solid
    _, beside = neighbours(np.flatnonzero(kept), c.h, c.w)
    kept = kept | reachable(skirt, np.unique(beside[skirt[beside]]), c.h, c.w)
    gone = np.flatnonzero(support & ~kept)
    c.covered()[gone] = 0.0
    c.data[gone, 3] = 0
    if c.mask is not None:
        c.mask[gone], c.key_of[gone] = BACKGROUND, CLEAR
    for band in (c.inner, c.outer):
        if band is not None:
            band[gone] = 0.0


def fill_pinholes(c: Canvas, s: dict) -> None:
    opened = c.alpha() < 1.0
    hole = components(opened, c.h, c.w, FOUR)
    n = hole.max(initial=-1) + 1
    if not n:
        return
    y, x = np.divmod(np.arange(c.n), c.w)
    rim = (x == 0) | (y == 0) | (x == c.w - 1) | (y == c.h - 1)
    fits = (np.bincount(hole[opened], minlength=n) <= s["max_area"]) & (np.bincount(hole[opened & rim], minlength=n) == 0)
    cells = np.flatnonzero(opened & fits[np.maximum(hole, 0)])
    own, around = neighbours(cells, c.h, c.w, EIGHT)
    pairs = np.unique(np.stack([hole[own], around], 1)[~opened[around]], axis=0)
    votes = np.bincount(pairs[:, 0], minlength=n)
    mean = np.stack([np.bincount(pairs[:, 0], c.data[pairs[:, 1], j] * UNIT, n) for j in range(3)], 1) * (1.0 / np.maximum(votes, 1))[:, None]
    cells = cells[votes[hole[cells]] > 0]
    c.data[cells, :3], c.data[cells, 3] = to_byte(mean)[hole[cells]], 255
    if c.coverage is not None:
        c.coverage[cells] = 1.0
    if c.mask is not None:
        c.mask[cells], c.key_of[cells] = SUBJECT, NONE


def hsv_adjust(c: Canvas, s: dict) -> None:
    data = c.grid(c.data)
    for r in s["regions"]:
        x, y, w, h = r["rect"]
        area = data[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
        if r.get("enabled", True) and area.size:
            area[..., :3] = to_byte(shift_colours(area[..., :3] * UNIT, r.get("hue", 0.0), r.get("saturation", 1.0), r.get("value", 1.0), r.get("colorize", 0.0)))


def random_hsv_tiles(c: Canvas, s: dict) -> None:
    spans = [s["hue"], s["saturation"], s["value"], s["colorize"]]
    if tuple(map(tuple, spans)) == ((0, 0), (1, 1), (1, 1), (0, 0)):
        return
    label = islands(c.alpha(), c.h, c.w)
    n = np.arange(label.max(initial=-1) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        root = splitmix(s["seed"])
        tint = splitmix(root + np.uint64(0x9E3779B97F4A7C15))
        draws = [splitmix(root + n * np.uint64(3) + np.uint64(j)) for j in range(3)] + [splitmix(tint + n)]
    turn, sat, val, tinted = (mix(lo, hi, unit_draw(d)) for (lo, hi), d in zip(spans, draws, strict=True))
    cells = np.flatnonzero(label >= 0)
    own = label[cells]
    if len(cells):
        rgb, t = c.data[cells, :3] * UNIT, tinted[own]
        plain = shift_colours(rgb, turn[own], sat[own], val[own], 0.0)
        full = shift_colours(rgb, turn[own], sat[own], val[own], np.where(t > 0, t, 0.0)) if (t > 0).any() else plain
        c.data[cells, :3] = to_byte(np.where((t > 0)[:, None], full, plain))


def smooth_blocks(c: Canvas, s: dict) -> None:
    v = stored(c.grid(c.rgb))
    for axis in (1, 0):
        v = np.moveaxis(v, axis, 0)
        at = np.arange(8, len(v) - 2, 8)
        p, q = [v[at - 1 - i] for i in range(3)], [v[at + i] for i in range(3)]
        step = q[0] - p[0]
        flat = lambda z: np.abs(z[0] - z[1]) + np.abs(z[1] - z[2]) <= s["threshold"]
        go = (np.abs(step) <= s["threshold"]) & flat(p) & flat(q)
        for i in range(3):
            shift = step * (0.5 * s["amount"] * (3 - i) / 3.0)
            v[at - 1 - i] = np.where(go, stored(np.clip(p[i] + shift, 0.0, 1.0)), p[i])
            v[at + i] = np.where(go, stored(np.clip(q[i] - shift, 0.0, 1.0)), q[i])
        v = np.moveaxis(v, 0, axis)
    c.data[:, :3] = to_byte(v).reshape(c.n, 3)


def smooth_color(c: Canvas, s: dict) -> None:
    rgb, r = c.grid(c.rgb), s["radius"]
    to = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    light, blue, red = (stored(rgb @ row + base) for row, base in zip(to, (0.0, 0.5, 0.5), strict=True))
    spread_, match = max(r * 0.5, 0.5), mix(0.02, 0.25, np.clip(s["strength"], 0.0, 1.0))
    same = np.exp(-((np.arange(1024) / 1023.0) ** 2) / (2.0 * match * match))
    total, sums = np.zeros_like(light), [np.zeros_like(light), np.zeros_like(light)]
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            there = shifted(light, dy, dx, np.nan)
            gap = np.minimum(np.nan_to_num(half_up(np.abs(there - light) * 1023.0)), 1023).astype(int)
            weight = np.where(np.isnan(there), 0.0, np.exp(-(dx * dx + dy * dy) / (2.0 * spread_ * spread_)) * same[gap])
            total += weight
            for out, part in zip(sums, (blue, red), strict=True):
                out += weight * shifted(part, dy, dx, 0.0)
    cb, cr = (mix(part, out / total, s["amount"]) - 0.5 for out, part in zip(sums, (blue, red), strict=True))
    c.data[:, :3] = to_byte(np.stack([light + 1.402 * cr, light - 0.344136 * cb - 0.714136 * cr, light + 1.772 * cb], -1)).reshape(c.n, 3)


def smooth_halos(c: Canvas, s: dict) -> None:
    v, r = stored(c.grid(c.rgb)), s["radius"]
    by = np.minimum(np.arange(0, -(-c.h // 8) * 8), c.h - 1), np.minimum(np.arange(0, -(-c.w // 8) * 8), c.w - 1)
    tiles = v[by[0]][:, by[1]].reshape(-(-c.h // 8), 8, -(-c.w // 8), 8, 3)
    low, high = tiles.min((1, 3)), tiles.max((1, 3))
    wide = lambda z: np.repeat(np.repeat(z, 8, 0), 8, 1)[: c.h, : c.w]
    go, middle = wide(high - low >= s["threshold"]), wide((low + high) * 0.5)
    above, spread_ = v >= middle, max(r * 0.6, 0.5)
    weight, total = np.zeros_like(v), np.zeros_like(v)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            there = shifted(v, dy, dx, np.nan)
            w = np.where(~np.isnan(there) & ((there >= middle) == above), np.exp(-(dx * dx + dy * dy) / (2.0 * spread_ * spread_)), 0.0)
            weight += w
            total += w * np.nan_to_num(there)
    out = np.where(go, stored(np.clip(mix(v, total / np.maximum(weight, 1e-300), s["strength"]), 0.0, 1.0)), v)
    c.data[:, :3] = to_byte(out).reshape(c.n, 3)


def denoise(c: Canvas, s: dict) -> None:
    """model: rgb (h, w, 3) in 0..1 and a quality -> the same filtered; without a model nothing happens."""
    if s["model"] is None or s["blend"] <= 0:
        return
    rgb = c.grid(c.rgb)
    clean = np.clip(np.asarray(s["model"](rgb, s["quality"]), np.float64), 0.0, 1.0)
    c.data[:, :3] = to_byte(mix(rgb, clean, s["blend"])).reshape(c.n, 3)


@dataclass(frozen=True)
class Stage:
    """run, the name shown, the output suffix, default settings, and bounds of numbers by setting."""

    run: Callable[[Canvas, dict], None]
    name: str
    defaults: dict
    bounds: dict
    suffix: str = "_out"
    weight: float = 0.3

    def settings(self, given: dict | None) -> dict:
        out = self.defaults | {k: v for k, v in (given or {}).items() if k in self.defaults}
        for k, (low, high) in self.bounds.items():
            if isinstance(out[k], (list, tuple)):
                out[k] = tuple(sorted(min(max(v, low), high) for v in out[k]))
            else:
                out[k] = type(self.defaults[k])(min(max(out[k], low), high))
        return out


WHITE = [{"enabled": True, "samples": [{"color": [1.0, 1.0, 1.0], "color_tolerance": 0.02}]}]
STAGES: dict[str, Stage] = {
    "brush_edit": Stage(brush_edit, "Brush Edit", {"strokes": []}, {}, weight=0.1),
    "denoise": Stage(denoise, "Denoise", {"blend": 1.0, "quality": "balanced", "model": None}, {"blend": (0, 1)}, weight=0.8),
    "edge_cleanup": Stage(edge_cleanup, "Edge Cleanup", {"inner": 0.5, "outer": 0.5, "softness": 0.75, "auto_color": False, "stroke_color": [0.0, 0.0, 0.0, 1.0], "feather": 2.0}, {"inner": (0, 5), "outer": (0, 5), "softness": (0, 1)}),
    "exclude_tiles": Stage(exclude_tiles, "Exclude Tiles", {"picks": [], "mode": "exclude", "hidden_opacity": 0.2}, {"hidden_opacity": (0, 1)}, weight=0.25),
    "fill_pinholes": Stage(fill_pinholes, "Fill Pinholes", {"max_area": 1}, {"max_area": (1, 100)}, weight=0.25),
    "hsv_adjust": Stage(hsv_adjust, "HSV Adjustment", {"regions": []}, {}, weight=0.15),
    "remove_background": Stage(remove_background, "Matte Remove Background", {"remove_colors": WHITE, "edge_width": 2, "contiguous": True, "decontaminate": True, "bleed_radius": 16}, {"edge_width": (0, 16), "bleed_radius": (0, 64)}, weight=1.0),
    "neural_remove_background": Stage(neural_remove_background, "Neural Remove Background", {"threshold": 0.5, "contiguous": True, "edge_width": 2, "edge_tolerance": 0.0, "matte": "analytic", "decontaminate": True, "bleed_radius": 16, "model": None}, {"threshold": (0.05, 0.95), "edge_width": (0, 16), "edge_tolerance": (0, 0.5), "bleed_radius": (0, 64)}, weight=3.0),
    "polygon_edit": Stage(polygon_edit, "Polygon Edit", {"regions": []}, {}, weight=0.05),
    "posterize": Stage(posterize, "Posterize", {"palette": "even", "levels": 4, "colors": 16, "per_tile": True, "dither": "none", "strength": 1.0}, {"levels": (2, 32), "colors": (2, 256), "strength": (0, 1)}, weight=0.35),
    "random_hsv_tiles": Stage(random_hsv_tiles, "Random HSV Tiles", {"seed": 0, "hue": (-0.5, 0.5), "saturation": (1, 1), "value": (1, 1), "colorize": (0, 0)}, {"seed": (0, 999999), "hue": (-0.5, 0.5), "saturation": (0, 2), "value": (0, 3), "colorize": (0, 1)}),
    "refine_edges": Stage(refine_edges, "Refine Edges", {"radius": 2, "floor": 0.0, "ceiling": 1.0}, {"radius": (0, 16), "floor": (0, 1), "ceiling": (0, 1)}),
    "island_picker": Stage(island_picker, "Remove Colors", {"islands": [], "edge_width": 2}, {"edge_width": (0, 16)}, weight=0.25),
    "remove_crevice": Stage(remove_crevice, "Remove Crevice", {"reach": 1, "tolerance": 0.25}, {"reach": (0, 32), "tolerance": (0, 1)}, weight=0.35),
    "remove_lines": Stage(remove_lines, "Remove Lines", {"thickness": 1, "detached_only": True}, {"thickness": (1, 16)}, weight=0.25),
    "remove_minimum_area": Stage(remove_minimum_area, "Remove Minimum Area", {"size": 3}, {"size": (1, 64)}, weight=0.25),
    "smooth_blocks": Stage(smooth_blocks, "Smooth Blocks", {"threshold": 0.06, "amount": 1.0}, {"threshold": (0, 0.3), "amount": (0, 1)}, weight=0.2),
    "smooth_color": Stage(smooth_color, "Smooth Color", {"radius": 2, "strength": 0.5, "amount": 1.0}, {"radius": (1, 8), "strength": (0, 1), "amount": (0, 1)}, weight=0.5),
    "smooth_halos": Stage(smooth_halos, "Smooth Halos", {"threshold": 0.15, "radius": 2, "strength": 1.0}, {"threshold": (0, 1), "radius": (1, 6), "strength": (0, 1)}, weight=0.4),
}
