"""The state of one image while a stack of operations runs over it.

Buffers that no operation has made yet are None, which is not the same as zeros: absent coverage means 1, an absent
mask means unclassified. Colours are read from the current pixels whenever a distance is needed.
"""

from __future__ import annotations

import numpy as np

from .floods import grassfire, spread
from .pixelmath import GUARD, UNIT, chebyshev, mix, stored, to_byte

BACKGROUND, EDGE, SUBJECT = 0, 1, 2
NONE, CLEAR = -1, -2
CUT, KEEP = 1, 2


class Canvas:
    def __init__(self, width, height, data):
        self.w, self.h, self.n = width, height, width * height
        self.data = np.frombuffer(bytes(data), np.uint8).reshape(self.n, 4).copy()
        self.mask = self.key_of = self.nearest = self.coverage = None
        self.region = self.protect = self.strayed = self.force = None
        self.inner = self.outer = self.paint = None
        self.keys: list[tuple[np.ndarray, float, bool]] = []
        self.edge_width = self.bleed = 0
        self.decontaminate = False
        self.search = 2
        self.stroke = np.zeros(3)
        self.reach, self.reach_tolerance = 0, 0.0
        self.reports: list[dict] = []

    @property
    def rgb(self):
        return self.data[:, :3] * UNIT

    def grid(self, x):
        return x.reshape(self.h, self.w, *x.shape[1:])

    def ensure(self, name, value=0, kind=np.uint8):
        if getattr(self, name) is None:
            setattr(self, name, np.full(self.n, value, kind))
        return getattr(self, name)

    def covered(self):
        """Coverage, made of ones if there is none."""
        return self.ensure("coverage", 1.0, np.float64)

    def alpha(self):
        """Visible alpha."""
        seen = self.data[:, 3] * UNIT
        seen = seen if self.coverage is None else seen * self.coverage
        return stored(seen if self.force is None else np.where(self.force > 0, 1.0, seen))

    # keys
    def add_key(self, colour, tolerance, island=False):
        self.keys.append((stored(colour), float(tolerance), island))
        return len(self.keys) - 1

    def distances(self, cells, key):
        """Distance of cells to keys (one number or one for each cell); the first key's are kept as float32."""
        out = chebyshev(self.data[cells, :3] * UNIT, np.array([k[0] for k in self.keys])[key])
        return np.where(np.asarray(key) == 0, stored(out), out)

    def claiming(self, cells):
        """The first listed key, islands aside, that claims each cell."""
        out = np.full(len(cells), NONE)
        for k in range(len(self.keys) - 1, -1, -1):
            if not self.keys[k][2]:
                out[self.distances(cells, k) <= self.keys[k][1]] = k
        return out

    def is_clear(self, cells):
        return self.data[cells, 3] == 0

    def claims(self, cells, key, weak):
        """The key that takes each cell, coming from a cell of `key` with `weak` steps used, and the steps used then."""
        own, steps = self.claiming(cells), np.array(weak)
        if not self.keys:
            return np.where(self.is_clear(cells), CLEAR, own), steps
        known = key >= 0
        tolerance = np.array([k[1] for k in self.keys])[np.maximum(key, 0)]
        far = self.distances(cells, np.maximum(key, 0))
        squeezed = known & (far > tolerance) & (own == NONE) & (self.reach > 0) & (weak < self.reach) & (far <= tolerance + self.reach_tolerance)
        out = np.where(known & ((far <= tolerance) | squeezed), key, own)
        out = np.where(self.is_clear(cells), CLEAR, out)
        return out, np.where(squeezed & (out != CLEAR), steps + 1, steps)

    def flood(self, frontier, weak=None):
        """Floods background from cells that have a key; returns the cells taken and the weak steps by cell."""
        steps = np.zeros(self.n, np.int64) if weak is None else weak
        return spread(np.asarray(frontier, np.int64), self.h, self.w, _Flood(self, steps)), steps

    def stray(self, cells, steps):
        """Cells that only squeezing reached become edges."""
        weak = cells[(self.mask[cells] == BACKGROUND) & (steps[cells] > 0) & (self.key_of[cells] >= 0)]
        self.ensure("strayed")[weak] = 1
        self.mask[weak] = EDGE

    def grow_edges(self, cells, width):
        if width <= 0 or not len(cells):
            return np.zeros(0, np.int64)
        cells = np.asarray(cells, np.int64)
        return spread(cells[self.key_of[cells] >= 0], self.h, self.w, _Band(self), reach=width)

    def classify(self, contiguous, width):
        fresh = self.mask is None
        if fresh:
            self.mask, self.key_of = np.full(self.n, SUBJECT, np.uint8), np.full(self.n, NONE, np.int64)
        steps = np.zeros(self.n, np.int64)
        if contiguous:
            grid = np.arange(self.n).reshape(self.h, self.w)
            border = np.concatenate([np.stack([grid[0], grid[-1]], 1).ravel(), np.stack([grid[:, 0], grid[:, -1]], 1).ravel()])
            _, first = np.unique(border, return_index=True)
            border = border[np.sort(first)]
            border = border[self.mask[border] != BACKGROUND]
            own = np.where(self.is_clear(border), CLEAR, self.claiming(border))
            seeds, own = border[own != NONE], own[own != NONE]
        else:
            seeds = np.flatnonzero(self.mask != BACKGROUND)
            own = self.claiming(seeds)
            seeds, own = seeds[own != NONE], own[own != NONE]
        self.mask[seeds], self.key_of[seeds] = BACKGROUND, own
        taken = seeds
        if contiguous:
            more, steps = self.flood(seeds, steps)
            taken = np.concatenate([seeds, more])
        if fresh:
            left = np.flatnonzero((self.mask != BACKGROUND) & (self.data[:, 3] == 0))
            self.mask[left], self.key_of[left] = BACKGROUND, CLEAR
        if self.reach > 0:
            self.stray(np.arange(self.n), steps)
        self.grow_edges(taken, width)

    def rebuild_nearest(self):
        if self.mask is None:
            self.nearest = None
            return
        subject = np.flatnonzero(self.mask == SUBJECT)
        self.nearest = grassfire(subject[self.claiming(subject) == NONE], self.h, self.w, self.search)

    def cover(self, cells):
        """Coverage of cells from their class: an edge's is its distance to its key against its nearest subject's."""
        out = self.covered()
        if self.mask is None:
            return
        kind, key = self.mask[cells], self.key_of[cells]
        value = np.where(kind == BACKGROUND, 0.0, 1.0)
        edge = np.flatnonzero((kind == EDGE) & (key >= 0))
        if len(edge):
            own, k = cells[edge], key[edge]
            tolerance = np.array([x[1] for x in self.keys])[k]
            far = self.distances(own, k)
            near = self.nearest[own] if self.nearest is not None else np.full(len(own), -1)
            reference = np.where(near >= 0, self.distances(np.maximum(near, 0), k), 0.0)
            for i in np.flatnonzero(near < 0):
                y, x = divmod(int(own[i]), self.w)
                r = self.edge_width
                area = self.grid(self.rgb)[max(y - r, 0) : y + r + 1, max(x - r, 0) : x + r + 1]
                reference[i] = chebyshev(area, self.keys[k[i]][0]).max()
            value[edge] = np.where(far > tolerance, np.clip((far - tolerance) / np.maximum(reference - tolerance, GUARD), 0.0, 1.0), 0.0)
        out[cells] = stored(value)

    # regions
    def regions_to_mask(self):
        if self.mask is None:
            return
        kept = np.zeros(self.n, bool) if self.protect is None else self.protect > 0
        cut = np.zeros(self.n, bool)
        if self.region is not None:
            cut, kept = self.region == CUT, kept | (self.region == KEEP)
        self.mask[kept], self.key_of[kept] = SUBJECT, NONE
        self.mask[cut], self.key_of[cut] = BACKGROUND, CLEAR

    def regions_to_coverage(self):
        if self.region is None and self.protect is None:
            return
        out, force = self.covered(), self.ensure("force")
        kept = np.zeros(self.n, bool) if self.protect is None else self.protect > 0
        if self.region is not None:
            out[self.region == CUT] = 0.0
            kept = kept | (self.region == KEEP)
        out[kept], force[kept] = 1.0, 1

    def forget_regions(self, cells):
        for name in ("region", "protect", "force", "inner", "outer"):
            if getattr(self, name) is not None:
                getattr(self, name)[cells] = 0

    def erase(self, cells):
        """Cells become clear background, in every buffer."""
        self.covered()[cells] = 0.0
        if self.mask is not None:
            self.mask[cells], self.key_of[cells] = BACKGROUND, CLEAR
        self.forget_regions(cells)
        self.data[cells, 3] = 0

    def dilated(self, cells, reach):
        return np.flatnonzero(grassfire(cells, self.h, self.w, max(reach, 0)) >= 0) if len(cells) else cells

    def compose(self):
        """The finished pixels: colours bled, unmixed from their key and stroked; alpha from source and coverage."""
        cover, source = self.covered(), self.rgb
        near = np.full(self.n, -1) if self.nearest is None else self.nearest
        bled = source[np.maximum(near, 0)]
        key = np.full(self.n, NONE) if self.key_of is None else self.key_of
        out = source.copy()
        gone = (cover <= 0) & (self.bleed > 0) & (near >= 0)
        out[gone] = bled[gone]
        alpha = np.maximum(cover, 0.0)
        part = np.flatnonzero((alpha > 0) & (alpha < 1)) if self.decontaminate and self.keys else np.zeros(0, np.int64)
        if len(part):
            known = np.where((key[part] >= 0) & (key[part] < len(self.keys)), key[part], 0)
            behind, a = np.array([k[0] for k in self.keys])[known], alpha[part, None]
            pure = np.clip((source[part] - (1.0 - a) * behind) * (1.0 / a), 0.0, 1.0)
            faded = (a < 0.25) & (near[part] >= 0)[:, None]
            out[part] = np.where(faded, mix(bled[part], pure, a / 0.25), pure)
        paint = np.broadcast_to(self.stroke, out.shape) if self.paint is None else self.paint
        if self.inner is not None:
            out = np.where((self.inner > 0)[:, None], mix(out, paint, self.inner[:, None]), out)
        seen = np.clip(self.data[:, 3] * UNIT * alpha, 0.0, 1.0)
        seen = seen if self.force is None else np.where(self.force > 0, 1.0, seen)
        if self.outer is not None:
            share = self.outer * (1.0 - seen)
            both = seen + share
            blend = (out * seen[:, None] + paint * share[:, None]) / np.maximum(both, GUARD)[:, None]
            on = self.outer > 0
            out = np.where((on & (both > GUARD))[:, None], blend, out)
            seen = np.where(on, both, seen)
        return np.concatenate([to_byte(out), to_byte(seen)[:, None]], 1)


class _Flood:
    """Background floods: a cell goes to the key that claims it from its parent."""

    def __init__(self, canvas, steps):
        self.c, self.steps = canvas, steps

    def allows(self, parents, cells):
        ok = self.c.mask[cells] != BACKGROUND
        at = np.flatnonzero(ok)
        if len(at):
            taken, _ = self.c.claims(cells[at], self.c.key_of[parents[at]], self.steps[parents[at]])
            ok[at] = taken != NONE
        return ok

    def claim(self, parents, cells):
        taken, steps = self.c.claims(cells, self.c.key_of[parents], self.steps[parents])
        self.c.mask[cells], self.c.key_of[cells], self.steps[cells] = BACKGROUND, taken, steps


class _Band:
    """Edges grow into the subject, away from pixels of the key's own colour."""

    def __init__(self, canvas):
        self.c = canvas

    def allows(self, parents, cells):
        key = self.c.key_of[parents]
        tolerance = np.array([k[1] for k in self.c.keys])[key]
        return (self.c.mask[cells] == SUBJECT) & (self.c.distances(cells, key) > tolerance)

    def claim(self, parents, cells):
        self.c.mask[cells], self.c.key_of[cells] = EDGE, self.c.key_of[parents]
