"""Breadth-first passes over a grid, a whole layer at a time.

A first-in first-out flood visits layer after layer, and within a layer in the order of the layer before; a cell reached by
several is claimed by the first. So a layer is one array operation: the neighbours of the frontier in order, those that are
taken, and of each cell the first. Results equal those of the queue, ties included.
"""

from __future__ import annotations

import numpy as np

from .pixelmath import SOLID

FOUR = ((0, -1), (0, 1), (-1, 0), (1, 0))  # left, right, up, down
EIGHT = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


def neighbours(cells, h, w, steps=FOUR):
    """(cell, neighbour) in the order of cells, then of steps."""
    y, x = np.divmod(cells, w)
    ny, nx = y[:, None] + np.array([s[0] for s in steps]), x[:, None] + np.array([s[1] for s in steps])
    inside = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
    return np.broadcast_to(cells[:, None], inside.shape)[inside], (ny * w + nx)[inside]


def spread(frontier, h, w, take, steps=FOUR, reach=None):
    """Floods from the frontier: take(parents, cells) says which are taken; claim is done by take's second call.

    take is an object with `allows(parents, cells)` and `claim(parents, cells)`. Returns the cells claimed, in order."""
    claimed, layer = [], 0
    while len(frontier) and (reach is None or layer < reach):
        parents, cells = neighbours(frontier, h, w, steps)
        ok = take.allows(parents, cells)
        parents, cells = parents[ok], cells[ok]
        _, first = np.unique(cells, return_index=True)
        first.sort()
        parents, frontier = parents[first], cells[first]
        if len(frontier):
            take.claim(parents, frontier)
            claimed.append(frontier)
        layer += 1
    return np.concatenate(claimed) if claimed else np.zeros(0, np.int64)


class Copy:
    """Cells of a free area take their parent's value."""

    def __init__(self, values, free):
        self.values, self.free = values, free

    def allows(self, parents, cells):
        return self.free[cells]

    def claim(self, parents, cells):
        self.values[cells] = self.values[parents]
        self.free[cells] = False


def grassfire(seeds, h, w, reach):
    """For each cell the nearest seed by steps (-1 beyond reach); ties go to the one queued first."""
    out, free = np.full(h * w, -1, np.int64), np.ones(h * w, bool)
    seeds = np.asarray(seeds, np.int64)
    seeds = seeds[(seeds >= 0) & (seeds < h * w)]
    out[seeds], free[seeds] = seeds, False
    spread(seeds, h, w, Copy(out, free), reach=reach)
    return out


def reachable(domain, seeds, h, w):
    """Cells of the domain that its seeds reach by four-connected steps."""
    free = domain.copy()
    seeds = np.asarray(seeds, np.int64)
    seeds = np.unique(seeds[free[seeds]]) if len(seeds) else seeds
    free[seeds] = False
    mark = np.zeros(h * w, bool)
    mark[seeds] = True
    spread(seeds, h, w, Copy(mark, free))
    return mark


def components(domain, h, w, steps=EIGHT):
    """Numbers of the connected parts of a domain in scan order of their first cell; -1 outside."""
    none = h * w
    label = np.where(domain, np.arange(none), none)
    while True:
        grid, least = label.reshape(h, w), label.copy().reshape(h, w)
        padded = np.full((h + 2, w + 2), none)
        padded[1:-1, 1:-1] = grid
        for dy, dx in steps:
            np.minimum(least, padded[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx], out=least)
        new = np.where(domain, least.ravel(), none)
        held = np.append(new, none)
        new = np.where(domain, held[new], none)
        if (new == label).all():
            break
        label = new
    roots = np.unique(label[domain])
    return np.where(domain, np.searchsorted(roots, label), -1)


def islands(alpha, h, w, fringe=None, strays=False):
    """Object numbers by pixel: eight-connected solid parts in scan order; then visible pixels around them join, a layer at
    a time (at most `fringe` layers), the lower number first; with strays, other visible parts become objects of their own."""
    label = components(alpha >= SOLID, h, w)
    free = (label < 0) & (alpha > 0)
    solid = np.flatnonzero(label >= 0)
    if len(solid):
        solid = solid[np.argsort(label[solid], kind="stable")]
        spread(solid, h, w, Copy(label, free), EIGHT, fringe)
    if strays:
        rest = components((label < 0) & (alpha > 0), h, w)
        label = np.where(rest >= 0, rest + label.max(initial=-1) + 1, label)
    return label


def boxes(label, w):
    """(min x, min y, max x, max y) of each number."""
    cells = np.flatnonzero(label >= 0)
    n = label.max(initial=-1) + 1
    out = np.tile([1 << 30, 1 << 30, -1, -1], (n, 1))
    y, x = np.divmod(cells, w)
    for column, values, ufunc in ((0, x, np.minimum), (1, y, np.minimum), (2, x, np.maximum), (3, y, np.maximum)):
        ufunc.at(out[:, column], label[cells], values)
    return out
