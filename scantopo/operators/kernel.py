"""Topology of whole pages over arrays of runs, many pages at a time.

A batch holds the runs of whole pages in order of (page, line, lo). Neighbours on the line above are a contiguous range
of that order, so edges come from two binary searches; components come from hooking each root under the least one it
touches and halving paths, over all pages of the batch together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Runs:
    page: np.ndarray  # index of the page in the batch, ascending
    line: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __len__(self) -> int:
        return len(self.lo)


def from_mask(mask: np.ndarray, page: np.ndarray, line: np.ndarray, x: np.ndarray) -> Runs:
    """Maximal runs of true cells; cells are in order of (page, line, x) without holes within a line."""
    if not len(mask):
        e = np.empty(0, np.int64)
        return Runs(e, e, e, e)
    new = np.r_[True, (line[1:] != line[:-1]) | (page[1:] != page[:-1])]
    before = np.r_[False, mask[:-1]] & ~new
    after = np.r_[mask[1:], False] & ~np.r_[new[1:], True]
    a, z = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after)
    return Runs(page[a], line[a], x[a], x[z])


def edges(r: Runs, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) indexes of runs on consecutive lines that touch: ``reach`` 1 with corners (8), 0 without (4)."""
    if not len(r):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = int(r.hi.max()) + 6  # columns from -1 are shifted by 2
    row = np.cumsum(np.r_[False, (r.page[1:] != r.page[:-1]) | (r.line[1:] != r.line[:-1])])
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    up = np.full(len(start), -1)
    near = (r.page[start[1:]] == r.page[start[:-1]]) & (r.line[start[1:]] == r.line[start[:-1]] + 1)
    up[1:][near] = np.arange(len(start) - 1)[near]
    above = up[row]
    own = np.flatnonzero(above >= 0)
    first = np.searchsorted(row * wide + r.hi + 2, above[own] * wide + r.lo[own] - reach + 2, "left")
    last = np.searchsorted(row * wide + r.lo + 2, above[own] * wide + r.hi[own] + reach + 2, "right")
    n = np.maximum(0, last - first)
    upper = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return upper, np.repeat(own, n)


def label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of the component of each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    return root


def forest_edges(r: Runs, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether each edge joins two components when edges come in order of (lower, upper): the others close cycles.

    The edges kept are those of the least spanning forest under that order, found by rounds in which every component
    keeps the first edge that leaves it.
    """
    m, keep = len(upper), np.zeros(len(upper), bool)
    order = np.lexsort((upper, lower))
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    root = np.arange(len(r))
    live = np.arange(m)
    while len(live):
        x, y = root[upper[live]], root[lower[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        best = np.full(len(r), m)
        np.minimum.at(best, x, rank[live])
        np.minimum.at(best, y, rank[live])
        keep[order[np.unique(best[best < m])]] = True
        root = label(len(r), upper[keep], lower[keep])
    return keep


def ground(r: Runs, heights: np.ndarray, width: int) -> Runs:
    """The runs of ground of pages with a border of one cell: lines -1 to height, columns -1 to ``width``."""
    rows = heights + 2
    page = np.repeat(np.arange(len(heights)), rows)
    line = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows) - 1
    base = np.cumsum(rows) - rows
    at = base[r.page] + r.line + 1
    # each line starts with a run from -1; after each run of ink there is one more
    lo = np.r_[np.full(len(page), -1), r.hi + 1]
    row = np.r_[np.arange(len(page)), at]
    hi = np.r_[np.full(len(page), width), np.full(len(r), width)]
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    ends = np.lexsort((r.lo, at))
    count = np.bincount(at, minlength=len(page))
    first = np.cumsum(np.r_[0, count[:-1] + 1]) if len(page) else np.empty(0, np.int64)
    place = np.repeat(first, count) + np.arange(len(r)) - np.repeat(np.cumsum(np.r_[0, count[:-1]]), count) if len(r) else np.empty(0, np.int64)
    hi[place] = r.lo[ends] - 1
    ok = lo <= hi
    return Runs(page[row[ok]], line[row[ok]], lo[ok], hi[ok])


def arcs(r: Runs, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of regular runs as arcs: the first run of the arc of each run, and the edges between arcs (above, below).

    A run goes on with the arc above it if each is the other's only neighbour on that side and neither has two on any
    side; so chains are paths, and their first runs are found by doubling. Turning the page upside down swaps the two
    ends of each edge and leaves the arcs as they are.
    """
    n = len(r)
    up, down = np.bincount(lower, minlength=n), np.bincount(upper, minlength=n)
    junction = (up >= 2) | (down >= 2)
    goes = ~junction[upper] & ~junction[lower]  # then each has one neighbour on that side, the other
    first = np.arange(n)
    first[lower[goes]] = upper[goes]
    while True:
        above = first[first]
        if np.array_equal(above, first):
            break
        first = above
    return first, first[upper[~goes]], first[lower[~goes]]


def holder(inner: Runs, outer: Runs, which: np.ndarray) -> np.ndarray:
    """For each of the runs ``which`` of ``inner``, the run of ``outer`` that holds the cell above its first; -1 without."""
    if not len(outer) or not len(which):
        return np.full(len(which), -1)
    tall, wide = (int(max(inner_.max(), outer_.max())) + 4 for inner_, outer_ in ((inner.line, outer.line), (inner.hi, outer.hi)))
    key = lambda page, line, x: (page * tall + line + 2) * wide + x + 2
    page, line, x = inner.page[which], inner.line[which] - 1, inner.lo[which]
    at = np.searchsorted(key(outer.page, outer.line, outer.lo), key(page, line, x), "right") - 1
    own = np.maximum(at, 0)
    ok = (at >= 0) & (outer.page[own] == page) & (outer.line[own] == line) & (outer.hi[own] >= x)
    return np.where(ok, at, -1)


def nested(ink: Runs, heights: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For each region of ink (8 neighbours) and ground (4, with a border of one cell) of whole pages: page, whether it is
    ink, name, name of the region around it (-1 outside) and depth. A region's name is the place of its first cell on
    the page with its border."""
    both = []
    for r, reach in ((ink, 1), (ground(ink, heights, width), 0)):
        comp = label(len(r), *edges(r, reach))
        both.append((r, comp, (r.line + 1) * (width + 2) + r.lo + 1, np.flatnonzero(comp == np.arange(len(r)))))
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for k, (r, _, name, top) in enumerate(both):
        other, comp, other_name, other_top = both[1 - k]
        at = holder(r, other, top)
        root = comp[np.maximum(at, 0)] if len(other) else np.zeros(len(top), np.int64)
        around = np.where(at >= 0, other_name[root], -1) if len(other) else at
        place = np.searchsorted(other_top, root) + (0 if k else len(top))  # ink stands first
        for c, v in zip(cols, (r.page[top], np.full(len(top), not k), name[top], around, np.where(at >= 0, place, -1)), strict=True):
            c.append(v)
    page, is_ink, name, around, up = map(np.concatenate, cols)
    depth, at = np.zeros(len(up), np.int64), up
    while (at >= 0).any():
        depth += at >= 0
        at = np.where(at >= 0, up[np.maximum(at, 0)], -1)
    return page, is_ink, name, around, depth


def regions(ink: Runs, heights: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The regions of ``nested``, ink first, with the sums and boxes of ``components``."""
    page, is_ink, name, around, _ = nested(ink, heights, width)
    both = [components(ink, 1), components(ground(ink, heights, width), 0)]
    return {"page": page, "ink": is_ink, "id": name, "parent": around} | {k: np.concatenate([c[k] for c in both]) for k in ("area", "x0", "y0", "x1", "y1")}


def bitmap(r: Runs, grid: int = 12) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pages, and any ink in each cell of a ``grid`` over the box around each page's ink, as three words of grid / 3 rows.

    A cell spans j * h // grid to (j + 1) * h // grid, but one row or column at least.
    """
    page, of = np.unique(r.page, return_inverse=True)
    span = []
    for low, high in ((r.line, r.line), (r.lo, r.hi)):
        a, z = np.full(len(page), np.iinfo(np.int64).max), np.full(len(page), -1)
        np.minimum.at(a, of, low)
        np.maximum.at(z, of, high)
        span.append((a, z - a + 1))
    (y0, h), (x0, w) = span
    y, a, z, wide, tall = r.line - y0[of], r.lo - x0[of], r.hi - x0[of], w[of], h[of]
    ends = lambda j, size: (j * size // grid, np.maximum(j * size // grid + 1, (j + 1) * size // grid))
    bits = np.zeros(len(r), np.int64)
    for i in range(grid):
        first, end = ends(i, wide)
        bits |= np.where((first <= z) & (end > a), 1 << i, 0)
    words = [np.zeros(len(page), np.int64) for _ in range(3)]
    third = grid // 3
    for j in range(grid):
        first, end = ends(j, tall)
        own = (first <= y) & (y < end)
        np.bitwise_or.at(words[j // third], of[own], bits[own] << (j % third * grid))
    return page, words


def components(r: Runs, reach: int = 1) -> dict[str, np.ndarray]:
    """One entry a component, in order of first runs: first (index of that run), box, runs, edges, and sums over cells."""
    up, down = edges(r, reach)
    first, of = np.unique(label(len(r), up, down), return_inverse=True)
    m = len(first)
    n, lo, hi, line = r.hi - r.lo + 1, r.lo, r.hi, r.line
    squares = lambda k: k * (k + 1) * (2 * k + 1) // 6
    sx, sxx = (lo + hi) * n // 2, squares(hi) - squares(lo - 1)
    total = lambda w: np.round(np.bincount(of, w, minlength=m)).astype(np.int64)
    out = {"first": first, "n_runs": np.bincount(of, minlength=m), "n_edges": np.bincount(of[down], minlength=m)}
    out |= {"area": total(n), "sx": total(sx), "sy": total(line * n), "sxx": total(sxx), "syy": total(line * line * n), "sxy": total(line * sx)}
    for name, f, v in (("x0", np.minimum, lo), ("y0", np.minimum, line), ("x1", np.maximum, hi), ("y1", np.maximum, line)):
        out[name] = v[first].copy()
        f.at(out[name], of, v)
    return out


def contours(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boundary loops: (page, first crack, signed area, length) of each; ink is on the left of the way around.

    Cracks are directed sides of cells. At a corner the way goes on along the crack that turns right most, so that cells
    which touch in a corner are within one loop, as they are within one component. Each crack has one successor; loops
    are the cycles of that permutation, found by doubling.
    """
    n = r.hi - r.lo + 1
    which = np.repeat(np.arange(len(r)), n)
    x = r.lo[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    page, y = r.page[which], r.line[which]
    wide, tall = (int(x.max()) + 3, int(y.max()) + 3) if len(x) else (3, 3)
    code = (page * tall + y + 1) * wide + x + 1
    has = lambda c: code[np.minimum(np.searchsorted(code, c), max(0, len(code) - 1))] == c if len(code) else np.zeros(0, bool)
    # directions 0 east, 1 south, 2 west, 3 north, y downwards; ink on the left of a crack
    parts = []
    for d, off, sx, sy in ((0, wide, 0, 1), (1, -1, 0, 0), (2, -wide, 1, 0), (3, 1, 1, 1)):
        own = ~has(code + off)
        parts.append((page[own], x[own] + sx, y[own] + sy, np.full(int(own.sum()), d)))
    page, sx, sy, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    step_x, step_y = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])
    key = lambda p, a, b, k: ((p * (tall + 2) + b) * (wide + 2) + a) * 4 + k
    start = key(page, sx, sy, d)
    order = np.argsort(start)
    page, sx, sy, d, start = page[order], sx[order], sy[order], d[order], start[order]
    nxt = np.full(len(start), -1)
    ex, ey = sx + step_x[d], sy + step_y[d]
    for turn in (1, 0, 3):  # y runs downwards, so one direction on is a right turn: away from the cell, across the corner
        want = key(page, ex, ey, (d + turn) % 4)
        at = np.minimum(np.searchsorted(start, want), max(0, len(start) - 1))
        ok = (nxt < 0) & (start[at] == want) if len(start) else np.zeros(0, bool)
        nxt[ok] = at[ok]
    least, jump = np.arange(len(start)), nxt.copy()
    while len(least):
        new = np.minimum(least, least[jump])
        if np.array_equal(new, least):
            break
        least, jump = new, jump[jump]
    loops, inv = np.unique(least, return_inverse=True)
    area2 = np.bincount(inv, sx * ey - ex * sy, minlength=len(loops))
    return page[loops], start[loops], np.round(-area2 / 2).astype(np.int64), np.bincount(inv, minlength=len(loops))
