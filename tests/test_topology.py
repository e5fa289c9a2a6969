"""Pictures whose topology is known by hand, and properties of random ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scantopo.operators import kernel, topology
from scantopo.sources.images import runs_of

RING = "#####\n#...#\n#...#\n#...#\n#####"
LETTER_H = "#..#\n#..#\n####\n#..#\n#..#"
FIGURE_8 = "###\n#.#\n###\n#.#\n###"
TWO_DOTS = "#.#"
DIAGONAL = "#..\n.#.\n..#"
NESTED = "#######\n#.....#\n#.###.#\n#.#.#.#\n#.###.#\n#.....#\n#######"
GAP = "###\n...\n###"


def mask(picture: str) -> np.ndarray:
    return np.array([[ch == "#" for ch in line] for line in picture.split("\n")])


def counts(m: np.ndarray, reach: int = 1) -> tuple[int, int, int, int]:
    r = runs_of(m)
    up, down = kernel.edges(r, reach)
    c = len(set(kernel.label(len(r), up, down).tolist()))
    return len(r), len(up), c, len(up) - len(r) + c


@pytest.mark.parametrize(("picture", "want"), [(RING, (8, 8, 1, 1)), (LETTER_H, (9, 8, 1, 0)), (FIGURE_8, (7, 8, 1, 2)), (TWO_DOTS, (2, 0, 2, 0)), (GAP, (2, 0, 2, 0)), (NESTED, (16, 16, 2, 2)), (DIAGONAL, (3, 2, 1, 0))])
def test_counts(picture, want):
    assert counts(mask(picture)) == want


def test_corners_only_join_with_eight():
    assert counts(mask(DIAGONAL), 0)[2] == 3


def flood(m: np.ndarray, eight: bool) -> int:
    seen, n = set(), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * eight
    for start in zip(*np.nonzero(m), strict=True):
        if start in seen:
            continue
        n += 1
        todo = [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and p not in seen:
                    seen.add(p)
                    todo.append(p)
    return n


@settings(deadline=None, max_examples=80)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**6), st.floats(0.1, 0.9))
def test_random_masks(w, h, seed, density):
    r = random.Random(seed)
    m = np.array([[r.random() < density for _ in range(w)] for _ in range(h)])
    padded = np.pad(m, 1)
    runs, edges, comps, holes = counts(m)
    assert comps == flood(m, True) and holes == flood(~padded, False) - 1
    k = runs_of(m)
    ground = kernel.ground(k, np.array([h]), w)
    assert int((ground.hi - ground.lo + 1).sum()) == (w + 2) * (h + 2) - int(m.sum())
    up, down = kernel.edges(ground, 0)
    assert len(set(kernel.label(len(ground), up, down).tolist())) == holes + 1
    up, down = kernel.edges(k)
    joins = kernel.forest_edges(k, up, down)
    assert int(joins.sum()) == runs - comps and edges - int(joins.sum()) == holes
    _, _, area, _ = kernel.contours(k)
    assert int(area.sum()) == int(m.sum()) and (area > 0).sum() == comps and (area < 0).sum() == holes


def test_events_in_order(spark):
    rows = topology.pictures(spark.createDataFrame([(1, RING), (2, LETTER_H), (3, GAP)], "page_id long, picture string"))
    got = {}
    for r in topology.events(topology.components(topology.runs_from_lines(rows))).collect():
        got.setdefault(r["page_id"], []).append((r["line"], r["kind"], r["n"]))
    assert sorted(got[1]) == [(0, "birth", 1), (0, "split", 1), (4, "cycle", 1), (4, "merge", 1)] + [(5, "close", 1)] or sorted(got[1]) == [(0, "birth", 1), (0, "split", 1), (4, "cycle", 1), (5, "close", 1)]
    assert sorted(got[2]) == [(0, "birth", 2), (2, "merge", 1), (2, "split", 1), (5, "close", 1)]
    assert sorted(got[3]) == [(0, "birth", 1), (2, "birth", 1), (2, "close", 1), (3, "close", 1)]


def test_pictures_draw_back(spark):
    pics = {1: RING, 2: FIGURE_8, 3: GAP}
    df = spark.createDataFrame(list(pics.items()), "page_id long, picture string")
    runs = topology.runs_from_lines(topology.pictures(df))
    assert {r["page_id"]: r["picture"] for r in topology.draw(runs).collect()} == pics


def test_containment(spark):
    df = spark.createDataFrame([(1, NESTED)], "page_id long, picture string")
    ink = topology.components(topology.runs_from_lines(topology.pictures(df)))
    sizes = spark.createDataFrame([(1, 7, 7)], "page_id long, width int, height int")
    ground = topology.components(topology.complement(ink, sizes, pad=1), 0)
    got = sorted((r["kind"], r["depth"]) for r in topology.depths(topology.contain(ink, ground)).collect())
    assert got == [("ground", 0), ("ground", 2), ("ground", 4), ("ink", 1), ("ink", 3)]
