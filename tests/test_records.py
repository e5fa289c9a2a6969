"""Evidence, records of pages, foreign ink, drift, plans and orders, and arcs of the contracted graph."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_topology import FIGURE_8, LETTER_H, NESTED, RING, mask

from scantopo.functions import evidence
from scantopo.operators import formulas, geometry, kernel, records, stats
from scantopo.plans import record_queries
from scantopo.sources import images


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -2.5, 0.06, 0.35, 1234.5, 99.95, 999.5, 9.995e-5, 1e-5, 123456789.0, 712500.0, 1e100, -0.000123456]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(evidence.general(F.col("v"))).collect()]
    assert got == [f"{v:.3g}" for v in values]


def test_numbers_as_text_next_to_a_half(spark):
    values = [k * 10.0**e for k in (1.785, 2.675, 8.375, 1.005, 98.95, 0.4325, 55.05, 7.985, 9.995) for e in range(-9, 9)] + [-0.0, float("inf"), float("nan"), 1e-320, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(evidence.general(F.col("v"))).collect()]
    assert got == [None if v is None else f"{v:.3g}" for v in values]


def test_because(spark):
    d = spark.createDataFrame([(0.061, 14), (0.5, None)], "fill double, holes int")
    f = evidence.because((F.lit(True), evidence.fact("fill", F.col("fill"), "<", F.lit(0.35))), (F.col("holes").isNotNull(), evidence.fact("holes", F.col("holes"), ">=", F.lit(2), whole=True)))
    assert [r[0] for r in d.select(f).collect()] == [["fill 0.061 < 0.35", "holes 14 >= 2"], ["fill 0.5 < 0.35"]]


@pytest.mark.parametrize(("picture", "arcs", "joins"), [(RING, 4, 4), (LETTER_H, 5, 4), (FIGURE_8, 7, 8), ("#", 1, 0), (".", 0, 0), (NESTED, 8, 8)])
def test_arcs(picture, arcs, joins):
    r = images.runs_of(mask(picture))
    first, above, below = kernel.arcs(r, *kernel.edges(r))
    assert len(set(first.tolist())) == arcs and len(above) == len(below) == joins
    turned = images.runs_of(mask(picture)[::-1])
    again, _, _ = kernel.arcs(turned, *kernel.edges(turned))
    assert len(set(again.tolist())) == arcs


def test_regions_within_regions():
    r = images.runs_of(mask(NESTED))
    page, ink, name, around, depth = kernel.nested(r, np.array([7]), 7)
    assert sorted(zip(ink.tolist(), depth.tolist(), strict=True)) == [(False, 0), (False, 2), (False, 4), (True, 1), (True, 3)]
    by = dict(zip(name[~ink].tolist(), depth[~ink].tolist(), strict=True))
    assert all(by[a] == d - 1 for a, d in zip(around[ink].tolist(), depth[ink].tolist(), strict=True)) and set(page.tolist()) == {0}


def test_component_records():
    r = images.runs_of(mask("##.#\n##.#\n...#"))
    c = kernel.components(r)
    assert [c[k].tolist() for k in ("area", "x0", "y0", "x1", "y1", "sx", "sy", "sxx", "syy", "sxy")] == [[4, 3], [0, 3], [0, 0], [1, 3], [1, 2], [2, 9], [2, 3], [2, 27], [2, 5], [1, 9]]


def test_foreign_ink(spark):
    own = [(1, i, 20 + 6 * i, 10, 23 + 6 * i, 15, 20) for i in range(4)]
    rows = [*own, (1, 8, 0, 2, 3, 5, 9), (1, 9, 5, 3, 6, 4, 2), (1, 10, 80, 10, 83, 15, 20), (2, 0, 5, 5, 6, 6, 4)]
    boxes = spark.createDataFrame(rows, "page_id long, id long, x0 int, y0 int, x1 int, y1 int, area long")
    sizes = spark.createDataFrame([(1, 100, 40), (2, 12, 12)], "page_id long, width int, height int")
    for anchor, want in (("edge", {8, 9}), ("extreme", {8, 9, 10})):
        got = records.foreign_ink(boxes, sizes, anchor=anchor).collect()
        assert {r["id"] for r in got if r["overrun"]} == want and {r["id"] for r in got if r["separated"]} == {8, 9, 10}
    with pytest.raises(ValueError):
        records.foreign_ink(boxes, sizes, anchor="near")


def test_drift_and_verdict(spark):
    s, m, t = (spark.createDataFrame(r, "page_id int, components int, holes int") for r in ([(1, 4, 2), (2, 4, 0), (3, 0, 0)], [(1, 4, 4), (2, 3, 0)], [(1, 8, 2), (2, 2, 1)]))
    got = {r["page_id"]: tuple(r)[1:] for r in records.compare_drift(s, m, t).collect()}
    assert got == {1: (0.0, 0.5, 0.5, 0.0, None), 2: (0.25, 0.0, 0.5, 1.0, True), 3: (0.0, 0.0, 0.0, 0.0, False)}


def test_selection_is_asked_for(spark):
    d = spark.createDataFrame([(i, i) for i in range(40)], "doc_id int, pages int")
    for bad in (None, 0, "some", -3):
        with pytest.raises(ValueError, match="limit"):
            records.select(d, bad)
    assert records.gate(d, 3, F.col("pages")).count() == 3
    with pytest.raises(ValueError, match="40 documents"):
        records.gate(d, "all", F.col("pages"))
    assert records.gate(d, "ALL", F.col("pages"), yes=True).count() == 40


def test_keys_are_named_once(spark):
    t = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert [r["v"] for r in records.keyed(t, "k").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="named twice"):
        records.keyed(t.unionAll(t), "k").collect()


def test_places_in_order(spark):
    d = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 7)], "g string, v int")
    got = {r["g"]: tuple(r)[1:] for r in stats.at_index(d, ["g"], "v", lo=F.lit(1), hi=F.col("n") - 1).collect()}
    assert got == {"a": (4, 1, 9), "b": (1, None, 7)}


def test_rewriting_is_confluent():
    symbols = {i: (n, (i, 0, i, 0)) for i, n in enumerate("abcde")}
    assert formulas.confluent(symbols, {(0, 1): "SUB", (0, 2): "NEXT", (2, 3): "SUPER", (2, 4): "NEXT"})


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_both_ways(kind):
    rgb = np.random.default_rng(kind).integers(0, 256, (9, 11, 3))
    gray, dpi, neutral = images.read_png(images.write_png(rgb, 200.0, (kind,)))
    assert gray.tolist() == ((299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2] + 500) // 1000).tolist() and round(dpi) == 200 and not neutral


@pytest.mark.parametrize("angle", [0.0, 0.5, 3.0, -3.0, 40.0])
def test_moved_runs(spark, angle):
    """Runs of whole pages moved as arrays are those that are moved as rows."""
    rng = np.random.default_rng(5)
    mask = rng.random((3, 16, 64)) < 0.4
    r = kernel.from_mask(mask.ravel(), *[v.ravel() for v in np.indices(mask.shape)])
    c, s = float(np.cos(np.radians(angle))), float(np.sin(np.radians(angle)))
    m = (c, s, -s, c, 8.0, 8.0)
    got = geometry.moved(r, m, 70, 30)
    rows = [tuple(int(v) for v in x) for x in zip(r.page, r.line, r.lo, r.hi, strict=True)]
    want = geometry.transport(spark.createDataFrame(rows, "page_id long, line int, lo int, hi int"), m, 70, 30).select("page_id", "line", "lo", "hi")
    assert list(zip(*(v.tolist() for v in (got.page, got.line, got.lo, got.hi)), strict=True)) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("texts", [[], ["", None, "bcd"], ["a", "abe" * 700, "a" * 3000]])
def test_rotation_within_the_page_pass(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = record_queries.rotation_survival(spark, str(tmp_path))
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan
    rows = [tuple(x) for x in got.collect()]
    assert [x[0] for x in rows] == [0.0, 0.5, 3.0, -3.0] and rows[0][1:] == ((1.0, 1.0) if len(texts) == 3 and texts[0] else (None, None))
