"""Rewriting, rows, and geometry by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scantopo.operators import formulas, geometry
from scantopo.operators.topology import draw, pictures, runs_from_lines


def symbols(n: int) -> dict:
    return {i: (chr(97 + i), (10 * i, 0, 10 * i + 5, 5)) for i in range(n)}


def test_rewrite():
    s = symbols(5)
    assert formulas.rewrite(s, {(0, 1): "SUB", (0, 2): "SUPER", (0, 3): "NEXT", (3, 4): "SUPER"}) == [("row", ("scripts", ("symbol", "a"), ("symbol", "b"), ("symbol", "c")), ("super", ("symbol", "d"), ("symbol", "e")))]
    assert formulas.rewrite(symbols(3), {(0, 1): "OVER", (0, 2): "UNDER"}) == [("fraction", ("symbol", "a"), ("symbol", "b"), ("symbol", "c"))]
    assert formulas.rewrite({0: (None, (0, 0, 1, 1))}, {}) == [("placeholder",)]
    assert len(formulas.rewrite(symbols(3), {(0, 1): "SUB", (0, 2): "SUB"})) == 3


@pytest.mark.parametrize("seed", range(24))
def test_rewrite_does_not_depend_on_order(seed):
    r = random.Random(seed)
    rel = {(0, 1): "SUB", (0, 2): "SUPER", (0, 3): "NEXT", (3, 4): "SUPER", (3, 5): "NEXT", (5, 6): "OVER", (5, 7): "UNDER"}
    keys: dict = {}
    assert formulas.rewrite(symbols(8), rel, order=lambda m: keys.setdefault((m[0], m[1]), r.random())) == formulas.rewrite(symbols(8), rel)


def test_rewrite_all(spark):
    s = spark.createDataFrame([(1, 0, "x", 0, 0, 5, 5), (1, 1, "2", 6, -3, 8, 1), (2, 0, None, 0, 0, 1, 1)], "expr_id int, id int, name string, x0 int, y0 int, x1 int, y1 int")
    r = spark.createDataFrame([(1, 0, 1, "SUPER")], "expr_id int, i int, j int, rel string")
    assert {x["expr_id"]: x["tree"] for x in formulas.rewrite_all(s, r).collect()} == {1: "[('super', ('symbol', 'x'), ('symbol', '2'))]", 2: "[('placeholder',)]"}


def test_rows_and_parts(spark):
    g = spark.createDataFrame([(1, 1, 0, 0, 5, 10), (1, 2, 8, 1, 12, 11), (1, 3, 0, 30, 5, 40), (1, 4, 2, 26, 3, 28)], "page_id long, id long, x0 long, y0 long, x1 long, y1 long")
    rows = {r["id"]: r["row"] for r in formulas.greedy_rows(g).collect()}
    assert rows[1] == rows[2] != rows[3]
    p = formulas.parts_of_glyphs(g.withColumn("row", F.lit(0)))
    got = {r["id"]: r["grp"] for r in p.collect()}
    assert got[3] == got[4] and got[1] == 1 and got[2] == 2


def test_rule_context_and_leader(spark):
    runs = runs_from_lines(pictures(spark.createDataFrame([(1, "####\n....\n####\n#...")], "page_id long, picture string")))
    rule = spark.createDataFrame([(1, 9, 0, 2, 3, 2)], "page_id long, id long, x0 long, y0 long, x1 long, y1 long")
    r = formulas.rule_context(runs, rule, 0.25).collect()[0]
    assert (r["above"], r["below"]) == (0.0, 0.25)
    assert formulas.dotted_leader([4] * 30, [10 * i for i in range(30)], [5] * 30) and not formulas.dotted_leader([4] * 10, list(range(10)), [5] * 10)


def test_spaces():
    s = geometry.Spaces()
    s.add("pt", "px", geometry.page_map(792, 144))
    s.add("px", "half", (0.5, 0, 0, 0.5, 0, 0))
    assert s.path("pt", "half") == ["pt", "px", "half"] and s.all_paths("half", "pt") == [["half", "px", "pt"]]
    a, b, c, d, e, f = s.between("pt", "half")
    assert (a, d, e, f) == (1, -1, 0, 792) and b == c == 0
    back = geometry.compose(s.between("pt", "half"), s.between("half", "pt"))
    assert back == pytest.approx(geometry.IDENTITY)
    with pytest.raises(ValueError):
        geometry.inverse((1, 1, 1, 1, 0, 0))
    with pytest.raises(KeyError):
        s.path("pt", "nowhere")


def test_warps_agree(spark):
    pic = "....\n.##.\n.##.\n...."
    runs = runs_from_lines(pictures(spark.createDataFrame([(1, pic)], "page_id long, picture string")))
    twice = (2.0, 0.0, 0.0, 2.0, 0.0, 0.0)
    a = sorted(tuple(r) for r in geometry.transport(runs, twice, 8, 8).collect())
    assert a == [(1, y, 2, 5) for y in range(2, 6)]
    assert sorted(tuple(r) for r in geometry.resample(runs, twice, 8, 8, (4, 4)).collect()) == a
    assert draw(geometry.transport(runs, (0.0, 1.0, -1.0, 0.0, 4.0, 0.0), 4, 4)).collect()[0]["picture"] == "...\n.##\n.##"


def test_fill_with_hole(spark):
    ring = [(0, 0, 6, 0), (6, 0, 6, 6), (6, 6, 0, 6), (0, 6, 0, 0), (2, 2, 2, 4), (2, 4, 4, 4), (4, 4, 4, 2), (4, 2, 2, 2)]
    e = spark.createDataFrame([(1, *map(float, r)) for r in ring], "page_id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r)[1:] for r in geometry.fill(e).collect())
    assert got == [(0, 0, 5), (1, 0, 5), (2, 0, 1), (2, 4, 5), (3, 0, 1), (3, 4, 5), (4, 0, 5), (5, 0, 5)]


def test_cubic():
    pts = geometry.flatten_cubic((0, 0), (0, 10), (10, 10), (10, 0))
    assert pts[-1] == (10, 0) and max(y for _, y in pts) == pytest.approx(7.5, abs=0.3)


def test_chained_and_leading_block(spark):
    r = spark.createDataFrame([(1, 0, 1, "SUB"), (1, 0, 2, "SUPER"), (1, 3, 4, "SUPER")], "expr_id int, i int, j int, rel string")
    assert sorted(tuple(x) for x in geometry.chained(r).collect()) == [(1, 0, 1, "SUB"), (1, 1, 2, "SUPER"), (1, 3, 4, "SUPER")]
    p = spark.createDataFrame([("d", i, i in (2, 3, 5, 11)) for i in range(12)] + [("e", 0, False)], "doc string, page int, good boolean")
    assert {x["doc"]: (x["first"], x["last"], x["n"]) for x in formulas.leading_block(p, "doc", "good").collect()} == {"d": (2, 5, 3), "e": (None, None, None)}
