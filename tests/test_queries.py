"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scantopo.operators import detect, geometry, match
from scantopo.plans import catalogue, detect_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    q = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*[f"`{n}`" for n in names]).collect()) == plain(q.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize(("name", "operator"), [("page_objects", detect.page_objects), ("table_cells", lambda r: detect.table_cells(r, 1))])
def test_objects_in_the_page_pass(spark, sf, tmp_path, name, operator):
    """One pass without a shuffle gives what the operators on frames of regions give."""
    lines = ["x" * 64, "x" + "a" * 62 + "x", *["xa" + ("b" * 19 + "a") * 3 + "x"] * 5, "x" + "a" * 62 + "x", *["xa" + ("b" * 29 + "a") * 2 + "x"] * 4, "x" + "a" * 62 + "x"]
    ring = ["x" * 64, "x" + "a" * 40, *["xa" + "b" * 38 + "a"] * 4, "xa" + "b" * 9 + "aa" + "b" * 27 + "a", *["xa" + "b" * 38 + "a"] * 4, "x" + "a" * 40]
    texts = ["\n".join(x.ljust(63, "x")[:63] for x in lines) + "\n", "\n".join(x.ljust(63, "x")[:63] for x in ring), "", None, "a", "bcd", "a" * 200, "abe" * 100]
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = operator(detect_queries.region_boxes(spark, str(tmp_path)))
    assert got.schema.simpleString() == want.schema.simpleString() and want.filter("page_id < 0").count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_boxes_filled_as_rows(spark, sf, tmp_path):
    """Outlines are rows of their own up to the sum by their number, which boxes of two large orders may share."""
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * replace (CASE WHEN n < 300 THEN n % 2 + 1 ELSE l_orderkey END AS l_orderkey) from (select *, row_number() over () as n from '{sf}/lineitem.parquet') where n < 400")
    con.execute(f"copy (select * exclude (n) from lineitem) to '{tmp_path}/lineitem.parquet'")
    got = catalogue.QUERIES["fill_boxes"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    want = con.execute(catalogue.ORACLES["fill_boxes"]).fetchall()
    assert len(want) < 390 and sorted(map(tuple, got.select("page_id", "first", "lines", "area").collect())) == sorted(want)


def test_outline_areas(spark):
    rng = np.random.default_rng(3)
    rows = []
    for page in range(12):
        corners = rng.integers(0, 40, (page % 5 + 2, 2)) / rng.choice([1, 2])
        rows.append((page, [(*map(float, a), *map(float, b)) for a, b in zip(corners, np.roll(corners, -1, 0), strict=True)]))
    rows += [(77, []), (78, None)]
    outlines = spark.createDataFrame(rows, "page_id long, edges array<struct<x0:double,y0:double,x1:double,y1:double>>")
    runs = geometry.fill(outlines.select("page_id", F.inline("edges")))
    want = runs.groupBy("page_id").agg(F.min("line"), F.max("line"), F.sum(F.col("hi") - F.col("lo") + 1))
    assert sorted(map(tuple, geometry.outline_areas(outlines).collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


@pytest.mark.parametrize(("crowd", "pieces"), [(10, 7), (10, 64), (50_000, 64)])
def test_nearest_in_sorted_order(spark, crowd, pieces):
    """Of another class in the same group, ties to the least id, nulls last; whether groups are cut or not."""
    rng = np.random.default_rng(1)
    rows = [(i, "AAB"[i % 3], None if i % 31 == 0 else int(rng.choice([1, 1, 1, 2, 3])), None if i % 23 == 0 else float(rng.integers(rng.choice([40, 2000])))) for i in range(400)]
    rows += [(900, "C", 1, None), (901, "C", 2, 5.0), (902, "C", 1, None), (903, "D", 1, 1.0), (904, "D", 1, 2.0)]
    want = {}
    for i, g, n, z in rows:
        far = [((z is None or y is None, (z - y) ** 2 if None not in (z, y) else 0, j), j, None if None in (z, y) else (z - y) ** 2) for j, h, m, y in rows if h == g and None not in (m, n) and m != n]
        if far:
            want[i] = min(far)[1:]
    df = spark.createDataFrame(rows, "id long, g string, n int, z double")
    got = match._nearest_on_a_line(df, crowd, pieces)
    assert {r["id"]: (r["near"], None if r["d2"] is None or math.isnan(r["d2"]) else r["d2"]) for r in got.collect()} == want


def test_leave_one_out_compares_no_pairs(spark, sf):
    plan = catalogue.QUERIES["loo_nn"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Inner" in x and "NOT" in x.upper() and "n#" in x]
