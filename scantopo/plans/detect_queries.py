"""Queries on spaces, warps and objects of pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantopo.operators import detect as D
from scantopo.operators import formulas as FM
from scantopo.operators import geometry as G
from scantopo.operators import kernel
from scantopo.operators import topology as T
from scantopo.plans.catalogue import query, table
from scantopo.plans.spatial_queries import B, GROUPS, boxes
from scantopo.plans.topology_queries import _SIDES, CELLS, RUNS, _regions, as_longs, docs
from scantopo.sources import documents
from scantopo.sources import text_raster as R


@query("affine_boxes", B + " SELECT page_id, id, least(2 * x0 - y0, 2 * x1 - y0, 2 * x0 - y1, 2 * x1 - y1) * 1.0::DOUBLE AS x0, least(y0, y1) * 3.0::DOUBLE + 5 AS y0, greatest(2 * x0 - y0, 2 * x1 - y0, 2 * x0 - y1, 2 * x1 - y1) * 1.0::DOUBLE AS x1, greatest(y0, y1) * 3.0::DOUBLE + 5 AS y1 FROM b")
def affine_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes through two maps between three spaces."""
    s = G.Spaces()
    s.add("page", "sheared", (2.0, 0.0, -1.0, 1.0, 0.0, 0.0))
    s.add("sheared", "out", (1.0, 0.0, 0.0, 3.0, 0.0, 5.0))
    out = G.box(s.between("page", "out"), *[F.col(k) for k in ("x0", "y0", "x1", "y1")])
    return boxes(spark, sf_dir).select("page_id", "id", *[c.alias(k) for c, k in zip(out, ("x0", "y0", "x1", "y1"), strict=True)])


@query("warp_runs", RUNS + " SELECT page_id, CAST(line + 3 AS BIGINT) AS line, lo + 5 AS lo, hi + 5 AS hi FROM r")
def warp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages moved by whole pixels keep their runs."""
    return as_longs(G.transport(R.runs(docs(spark, sf_dir)), (1.0, 0.0, 0.0, 1.0, 5.0, 3.0), 80, 1 << 20), "line", "lo", "hi")


@query("fill_boxes", B + " SELECT page_id * 100 + id AS page_id, CAST(min(y0) AS BIGINT) AS first, CAST(max(y1) - min(y0) AS BIGINT) AS lines, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM b WHERE y1 > y0 GROUP BY ALL")
def fill_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of boxes, filled by winding, each as a row; ``G.fill`` is for edges from elsewhere."""
    b = boxes(spark, sf_dir).filter("y1 > y0")
    side = lambda *k: F.struct(*[F.col(c).alias(n) for c, n in zip(k, ("x0", "y0", "x1", "y1"), strict=True)])
    edges = F.array(side("x0", "y0", "x1", "y0"), side("x1", "y0", "x1", "y1"), side("x1", "y1", "x0", "y1"), side("x0", "y1", "x0", "y0"))
    r = G.outline_areas(b.select((F.col("page_id") * 100 + F.col("id")).alias("page_id"), edges.alias("edges")))
    return r.groupBy("page_id").agg(F.min("first").alias("first"), (F.max("last") - F.min("first") + 1).alias("lines"), F.sum("area").alias("area"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of text pages with area, box and the region around each; ids of the two kinds apart."""
    ink, ground = _regions(spark, sf_dir)
    tag = lambda d, k: d.groupBy("page_id", "comp").agg(*T.moment_columns()).withColumn("kind", F.lit(k))
    m = tag(ink, "ink").unionByName(tag(ground, "ground"))
    p = T.contain(ink, ground).select("page_id", "kind", "comp", "parent")
    return m.join(p, ["page_id", "kind", "comp"]).select("page_id", F.col("comp").alias("id"), "kind", "parent", "area", "x0", "y0", "x1", "y1")


@query("page_objects")
def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each page, found within the page pass; ``D.page_objects`` is for regions from elsewhere."""

    def f(texts):
        r = kernel.regions(R.rasterise(texts), R.heights(texts), R.WIDTH)
        at, kind, holes, rank = D.objects_of(r, len(texts))
        box = [r[k][at].astype(np.int32) for k in ("x0", "y0", "x1", "y1")]
        return r["page"][at], [r["id"][at], pa.array(kind, pa.string()), *box, r["area"][at], holes, rank.astype(np.int32)]

    return R.pages(docs(spark, sf_dir), f, "id long, type string, x0 int, y0 int, x1 int, y1 int, area long, holes long, rank int")


@query("table_cells")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each page's table, found within the page pass; ``D.table_cells`` is for regions from elsewhere."""

    def f(texts):
        r = kernel.regions(R.rasterise(texts), R.heights(texts), R.WIDTH)
        at, best, row, col, rows, cols = D.cells_of(r, len(texts), 1)
        return r["page"][at], [best, r["id"][at], row, col, rows.astype(np.int32), cols.astype(np.int32)]

    return R.pages(docs(spark, sf_dir), f, "table long, id long, row long, col long, row_span int, col_span int")


_READ = "SELECT l_orderkey AS page_id, l_linenumber AS row, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE {} GROUP BY ALL"


def _readings(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").filter(where)
    return t.groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query("compare_readings", f"""WITH a AS ({_READ.format("l_linestatus = 'F'")}), b AS ({_READ.format("l_linestatus <> 'F'")})
SELECT page_id, row, CAST(abs(coalesce(a.n, 0) - coalesce(b.n, 0)) + abs(coalesce(a.q, 0) - coalesce(b.q, 0)) AS BIGINT) AS distance, CAST(abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS BIGINT) AS comp_delta,
abs(coalesce(a.n, 0) - coalesce(b.n, 0)) + abs(coalesce(a.q, 0) // 25 * 25 - coalesce(b.q, 0) // 25 * 25) = abs(coalesce(a.n, 0) - coalesce(b.n, 0)) + abs(coalesce(a.q, 0) - coalesce(b.q, 0)) AS scale_stable FROM a FULL JOIN b USING (page_id, row)""")
def compare_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each row, and whether they differ as much once read coarsely."""
    a, b = (_readings(spark, sf_dir, w) for w in ("l_linestatus = 'F'", "l_linestatus <> 'F'"))
    coarse = [d.withColumn("q", F.call_function("div", F.col("q"), F.lit(25)) * 25) for d in (a, b)]
    return D.compare(a, b, ["n", "q"], D.compare(*coarse, ["n", "q"]))


@query("three_way", f"""WITH a AS ({_READ.format("l_returnflag = 'A'")}), n AS ({_READ.format("l_returnflag = 'N'")}), r AS ({_READ.format("l_returnflag = 'R'")}),
j AS (SELECT page_id, row, a.n AS an, a.q AS aq, n.n AS nn, n.q AS nq, r.n AS rn, r.q AS rq FROM a FULL JOIN n USING (page_id, row) FULL JOIN r USING (page_id, row))
SELECT page_id, row, abs(an - nn) + abs(aq - nq) AS a_n, abs(an - rn) + abs(aq - rq) AS a_r, abs(nn - rn) + abs(nq - rq) AS n_r, concat_ws(',', CASE WHEN an IS NULL THEN 'a' END, CASE WHEN nn IS NULL THEN 'n' END, CASE WHEN rn IS NULL THEN 'r' END) AS missing FROM j""")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of each row against one another, and which are missing."""
    t = D.three_way({k.lower(): _readings(spark, sf_dir, f"l_returnflag = '{k}'") for k in "ANR"}, ["n", "q"])
    return t.withColumn("missing", F.array_join("missing", ","))


@query("lines_json_sink")
def lines_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("page_id", "id", F.col("label").alias("type"), "x0", "y0", "x1", "y1", F.lit(300.0).alias("dpi"))
    return documents.page_json(b)


@query("regions_json_scan", B + " SELECT page_id, CAST(page AS BIGINT) AS page, CAST(region_id AS BIGINT) AS region_id, label, x0 * 1.0::DOUBLE AS x0, y0 * 1.0::DOUBLE AS y0, x1 * 1.0::DOUBLE AS x1, y1 * 1.0::DOUBLE AS y1 FROM (SELECT page_id, 1 AS page, row_number() OVER (PARTITION BY page_id ORDER BY id) - 1 AS region_id, label, x0, y0, x1, y1 FROM b)")
def regions_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region files written as JSON and read again."""
    region = F.struct(F.col("x0").alias("top_left_x"), F.col("y0").alias("top_left_y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(F.col("label").alias("type"), region.alias("region")).alias("l")))), lambda s: s["l"])
    p = boxes(spark, sf_dir).groupBy("page_id").agg(lines.alias("lines"))
    j = p.select("page_id", F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("page"), "lines")).alias("pages"))).alias("json"))
    return as_longs(documents.regions(j, "json", "page_id"), "page", "region_id")


@query("event_properties", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS kinds, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY event_type")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("props").alias("kinds"), F.sum(F.length("props")).alias("chars"))


@query("rule_context", RUNS + """, q AS (SELECT page_id, id, x0, y0, x1, y1, x1 - x0 + 1 AS w FROM b WHERE x1 - x0 + 1 >= 20 * (y1 - y0 + 1)),
s AS (SELECT page_id, id, x0, x1, w, 'above' AS side, greatest(0, y0 - w) AS a, y0 - 1 AS z FROM q UNION ALL SELECT page_id, id, x0, x1, w, 'below', y1 + 1, y1 + w FROM q),
n AS (SELECT s.page_id, id, side, any_value(w * (z - a + 1)) AS t, sum(CASE WHEN lo IS NULL THEN 0 ELSE greatest(0, least(hi, x1) - greatest(lo, x0) + 1) END) AS n FROM s LEFT JOIN r ON r.page_id = s.page_id AND line BETWEEN a AND z AND hi >= x0 AND lo <= x1 WHERE a <= z GROUP BY ALL)
SELECT q.page_id, q.id, round(coalesce(any_value(CASE WHEN side = 'above' THEN coalesce(n, 0)::DOUBLE / t END), 0), 9) AS above, round(coalesce(any_value(CASE WHEN side = 'below' THEN coalesce(n, 0)::DOUBLE / t END), 0), 9) AS below FROM q LEFT JOIN n USING (page_id, id) GROUP BY ALL""".replace("FROM b WHERE", "FROM (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax) AS id, (l_partkey * 37) % 200 AS x0, (l_suppkey * 53) % 200 AS y0, (l_partkey * 37) % 200 + CAST(l_quantity AS BIGINT) AS x1, (l_suppkey * 53) % 200 + l_partkey % 40 AS y1 FROM lineitem) WHERE"))
def rule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of a text page in the bands above and below each level rule of the order of its number."""
    b = boxes(spark, sf_dir).filter("x1 - x0 + 1 >= 20 * (y1 - y0 + 1)")
    r = FM.rule_context(R.runs(docs(spark, sf_dir)), b)
    return r.select("page_id", "id", F.round("above", 9).alias("above"), F.round("below", 9).alias("below"))


@query("greedy_rows")
def greedy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.greedy_rows(boxes(spark, sf_dir))


@query("glyph_parts", B + """, q AS (SELECT *, y0 // 50 AS row FROM b), l AS (SELECT a.page_id, a.id AS a, k.id AS b FROM q a JOIN q k ON a.page_id = k.page_id AND a.row = k.row AND a.id < k.id
WHERE least(a.x1, k.x1) - greatest(a.x0, k.x0) + 1 >= 0.5::DOUBLE * least(a.x1 - a.x0 + 1, k.x1 - k.x0 + 1) AND least(a.y1, k.y1) - greatest(a.y0, k.y0) <= 0.5::DOUBLE * least(a.y1 - a.y0, k.y1 - k.y0, 1) AND greatest(a.y0, k.y0) - least(a.y1, k.y1) <= 2.5::DOUBLE * greatest(a.y1 - a.y0, k.y1 - k.y0, 1))""" + GROUPS + " SELECT page_id, id, grp FROM cc")
def glyph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = boxes(spark, sf_dir).withColumn("row", F.floor(F.col("y0") / 50))
    return FM.parts_of_glyphs(g).select("page_id", "id", "grp")


@query("row_modes", B + """, q AS (SELECT page_id, y0 // 50 AS row, y1 - y0 + 1 AS h, x1 - x0 + 1 AS w FROM b), k AS (SELECT page_id, row FROM q GROUP BY ALL HAVING count(*) >= 2 AND quantile_cont(h, 0.5) >= 20),
h AS (SELECT page_id, row, arg_min(h, struct_pack(a := -n, b := h)) AS h FROM (SELECT page_id, row, h, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL), w AS (SELECT page_id, row, arg_min(w, struct_pack(a := -n, b := w)) AS w FROM (SELECT page_id, row, w, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL)
SELECT page_id, row, h::DOUBLE / w AS ratio FROM k JOIN h USING (page_id, row) JOIN w USING (page_id, row)""")
def row_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.row_modes(boxes(spark, sf_dir).withColumn("row", F.floor(F.col("y0") / 50)), least=2, height=20)


@query("leading_block", """WITH p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderstatus = 'O' AS good FROM orders),
g AS (SELECT doc, page, sum(CASE WHEN page - lag > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page) AS part FROM (SELECT doc, page, lag(page) OVER (PARTITION BY doc ORDER BY page) AS lag FROM p WHERE good))
SELECT doc, first, last, n FROM (SELECT DISTINCT doc FROM p) LEFT JOIN (SELECT doc, min(page) AS first, max(page) AS last, count(*) AS n FROM g WHERE part = 0 GROUP BY doc) USING (doc)""")
def leading_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), page.alias("page"), (F.col("o_orderstatus") == "O").alias("good"))
    return as_longs(FM.leading_block(p, "doc", "good"), "first", "last")


@query("stroke_width", f"WITH {CELLS}, p AS (SELECT page_id, line, x FROM px WHERE ink), k AS (SELECT page_id, count(*) AS k FROM ({_SIDES}) GROUP BY ALL) SELECT page_id, round(2.0::DOUBLE * count(*) / any_value(k), 9) AS width FROM p JOIN k USING (page_id) GROUP BY page_id")
def stroke_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the area over the boundary's length."""
    r = R.runs(docs(spark, sf_dir))
    side = T.cracks(r).groupBy("page_id").agg(F.sum("n").alias("c"))
    area = r.groupBy("page_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("a"))
    return area.join(side, "page_id").select("page_id", F.round(2.0 * F.col("a") / F.col("c"), 9).alias("width"))
