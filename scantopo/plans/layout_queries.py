"""Queries on grids, bands, rows and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantopo.operators import layout as L
from scantopo.operators import topology as T
from scantopo.plans.catalogue import query, table
from scantopo.plans.spatial_queries import B, boxes
from scantopo.plans.topology_queries import CELLS, RUNS, as_longs, docs
from scantopo.sources import text_raster as R


@query("text_scale", B + " SELECT page_id, list_sort(list(y1 - y0 + 1))[len(list(y1 - y0 + 1)) // 2 + 1] AS scale FROM b GROUP BY page_id")
def text_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("page_id").agg(L.upper_median(F.col("y1") - F.col("y0") + 1).alias("scale"))


@query("modal_height", B + ", n AS (SELECT page_id, round_even((y1 - y0 + 1) / 4.0::DOUBLE, 0) * 4 AS h, count(*) AS n FROM b GROUP BY ALL) SELECT page_id, arg_min(h, struct_pack(a := -n, b := h)) AS height FROM n GROUP BY page_id")
def modal_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("page_id").agg(L.mode_of((F.col("y1") - F.col("y0") + 1).cast("double"), 4.0).alias("height"))


_BAND = """r AS (SELECT page_id, y0, CAST(sum(f) OVER (PARTITION BY page_id ORDER BY y0) AS BIGINT) AS row FROM (SELECT page_id, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page_id ORDER BY y0) > 12 THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT page_id, y0 FROM b))),
k AS (SELECT page_id, x0, CAST(sum(f) OVER (PARTITION BY page_id ORDER BY x0) AS BIGINT) AS col FROM (SELECT page_id, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0) > 12 THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT page_id, x0 FROM b)))"""


@query("cell_grid", B + ", " + _BAND + """, rs AS (SELECT page_id, row, min(y0) AS p FROM r GROUP BY ALL), ks AS (SELECT page_id, col, min(x0) AS p FROM k GROUP BY ALL)
SELECT b.page_id, id, row, col, greatest(1, (SELECT count(*) FROM rs WHERE rs.page_id = b.page_id AND p >= b.y0 AND p < b.y1)) AS row_span, greatest(1, (SELECT count(*) FROM ks WHERE ks.page_id = b.page_id AND p >= b.x0 AND p < b.x1)) AS col_span
FROM b JOIN r ON r.page_id = b.page_id AND r.y0 = b.y0 JOIN k ON k.page_id = b.page_id AND k.x0 = b.x0""")
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(L.cell_grid(boxes(spark, sf_dir), 12), "row", "col", "row_span", "col_span")


@query("weight_classes", B + """, q AS (SELECT page_id, id, (x1 - x0 + 1)::DOUBLE / (y1 - y0 + 1) AS ratio FROM b), m AS (SELECT page_id, quantile_cont(ratio, 0.5) AS med FROM q GROUP BY page_id),
d AS (SELECT page_id, ratio, CAST(sum(f) OVER (PARTITION BY page_id ORDER BY ratio) AS BIGINT) AS weight FROM (SELECT page_id, ratio, CASE WHEN ratio - lag(ratio) OVER (PARTITION BY page_id ORDER BY ratio) > 0.25::DOUBLE * med THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT page_id, ratio FROM q) JOIN m USING (page_id))),
c AS (SELECT page_id, id, weight FROM q JOIN d USING (page_id, ratio)), o AS (SELECT page_id, arg_min(weight, struct_pack(a := -n, b := weight)) AS modal FROM (SELECT page_id, weight, count(*) AS n FROM c GROUP BY ALL) GROUP BY page_id)
SELECT page_id, id, weight, weight = o.modal AS modal FROM c JOIN o USING (page_id)""")
def weight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = boxes(spark, sf_dir).select("page_id", "id", ((F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)).alias("ratio"))
    return L.weight_classes(q)


@query("white_gaps", RUNS + " SELECT page_id, CAST(line AS BIGINT) AS line, hi + 1 AS lo, next - 1 AS hi FROM (SELECT *, lead(lo) OVER (PARTITION BY page_id, line ORDER BY lo) AS next FROM r) WHERE next - hi - 1 >= 4")
def white_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(L.white_gaps(R.runs(docs(spark, sf_dir)), 4), "line", "lo", "hi")


@query("widest_gap", "SELECT user_id, arg_max((value + next) / 2.0::DOUBLE, struct_pack(a := next - value, b := -value)) AS cut, max(next - value) AS gap FROM (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS next FROM events) WHERE next IS NOT NULL GROUP BY user_id")
def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.widest_gap(table(spark, sf_dir, "events"), ["user_id"], "value")


@query("gap_histogram", "SELECT CAST((g >= 0.1) AS BIGINT) + CAST((g >= 1) AS BIGINT) + CAST((g >= 5) AS BIGINT) + CAST((g >= 20) AS BIGINT) AS bin, count(*) AS n FROM (SELECT value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS g FROM events) WHERE g IS NOT NULL GROUP BY bin")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(L.gap_histogram(table(spark, sf_dir, "events"), ["user_id"], "value", [0.1, 1, 5, 20]), "bin")


@query("scripts", B + ", " + _BAND + """, q AS (SELECT b.page_id, id, row, y1, y1 - b.y0 + 1 AS h FROM b JOIN r ON r.page_id = b.page_id AND r.y0 = b.y0),
x AS (SELECT page_id, row, arg_min(h, struct_pack(a := -n, b := h)) AS x FROM (SELECT page_id, row, h, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL), f AS (SELECT page_id, row, arg_min(y1, struct_pack(a := -n, b := y1)) AS foot FROM (SELECT page_id, row, y1, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL)
SELECT page_id, id, CASE WHEN h / x < 0.8::DOUBLE AND abs(foot - y1) > 0.25::DOUBLE * x THEN CASE WHEN foot > y1 THEN 'super' ELSE 'sub' END ELSE 'none' END AS script FROM q JOIN x USING (page_id, row) JOIN f USING (page_id, row)""")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.bands(boxes(spark, sf_dir), ["page_id"], "y0", 12, "row").withColumn("h", F.col("y1") - F.col("y0") + 1)
    return L.scripts(b)


@query("rightmost", B + " SELECT page_id, arg_max(id, struct_pack(a := x1, b := -y1, c := -id)) AS id, round(arg_max(y1 - y0 + 1, struct_pack(a := x1, b := -y1, c := -id)) / quantile_cont(y1 - y0 + 1, 0.5), 9) AS ratio FROM b GROUP BY page_id")
def rightmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rightmost(boxes(spark, sf_dir))


_WIN = " UNION ALL ".join(
    f"SELECT page_id, row, pos, {k} AS k, {abs(k - 4)} + abs(sum(f0) OVER w - 100) + abs(sum(f1) OVER w - 80) AS d, count(*) OVER w AS c FROM v WINDOW w AS (PARTITION BY page_id, row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    for k in range(2, 7)
)


@query("locate_window", "WITH RECURSIVE " + B.removeprefix("WITH RECURSIVE ") + f""", v AS (SELECT page_id, y0 // 50 AS row, row_number() OVER (PARTITION BY page_id, y0 // 50 ORDER BY x0, id) AS pos, x1 - x0 + 1 AS f0, y1 - y0 + 1 AS f1 FROM b), a AS (SELECT * FROM ({_WIN}) WHERE c = k)
SELECT page_id, t.row AS row, CAST(t.k AS BIGINT) AS k, t.pos AS pos, CAST(t.d AS DOUBLE) AS d FROM (SELECT page_id, arg_min(struct_pack(row := row, k := k, pos := pos, d := d), struct_pack(d := d, row := row, k := k, pos := pos)) AS t FROM a GROUP BY page_id)""")
def locate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("row", F.floor(F.col("y0") / 50))
    pos = F.row_number().over(Window.partitionBy("page_id", "row").orderBy("x0", "id")).cast("long")
    v = b.select("page_id", "row", pos.alias("pos"), (F.col("x1") - F.col("x0") + 1).alias("f0"), (F.col("y1") - F.col("y0") + 1).alias("f1"))
    return as_longs(L.locate(v, [4, 100, 80]), "k")


@query("order_check", "SELECT CAST(0 AS BIGINT) AS out_of_order FROM region LIMIT 1")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs come in scan order within a page: each starts after the one before ends."""
    r = R.runs(docs(spark, sf_dir))
    w = Window.partitionBy("page_id", "line").orderBy("lo")
    return r.withColumn("bad", F.lag("hi").over(w) + 1 >= F.col("lo")).agg(F.count_if("bad").alias("out_of_order"))


@query("resample_lines", """WITH e AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events), p AS (SELECT line_id, pos, pos * 1.0::DOUBLE AS x, value AS y FROM e),
s AS (SELECT *, sum(step) OVER (PARTITION BY line_id ORDER BY pos) AS s FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos))),
l AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM s WINDOW w AS (PARTITION BY line_id ORDER BY pos)), t AS (SELECT line_id, i, max(s) * i / 9 AS t FROM s, range(10) r(i) GROUP BY line_id, i)
SELECT line_id, i, round(CASE WHEN s1 IS NULL THEN x WHEN s1 = s THEN x ELSE x + (t - s) / (s1 - s) * (x1 - x) END, 6) AS x, round(CASE WHEN s1 IS NULL THEN y WHEN s1 = s THEN y ELSE y + (t - s) / (s1 - s) * (y1 - y) END, 6) AS y FROM t JOIN l USING (line_id) WHERE t >= s AND (t < s1 OR s1 IS NULL)""")
def resample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = e.select(F.col("user_id").alias("line_id"), pos.alias("pos"), "value").select("line_id", "pos", F.col("pos").cast("double").alias("x"), F.col("value").alias("y"))
    return as_longs(L.resample(p, 10).select("line_id", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), "i")


@query("fit_line", "SELECT page_id AS line_id, max(y0) - min(y0) > max(x0) - min(x0) AS tall, round(CASE WHEN max(y0) - min(y0) > max(x0) - min(x0) THEN regr_slope(x0, y0) ELSE regr_slope(y0, x0) END, 6) + 0.0::DOUBLE AS slope, round(CASE WHEN max(y0) - min(y0) > max(x0) - min(x0) THEN regr_intercept(x0, y0) ELSE regr_intercept(y0, x0) END, 5) + 0.0::DOUBLE AS intercept FROM b GROUP BY page_id".join([B + " ", ""]))
def fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select(F.col("page_id").alias("line_id"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    f = L.fit_line(b)
    return f.select("line_id", "tall", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("intercept", 5) + 0.0).alias("intercept"))


@query("ink_seam", f"""WITH RECURSIVE {CELLS}, k AS (SELECT page_id, line // 8 AS yb, x // 8 AS bx, CAST(count(*) FILTER (ink) AS BIGINT) AS ink FROM px GROUP BY ALL), m AS (SELECT page_id, max(yb) AS last FROM k WHERE ink > 0 GROUP BY page_id),
g AS (SELECT m.page_id, last, y.i AS yb, x.i AS bx, coalesce(k.ink, 0) AS ink FROM m, range(4000) y(i), range(8) x(i) LEFT JOIN k ON k.page_id = m.page_id AND k.yb = y.i AND k.bx = x.i WHERE y.i <= last),
w AS (SELECT page_id, yb, last, list(ink ORDER BY bx) AS c FROM g GROUP BY ALL),
d AS (SELECT page_id, yb, last, c FROM w WHERE yb = 0 UNION ALL SELECT d.page_id, w.yb, w.last, list_transform(range(8), lambda x: w.c[x + 1] + list_min(d.c[greatest(1, x):least(8, x + 2)])) FROM d JOIN w ON w.page_id = d.page_id AND w.yb = d.yb + 1)
SELECT page_id, list_min(c) AS cost FROM d WHERE yb = last""")
def ink_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least ink a path from top to bottom must cross, in blocks of 8 by 8."""
    blocks = T.block_histogram(R.runs(docs(spark, sf_dir)), 8)
    return L.seam(blocks, 8).select("page_id", "cost")
