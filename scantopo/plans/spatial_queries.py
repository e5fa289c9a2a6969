"""Queries on boxes: the lines of an order as components and regions of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantopo.operators import spatial as S
from scantopo.plans.catalogue import query, table

GROW = 40
KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax"]


def boxes_sql(page: str = "l_orderkey", key: str = ", ".join(["l_orderkey", *KEY])) -> str:
    return f"""b AS (SELECT {page} AS page_id, row_number() OVER (PARTITION BY {page} ORDER BY {key}) AS id, (l_partkey * 37) % 200 AS x0, (l_suppkey * 53) % 200 AS y0,
  (l_partkey * 37) % 200 + CAST(l_quantity AS BIGINT) AS x1, (l_suppkey * 53) % 200 + l_partkey % 40 AS y1, l_linestatus <> 'F' AS ink, l_returnflag AS label FROM lineitem),
i AS (SELECT * FROM b WHERE ink), g AS (SELECT page_id, id, x0 - {GROW} AS x0, y0 - {GROW} AS y0, x1 + {GROW} AS x1, y1 + {GROW} AS y1, label FROM b WHERE NOT ink)"""


B = "WITH RECURSIVE " + boxes_sql()
IN = "a.x0 >= k.x0 AND a.y0 >= k.y0 AND a.x1 <= k.x1 AND a.y1 <= k.y1"
MEET = "a.x1 >= k.x0 AND a.x0 <= k.x1 AND a.y1 >= k.y0 AND a.y0 <= k.y1"
MID = "a.x0 + a.x1 BETWEEN 2 * k.x0 AND 2 * k.x1 AND a.y0 + a.y1 BETWEEN 2 * k.y0 AND 2 * k.y1"


def boxes(spark: SparkSession, sf_dir: str, page: str = "l_orderkey") -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy(page).orderBy("l_orderkey", *KEY))
    x0, y0 = F.pmod(F.col("l_partkey") * 37, F.lit(200)), F.pmod(F.col("l_suppkey") * 53, F.lit(200))
    return t.select(F.col(page).alias("page_id"), rank.cast("long").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("long")).alias("x1"), (y0 + F.pmod("l_partkey", F.lit(40))).alias("y1"), (F.col("l_linestatus") != "F").alias("ink"), F.col("l_returnflag").alias("label"))


def sides(spark: SparkSession, sf_dir: str, page: str = "l_orderkey") -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir, page)
    grown = b.filter("not ink").withColumns({"x0": F.col("x0") - GROW, "y0": F.col("y0") - GROW, "x1": F.col("x1") + GROW, "y1": F.col("y1") + GROW})
    return b.filter("ink"), grown


def _cover(base: str) -> str:
    return base + f""", h AS (SELECT a.page_id, a.id, k.id AS region, {IN} AS inside FROM i a JOIN g k ON a.page_id = k.page_id AND {MEET}),
s AS (SELECT page_id, id, count(*) FILTER (inside) AS n FROM h GROUP BY ALL),
c AS (SELECT i.page_id, 'ink' AS side, i.id, CASE WHEN n IS NULL THEN 'MISSED' WHEN n > 1 THEN 'OVERLAPPING' WHEN n = 1 THEN 'INSIDE' ELSE 'STRADDLE' END AS class FROM i LEFT JOIN s USING (page_id, id)
UNION ALL SELECT page_id, 'region', id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.page_id = g.page_id AND h.region = g.id) THEN 'HIT' ELSE 'EMPTY' END FROM g)"""


COVER = _cover(B)


@query("coverage_classes", COVER + " SELECT * FROM c")
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(*sides(spark, sf_dir))


_REPORT = " SELECT side, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 9) AS share FROM c GROUP BY side, class"


@query("coverage_report", COVER + _REPORT)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage_report(S.coverage(*sides(spark, sf_dir)))


@query("coverage_crowded_pages", _cover("WITH RECURSIVE " + boxes_sql("l_suppkey")) + _REPORT)
def coverage_crowded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of hundreds of boxes (one for each supplier), joined tile by tile."""
    return S.coverage_report(S.coverage(*sides(spark, sf_dir, "l_suppkey"), tile=64))


@query("residual_members", COVER + """ SELECT page_id, class, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, CAST(sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS BIGINT) AS pixels FROM c JOIN b USING (page_id, id) WHERE side = 'ink' GROUP BY page_id, class""")
def residual_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual report: members of each class of ink on each page and how many pixels they cover."""
    ink, regions = sides(spark, sf_dir)
    c = S.coverage(ink, regions).filter("side = 'ink'").join(ink.alias("b"), ["page_id", "id"])
    members = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return c.groupBy("page_id", "class").agg(F.count(F.lit(1)).alias("n"), members.alias("members"), F.sum(S.size("b")).alias("pixels"))


@query("gold_match", B + f""", h AS (SELECT a.page_id, a.id AS c, k.id AS k, count(*) OVER (PARTITION BY a.page_id, a.id) AS glyphs, count(*) OVER (PARTITION BY a.page_id, k.id) AS parts FROM i a JOIN g k ON a.page_id = k.page_id AND {MID})
SELECT i.page_id, 'component' AS side, i.id, CASE WHEN n IS NULL THEN 'IMAGE_ONLY' WHEN n > 1 THEN 'MERGED' WHEN m > 1 THEN 'SPLIT' ELSE 'ONE' END AS kind FROM i LEFT JOIN (SELECT page_id, c AS id, max(glyphs) AS n, max(parts) AS m FROM h GROUP BY ALL) USING (page_id, id)
UNION ALL SELECT g.page_id, 'glyph', g.id, CASE WHEN n IS NULL THEN 'MISSING_INK' WHEN n > 1 THEN 'SPLIT' WHEN m > 1 THEN 'MERGED' ELSE 'ONE' END FROM g LEFT JOIN (SELECT page_id, k AS id, max(parts) AS n, max(glyphs) AS m FROM h GROUP BY ALL) USING (page_id, id)""")
def gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.match(*sides(spark, sf_dir))


@query("label_transfer", B + f" SELECT a.page_id, a.id, any_value(k.label) AS label FROM i a JOIN g k ON a.page_id = k.page_id AND {MID} GROUP BY ALL HAVING count(*) = 1")
def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_transfer(*sides(spark, sf_dir), "label")


@query("free_rules", B + f" SELECT page_id, id FROM i a WHERE greatest(x1 - x0 + 1, y1 - y0 + 1) >= 20 * least(x1 - x0 + 1, y1 - y0 + 1) AND NOT EXISTS (SELECT 1 FROM g k WHERE k.page_id = a.page_id AND {IN})")
def free_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink, regions = sides(spark, sf_dir)
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return S.not_inside(ink.filter(S.is_rule(w * h, w, h)), regions).select("page_id", "id")


@query("innermost_container", B + f" SELECT a.page_id, a.id, arg_min(k.id, struct_pack(s := (k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1), i := k.id)) AS region FROM i a JOIN g k ON a.page_id = k.page_id AND {IN} GROUP BY ALL")
def innermost_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.innermost(*sides(spark, sf_dir))


@query("depths", B + f" SELECT a.page_id, a.id, count(k.id) AS depth FROM b a LEFT JOIN b k ON a.page_id = k.page_id AND {IN} AND (k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1) > (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) GROUP BY ALL")
def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depth_of(boxes(spark, sf_dir))


@query("largest_hole", "WITH RECURSIVE " + boxes_sql("l_suppkey") + """ SELECT k.page_id, k.id, arg_min(a.id, struct_pack(s := -(a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1), i := a.id)) AS hole FROM b a JOIN b k ON a.page_id = k.page_id AND a.id <> k.id
AND a.x0 >= k.x0 AND a.y0 >= k.y0 AND a.x1 <= k.x1 AND a.y1 <= k.y1 AND 2 * (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) >= (k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1) GROUP BY ALL""")
def largest_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir, "l_suppkey")
    return S.largest_hole(b, b)


@query("los_edges", B + """, c AS (SELECT page_id, id, x0, y0, x1, y1, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy FROM b),
p AS (SELECT a.page_id, a.id AS a, k.id AS b, a.cx AS ax, a.cy AS ay, k.cx - a.cx AS dx, k.cy - a.cy AS dy FROM c a JOIN c k ON a.page_id = k.page_id AND a.id < k.id)
SELECT page_id, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.page_id = p.page_id AND k.id <> a AND k.id <> b AND NOT (dx = 0 AND (ax < k.x0 OR ax > k.x1)) AND NOT (dy = 0 AND (ay < k.y0 OR ay > k.y1))
AND greatest(0.02::DOUBLE, CASE WHEN dx = 0 THEN 0.02::DOUBLE ELSE least((k.x0 - ax) / dx, (k.x1 - ax) / dx) END, CASE WHEN dy = 0 THEN 0.02::DOUBLE ELSE least((k.y0 - ay) / dy, (k.y1 - ay) / dy) END)
 <= least(0.98::DOUBLE, CASE WHEN dx = 0 THEN 0.98::DOUBLE ELSE greatest((k.x0 - ax) / dx, (k.x1 - ax) / dx) END, CASE WHEN dy = 0 THEN 0.98::DOUBLE ELSE greatest((k.y0 - ay) / dy, (k.y1 - ay) / dy) END))""")
def los_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sight(boxes(spark, sf_dir))


@query("knn_edges", B + """, d AS (SELECT a.page_id, a.id AS i, k.id AS j, (a.x0 + a.x1 - k.x0 - k.x1) ** 2 + (a.y0 + a.y1 - k.y0 - k.y1) ** 2 AS d FROM b a JOIN b k ON a.page_id = k.page_id AND a.id <> k.id),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, i ORDER BY d, j) AS r FROM d) SELECT DISTINCT page_id, least(i, j) AS a, greatest(i, j) AS b FROM r WHERE r <= 2""")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_edges(boxes(spark, sf_dir), 2)


@query("stacked_pairs", B + """, q AS (SELECT *, greatest(x1 - x0 + 1, y1 - y0 + 1) >= 20 * least(x1 - x0 + 1, y1 - y0 + 1) AS rule FROM b),
m AS (SELECT page_id, quantile_cont(y1 - y0 + 1, 0.5) AS med FROM q WHERE NOT rule GROUP BY page_id), v AS (SELECT q.*, med FROM q JOIN m USING (page_id)),
p AS (SELECT a.page_id, a.id AS a, k.id AS b, a.y1 AS y0, k.y0 AS y1, greatest(a.x0, k.x0) AS x0, least(a.x1, k.x1) AS x1, abs(a.x0 + a.x1 - k.x0 - k.x1) / 2.0::DOUBLE <= 0.15::DOUBLE * greatest(a.x1 - a.x0 + 1, k.x1 - k.x0 + 1) AS mid
 FROM v a JOIN v k ON a.page_id = k.page_id AND NOT a.rule AND NOT k.rule AND k.y0 - a.y1 > 0 AND k.y0 - a.y1 <= 1.5 * a.med AND 2 * (least(a.x1, k.x1) - greatest(a.x0, k.x0) + 1) >= least(a.x1 - a.x0 + 1, k.x1 - k.x0 + 1)),
t AS (SELECT p.page_id, p.a, p.b, k.rule FROM p JOIN v k ON k.page_id = p.page_id AND k.id <> p.a AND k.id <> p.b AND k.y0 > p.y0 AND k.y1 < p.y1 AND k.x0 <= p.x1 AND k.x1 >= p.x0)
SELECT page_id, a, b, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.page_id = p.page_id AND t.a = p.a AND t.b = p.b AND rule) THEN 'fraction' WHEN mid THEN 'stacked_centred' ELSE 'stacked_offset' END AS kind
FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_id = p.page_id AND t.a = p.a AND t.b = p.b AND NOT rule)""")
def stacked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return S.stacked_pairs(boxes(spark, sf_dir).withColumn("rule", S.is_rule(w * h, w, h)))


GROUPS = """, two AS (SELECT page_id, a, b FROM l UNION ALL SELECT page_id, b, a FROM l),
cc(page_id, id, grp) USING KEY (page_id, id) AS (SELECT page_id, id, id FROM b UNION
  SELECT two.page_id, two.b, min(cc.grp) FROM cc JOIN two ON two.page_id = cc.page_id AND two.a = cc.id JOIN recurring.cc AS old ON old.page_id = two.page_id AND old.id = two.b WHERE cc.grp < old.grp GROUP BY two.page_id, two.b)"""
GAP = "greatest(0, a.x0 - k.x1, k.x0 - a.x1, a.y0 - k.y1, k.y0 - a.y1)"


@query("single_linkage", B + f""", m AS (SELECT page_id, quantile_cont(x1 - x0 + 1, 0.5) AS med FROM b GROUP BY page_id),
l AS (SELECT a.page_id, a.id AS a, k.id AS b FROM b a JOIN b k ON a.page_id = k.page_id AND a.id < k.id JOIN m ON m.page_id = a.page_id WHERE {GAP} <= med)""" + GROUPS + " SELECT page_id, id, grp FROM cc")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.linkage(boxes(spark, sf_dir)).select("page_id", "id", "grp")


@query("merge_boxes_round", B + f", l AS (SELECT a.page_id, a.id AS a, k.id AS b FROM b a JOIN b k ON a.page_id = k.page_id AND a.id < k.id WHERE {GAP} <= 10)" + GROUPS + " SELECT page_id, grp AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM cc JOIN b USING (page_id, id) GROUP BY page_id, grp")
def merge_boxes_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_round(boxes(spark, sf_dir), 10)


@query("iou_match", B + f""", p AS (SELECT a.page_id, a.id AS t, k.id AS k, ((least(a.x1, k.x1) - greatest(a.x0, k.x0) + 1) * (least(a.y1, k.y1) - greatest(a.y0, k.y0) + 1))::DOUBLE / ((a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) + (k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1) - (least(a.x1, k.x1) - greatest(a.x0, k.x0) + 1) * (least(a.y1, k.y1) - greatest(a.y0, k.y0) + 1)) >= 0.1::DOUBLE AS good
 FROM i a JOIN g k ON a.page_id = k.page_id AND {MEET}), s AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY page_id, k) AS shared FROM p),
t AS (SELECT page_id, t AS id, count(*) FILTER (good) AS g, max(shared) FILTER (good) AS s FROM s GROUP BY ALL)
SELECT i.page_id, 'truth' AS side, i.id, CASE WHEN g IS NULL THEN 'missed' WHEN g = 0 THEN 'fragmented' WHEN g > 1 THEN 'split' WHEN s > 1 THEN 'merged' ELSE 'matched' END AS kind FROM i LEFT JOIN t USING (page_id, id)
UNION ALL SELECT g.page_id, 'block', g.id, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.page_id = g.page_id AND p.k = g.id) THEN 'used' ELSE 'spurious' END FROM g""")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.iou_match(*sides(spark, sf_dir), least=0.1)


@query("region_fit", B + f""" SELECT page_id, region, n, round(s / t, 9) AS excess FROM (SELECT a.page_id, k.id AS region, count(*) AS n, ((max(a.x1) - min(a.x0) + 1) * (max(a.y1) - min(a.y0) + 1))::DOUBLE AS s, max((k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1)) AS t
FROM i a JOIN g k ON a.page_id = k.page_id AND {MID} AND a.x1 - a.x0 <= k.x1 - k.x0 AND a.y1 - a.y0 <= k.y1 - k.y0 GROUP BY ALL)""")
def region_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fit_in_regions(*sides(spark, sf_dir))


_SHARE = "SELECT page_id, id, (x0 - min(x0) OVER w)::DOUBLE / greatest(1, max(x1) OVER w - min(x0) OVER w) AS x0, (y0 - min(y0) OVER w)::DOUBLE / greatest(1, max(y1) OVER w - min(y0) OVER w) AS y0, (x1 - min(x0) OVER w)::DOUBLE / greatest(1, max(x1) OVER w - min(x0) OVER w) AS x1, (y1 - min(y0) OVER w)::DOUBLE / greatest(1, max(y1) OVER w - min(y0) OVER w) AS y1 FROM {t} WINDOW w AS (PARTITION BY page_id)"


@query("unmatched_boxes", B + f", u AS ({_SHARE.format(t='i')}), v AS ({_SHARE.format(t='g')}) SELECT page_id, id FROM u a WHERE NOT EXISTS (SELECT 1 FROM v k WHERE k.page_id = a.page_id AND a.x0 < k.x1 AND a.x1 > k.x0 AND a.y0 < k.y1 AND a.y1 > k.y0)")
def unmatched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unmatched(*sides(spark, sf_dir))
