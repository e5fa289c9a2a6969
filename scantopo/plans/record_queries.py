"""Queries on records of pages: glyphs, rules, foreign ink, drift, evidence, plans of runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantopo.functions import evidence as E
from scantopo.operators import geometry as G
from scantopo.operators import kernel
from scantopo.operators import records as Q
from scantopo.operators import topology as T
from scantopo.plans.catalogue import query, table
from scantopo.plans.spatial_queries import GAP, GROUPS, B, boxes
from scantopo.plans.topology_queries import CELLS, E8, EDGES, LABELS, RUNS, docs
from scantopo.sources import text_raster as R

#: Points of a pixel, lines of a row of glyphs, lines of a crop.
PT, ROW, CROP = 0.24, 8, 16
_RECORD = "id long, x0 long, y0 long, x1 long, y1 long, holes long, " + ", ".join(f"{k} long" for k in Q.SUMS)
COMPONENTS = """, w AS (SELECT n.page_id, CAST(cc.comp % 1000000 AS BIGINT) AS id, min(lo) AS x0, CAST(min(line) AS BIGINT) AS y0, max(hi) AS x1, CAST(max(line) AS BIGINT) AS y1, CAST(sum(hi - lo + 1) AS BIGINT) AS area,
  CAST(sum((lo + hi) * (hi - lo + 1) // 2) AS BIGINT) AS sx, CAST(sum(line * (hi - lo + 1)) AS BIGINT) AS sy, CAST(sum(coalesce(m, 0)) - count(*) + 1 AS BIGINT) AS holes, count(*) AS n_runs
  FROM n JOIN cc USING (id) LEFT JOIN (SELECT b, count(*) AS m FROM e GROUP BY b) k ON k.b = n.id GROUP BY n.page_id, cc.comp)"""


def components(spark: SparkSession, sf_dir: str, crop: int | None = None) -> DataFrame:
    """Components of text pages, or of their crops of ``crop`` lines, as records made in the page pass."""

    def f(texts):
        r = R.rasterise(texts)
        page = r.page
        if crop:
            key = np.stack([r.page, r.line // crop])
            new = np.r_[False, np.any(key[:, 1:] != key[:, :-1], axis=0)] if len(r) else np.zeros(0, bool)
            r = kernel.Runs(np.cumsum(new), r.line, r.lo, r.hi)
        c = kernel.components(r)
        at = c["first"]
        return page[at], [r.line[at] * R.WIDTH + r.lo[at], *[c[k] for k in ("x0", "y0", "x1", "y1")], c["n_edges"] - c["n_runs"] + 1, *[c[k] for k in Q.SUMS]]

    return R.pages(docs(spark, sf_dir), f, _RECORD)


@query("rule_records", E8 + LABELS + COMPONENTS + f" SELECT page_id, id, round(area / greatest(x1 - x0 + 1, y1 - y0 + 1) * {PT}::DOUBLE, 9) AS width_pt, CASE WHEN x1 - x0 >= y1 - y0 THEN 'h' ELSE 'v' END AS orient FROM w")
def rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component measured as a stroke."""
    return Q.rule_records(components(spark, sf_dir), PT).withColumn("width_pt", F.round("width_pt", 9))


_PARTS = """, b AS (SELECT *, y0 // 8 AS row FROM w WHERE NOT (area::DOUBLE / ((x1 - x0 + 1) * (y1 - y0 + 1)) > 0.8::DOUBLE AND greatest(x1 - x0 + 1, y1 - y0 + 1) >= 20 * greatest(1, least(x1 - x0 + 1, y1 - y0 + 1)))),
l AS (SELECT a.page_id, a.id AS a, k.id AS b FROM b a JOIN b k ON a.page_id = k.page_id AND a.row = k.row AND a.id < k.id
WHERE least(a.x1, k.x1) - greatest(a.x0, k.x0) + 1 >= 0.5::DOUBLE * least(a.x1 - a.x0 + 1, k.x1 - k.x0 + 1) AND least(a.y1, k.y1) - greatest(a.y0, k.y0) <= 0.5::DOUBLE * least(a.y1 - a.y0, k.y1 - k.y0, 1) AND greatest(a.y0, k.y0) - least(a.y1, k.y1) <= 2.5::DOUBLE * greatest(a.y1 - a.y0, k.y1 - k.y0, 1))""" + GROUPS.replace("two", "links").replace("cc", "g")


@query("glyph_lines", E8 + LABELS + COMPONENTS + _PARTS + """ SELECT page_id, grp AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(area) AS BIGINT) AS area, CAST(sum(holes) AS BIGINT) AS holes, count(*) AS components, string_agg(id, ',' ORDER BY id) AS parts,
round(sum(sx)::DOUBLE / sum(area) + 0.5::DOUBLE, 6) AS cx, round(sum(sy)::DOUBLE / sum(area) + 0.5::DOUBLE, 6) AS cy FROM g JOIN b USING (page_id, id) GROUP BY page_id, grp""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each glyph of a page: the parts over one another in a row of eight lines, with the sums of all."""
    g = Q.glyph_lines(components(spark, sf_dir).withColumn("row", F.floor(F.col("y0") / ROW)))
    return g.select(*[c for c in g.columns if c not in ("parts", "cx", "cy", "elongation")], F.array_join(F.transform("parts", lambda p: p.cast("string")), ",").alias("parts"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content between blank lines: the ink between lines that have none, as boxes."""

    def f(texts):
        r = R.rasterise(texts)
        new = np.r_[True, (r.page[1:] != r.page[:-1]) | (r.line[1:] > r.line[:-1] + 1)] if len(r) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(r)) - 1
        lo, hi = (np.minimum.reduceat(r.lo, at), np.maximum.reduceat(r.hi, at)) if len(at) else (r.lo, r.hi)
        return r.page[at], [r.line[at] * R.WIDTH + r.lo[at], lo, r.line[at], hi, r.line[end]]

    return R.pages(docs(spark, sf_dir), f, "id long, x0 long, y0 long, x1 long, y1 long")


@query("page_lines", E8 + LABELS + COMPONENTS + _PARTS + """, v AS (SELECT page_id, line, min(lo) AS lo, max(hi) AS hi, min(lo) AS first, line - row_number() OVER (PARTITION BY page_id ORDER BY line) AS s FROM r GROUP BY page_id, line)
SELECT page_id, 'ink' AS route, count(*) AS lines, CAST(sum(n) AS BIGINT) AS parts, CAST(sum(x1 - x0 + 1) AS BIGINT) AS wide, CAST(sum(y1 - y0 + 1) AS BIGINT) AS tall FROM (SELECT page_id, grp, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g JOIN b USING (page_id, id) GROUP BY page_id, grp) GROUP BY page_id
UNION ALL SELECT page_id, 'white', count(*), NULL, CAST(sum(x1 - x0 + 1) AS BIGINT), CAST(sum(y1 - y0 + 1) AS BIGINT) FROM (SELECT page_id, s, min(lo) AS x0, max(hi) AS x1, min(line) AS y0, max(line) AS y1 FROM v GROUP BY page_id, s) GROUP BY page_id""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both routes to the lines of a page, summed by route."""
    ink = Q.glyph_lines(components(spark, sf_dir).withColumn("row", F.floor(F.col("y0") / ROW))).select("page_id", "id", "x0", "y0", "x1", "y1", "components")
    both = Q.both_routes(ink, _blocks(spark, sf_dir))
    return both.groupBy("page_id", "route").agg(F.count(F.lit(1)).alias("lines"), F.sum("components").alias("parts"), F.sum(Q.width()).alias("wide"), F.sum(Q.height()).alias("tall"))


_KEY = 100_000


@query("foreign_ink", EDGES.format(reach=1).replace("WHERE u.hi", "WHERE u.line // 16 = v.line // 16 AND u.hi") + LABELS + COMPONENTS + f""", b AS (SELECT page_id * {_KEY} + y0 // 16 AS page_id, id, x0, y0 % 16 AS y0, x1, y1 % 16 AS y1, area FROM w),
h AS (SELECT doc_id, (length(text) + 63) // 64 AS h FROM documents), m AS (SELECT page_id, quantile_cont(x1 - x0 + 1, 0.5) AS med, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY page_id),
l AS (SELECT a.page_id, a.id AS a, k.id AS b FROM b a JOIN b k ON a.page_id = k.page_id AND a.id < k.id JOIN m ON m.page_id = a.page_id WHERE greatest(0, {GAP} - 1) <= med)""" + GROUPS.replace("two", "links").replace("cc", "g") + f""",
ci AS (SELECT b.*, grp, x0 <= 0 OR y0 <= 0 OR x1 >= 63 OR y1 >= least(16, h - 16 * (page_id % {_KEY})) - 1 AS edge FROM b JOIN g USING (page_id, id) JOIN h ON h.doc_id = page_id // {_KEY}),
k AS (SELECT page_id, grp, count(*) AS n, sum(area) AS area, bool_or(edge) AS edge, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ci GROUP BY page_id, grp),
o AS (SELECT k.*, med, k.x0 = m.x0 OR k.y0 = m.y0 OR k.x1 = m.x1 OR k.y1 = m.y1 AS far, row_number() OVER (PARTITION BY k.page_id ORDER BY area DESC, n DESC, grp) > 1 AS apart FROM k JOIN m USING (page_id))
SELECT page_id // {_KEY} AS page_id, page_id % {_KEY} AS crop, any_value(med) AS med_width, CAST(sum(n) AS BIGINT) AS components, any_value(t) AS at_edge, CAST(sum(CASE WHEN apart THEN n ELSE 0 END) AS BIGINT) AS separated, CAST(sum(CASE WHEN apart AND edge THEN n ELSE 0 END) AS BIGINT) AS edged,
CAST(sum(CASE WHEN apart AND far THEN n ELSE 0 END) AS BIGINT) AS extreme, CAST(sum(CASE WHEN apart AND edge THEN 0 ELSE area END) AS BIGINT) AS kept_area FROM o JOIN (SELECT page_id, count(*) FILTER (edge) AS t FROM ci GROUP BY page_id) USING (page_id) GROUP BY page_id""")
def foreign_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink from outside in each crop of 16 lines of each page, the crops being all of the page."""
    lines = F.ceil(F.length("text") / R.WIDTH).cast("int")
    d = docs(spark, sf_dir).filter(F.length("text") > 0).select("doc_id", lines.alias("lines"), F.explode(F.sequence(F.lit(0), F.floor((lines - 1) / CROP).cast("int"))).alias("crop"))
    sizes = d.select((F.col("doc_id") * _KEY + F.col("crop")).alias("page_id"), F.lit(R.WIDTH).alias("width"), F.least(F.lit(CROP), F.col("lines") - CROP * F.col("crop")).alias("height"))
    crop = F.floor(F.col("y0") / CROP)
    c = components(spark, sf_dir, CROP).select((F.col("page_id") * _KEY + crop).alias("page_id"), "id", "x0", (F.col("y0") - CROP * crop).alias("y0"), "x1", (F.col("y1") - CROP * crop).alias("y1"), "area")
    o = Q.foreign_ink(c, sizes).groupBy("page_id").agg(
        F.first("med_width").alias("med_width"), F.count(F.lit(1)).alias("components"), *[F.count_if(k).alias(k) for k in ("at_edge", "separated", "edged", "extreme")],
        F.sum(F.when(F.col("overrun"), 0).otherwise(F.col("area"))).cast("long").alias("kept_area"),
    )
    return o.withColumns({"crop": F.pmod("page_id", F.lit(_KEY)).cast("long"), "page_id": F.floor(F.col("page_id") / _KEY)})


@query("affine_fit", """WITH p AS (SELECT l_orderkey AS id, (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y, l_quantity::DOUBLE AS u, (l_linenumber * 10)::DOUBLE AS v FROM lineitem),
m AS (SELECT id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, count(*) AS n FROM p GROUP BY id), s AS (SELECT id, sum((x - mx) * (x - mx)) AS xx, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (u - mu)) AS xu, sum((y - my) * (u - mu)) AS yu, sum((x - mx) * (v - mv)) AS xv, sum((y - my) * (v - mv)) AS yv, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, any_value(n) AS n FROM p JOIN m USING (id) GROUP BY id),
o AS (SELECT id, n >= 3 AND xx > 0 AND yy > 0 AS ok, xu / nullif(xx, 0) AS a, yu / nullif(yy, 0) AS b, xv / nullif(xx, 0) AS c, yv / nullif(yy, 0) AS d, mu - xu / nullif(xx, 0) * mx - yu / nullif(yy, 0) * my AS e, mv - xv / nullif(xx, 0) * mx - yv / nullif(yy, 0) * my AS f FROM s)
SELECT id, """ + ", ".join(f"CASE WHEN ok THEN round({k} + 1e-8::DOUBLE, 6) + 0.0 END AS {k}" for k in "abcdef") + " FROM o")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each order from matched points; rounded a little off the halves, on which sums in another order differ."""
    d = lambda c: c.cast("double")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), d(F.col("l_partkey") % 200).alias("x"), d(F.col("l_suppkey") % 100).alias("y"), d(F.col("l_quantity")).alias("u"), d(F.col("l_linenumber") * 10).alias("v"))
    return Q.fit_affine(p, "id").select("id", *[(F.round(F.col(k) + 1e-8, 6) + 0.0).alias(k) for k in "abcdef"])


def _topology(runs: DataFrame) -> DataFrame:
    return T.page_table(T.components(runs)).select("page_id", "components", "holes")


@query("warp_drift")
def warp_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of all pages sheared by moving their runs and by looking pixels up: whose topology stays nearer."""
    m = (1.0, 0.0, 0.25, 1.0, 0.0, 0.0)
    line = F.col("line")
    r = R.runs(docs(spark, sf_dir)).select((F.col("page_id") * _KEY + F.floor(line / CROP)).alias("page_id"), (line % CROP).cast("int").alias("line"), "lo", "hi")
    return Q.compare_drift(_topology(r), _topology(G.transport(r, m, R.WIDTH + 8, CROP)), _topology(G.resample(r, m, R.WIDTH + 8, CROP, (R.WIDTH, CROP))))


@query("evidence_strings", B + """ SELECT page_id, id, concat_ws('; ', 'fill ' || format('{:.3g}', fill) || ' < ' || format('{:.3g}', 0.35::DOUBLE), CASE WHEN x1 - x0 >= 20 THEN 'longest_side_px ' || greatest(x1 - x0 + 1, y1 - y0 + 1) || ' >= 20' END) AS because
FROM (SELECT *, (x1 - x0 + 1)::DOUBLE / ((y1 - y0 + 1) * 7919) * CASE label WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 100000.0::DOUBLE ELSE 0.001::DOUBLE END AS fill FROM b)""")
def evidence_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = Q.width(), Q.height()
    fill = w.cast("double") / (h * 7919) * F.when(F.col("label") == "A", 1.0).when(F.col("label") == "N", 100000.0).otherwise(0.001)
    facts = E.because((F.lit(True), E.fact("fill", fill, "<", F.lit(0.35))), (w >= 21, E.fact("longest_side_px", F.greatest(w, h), ">=", F.lit(20), whole=True)))
    return boxes(spark, sf_dir).select("page_id", "id", F.array_join(facts, "; ").alias("because"))


@query("line_predicates", B + " SELECT page_id, id, abs(x1 - x0) >= abs(y1 - y0) AS horizontal, least(x0, x1) <= 240 * 0.025::DOUBLE OR greatest(x0, x1) >= 240 - 240 * 0.025::DOUBLE OR least(y0, y1) <= 240 * 0.025::DOUBLE OR greatest(y0, y1) >= 240 - 240 * 0.025::DOUBLE AS border FROM b")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    return boxes(spark, sf_dir).select("page_id", "id", E.is_horizontal(*line).alias("horizontal"), E.at_border(*line, F.lit(240), F.lit(240)).alias("border"))


@query("run_metrics", """SELECT l_suppkey AS run, count(*) AS tasks, sum(l_quantity)::DOUBLE AS busy, max(l_quantity)::DOUBLE AS longest, (max(l_quantity) + sum(l_quantity) / 4)::DOUBLE AS wall, round(sum(l_quantity)::DOUBLE / ((max(l_quantity) + sum(l_quantity) / 4)::DOUBLE * 4), 9) AS utilisation,
round(sum(l_quantity)::DOUBLE / (max(l_quantity) + sum(l_quantity) / 4)::DOUBLE, 9) AS speedup, round(sum(l_quantity)::DOUBLE / max(l_quantity)::DOUBLE, 9) AS ceiling FROM lineitem GROUP BY l_suppkey""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_quantity").cast("double").alias("s"))
    r = Q.run_metrics(t, "run", "s", F.max("s") + F.sum("s") / 4, 4)
    return r.withColumns({k: F.round(k, 9) for k in ("utilisation", "speedup", "ceiling")})


@query("dimension_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', CAST({len(n)} AS INTEGER), '{','.join(n)}')" for d, n in Q.DIMENSIONS.items()) + ") t(domain, n, names)")
def dimension_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, len(Q.dimensions_of(d)), ",".join(Q.dimensions_of(d))) for d in Q.DIMENSIONS], "domain string, n int, names string")


@query("corpus_plan", "SELECT count(*) AS docs, CAST(sum((length(text) + 2999) // 3000) AS BIGINT) AS pages, count(*) > 25 OR sum((length(text) + 2999) // 3000) > 5000 AS large FROM documents")
def corpus_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over the whole corpus would touch, at 3,000 characters a page."""
    return Q.plan(Q.select(docs(spark, sf_dir), "all"), F.ceil(F.length("text") / 3000))


@query("keyed_tasks", "SELECT o_orderkey AS key, o_orderstatus AS state FROM orders")
def keyed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.keyed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state")), "key")


@query("split_rule", """WITH r AS (SELECT o_custkey AS grp, o_orderpriority AS label, CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 2) AS INTEGER) % 4 <> 0 AS train FROM orders),
k AS (SELECT label FROM r GROUP BY label HAVING count(*) >= 12 AND count(*) FILTER (train) BETWEEN 1 AND count(*) - 1) SELECT label, train, count(*) AS n, count(DISTINCT grp) AS groups FROM r WHERE label IN (SELECT label FROM k) GROUP BY label, train""")
def split_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of whole groups on either side of the split."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("label"))
    return Q.split_by(o, "grp", "label").groupBy("label", "train").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"))


_KINDS = "CASE WHEN (x1 - x0 + 1) * (y1 - y0 + 1) < 20 THEN 'glyph' WHEN area::DOUBLE / ((x1 - x0 + 1) * (y1 - y0 + 1)) < 0.4::DOUBLE THEN 'sparse' ELSE 'dense' END"


@query("texture_percentiles", E8 + LABELS + COMPONENTS + f""", t AS (SELECT {_KINDS} AS kind, n_runs::DOUBLE / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS v FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM t)
SELECT kind, any_value(n) AS n, """ + ", ".join(f"round(max(v) FILTER (i = least(CAST(floor(n * {s}::DOUBLE) AS BIGINT), n - 1)), 9) AS p{p}" for s, p in ((0.1, 10), (0.5, 50), (0.9, 90))) + " FROM k GROUP BY kind")
def texture_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by box of components, small, sparse and dense, at the tenth, half and nine tenths of their order."""

    def f(texts):
        r = R.rasterise(texts)
        c = kernel.components(r)
        box = (c["x1"] - c["x0"] + 1) * (c["y1"] - c["y0"] + 1)
        return r.page[c["first"]], [box, c["area"], c["n_runs"]]

    t = R.pages(docs(spark, sf_dir), f, "box long, area long, n_runs long")
    kind = F.when(F.col("box") < 20, "glyph").when(F.col("area") / F.col("box") < 0.4, "sparse").otherwise("dense")
    p = Q.percentiles_by_index(t.select(kind.alias("kind"), (F.col("n_runs") / F.col("box")).alias("v")), "kind", "v")
    return p.select("kind", "n", *[F.round(k, 9).alias(k) for k in ("p10", "p50", "p90")])


@query("format_crosstab", "SELECT p_brand AS family, count(*) FILTER (p_size <= 15) AS small, count(*) FILTER (p_size BETWEEN 16 AND 35) AS middle, count(*) FILTER (p_size > 35) AS large FROM part GROUP BY p_brand")
def format_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each family by format, the formats as columns."""
    kind = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "middle").otherwise("large")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), kind.alias("kind"))
    return p.groupBy("family").pivot("kind", ["small", "middle", "large"]).agg(F.count(F.lit(1))).fillna(0)


@query("equivalences", E8 + LABELS + """, k AS (SELECT count(DISTINCT (n.page_id, comp)) AS c, count(DISTINCT n.page_id) AS p FROM n JOIN cc USING (id)), a AS (SELECT count(*) AS a FROM px WHERE ink)
SELECT p AS pages, c AS components, c AS banded, a AS area_rows, a AS area_columns, CAST(0 AS BIGINT) AS moments, CAST(0 AS BIGINT) AS bands FROM k, a""")
def equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink and components counted both ways, and pages on which moments by rows and columns, or components in bands and of
    whole pages, differ."""
    d = docs(spark, sf_dir)
    r = R.runs(d)
    sums = [T.moments(R.runs(d, axis=a), "page_id", axis=a).select("page_id", F.struct(*Q.SUMS).alias(a)) for a in ("row", "col")]
    total = lambda axis: F.sum(F.col(axis)["area"]).alias("area_rows" if axis == "row" else "area_columns")
    odd = sums[0].join(sums[1], "page_id", "full").agg(F.count_if(~F.col("row").eqNullSafe(F.col("col"))).alias("moments"), F.count(F.lit(1)).alias("pages"), total("row"), total("col"))
    whole = T.components(r).groupBy("page_id").agg(F.count_distinct("comp").alias("n"))
    banded = T.band_components(r, 4).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count_distinct("comp").alias("m"))
    apart = whole.join(banded, "page_id", "full").agg(F.count_if(~F.col("n").eqNullSafe(F.col("m"))).alias("bands"), F.sum("n").alias("components"), F.sum("m").alias("banded"))
    return odd.crossJoin(apart).select("pages", "components", "banded", "area_rows", "area_columns", "moments", "bands")


@query("topology_gate", E8 + LABELS + """ SELECT n.page_id, count(DISTINCT cc.comp) AS components, CAST(coalesce(any_value(k.m), 0) - count(*) + count(DISTINCT cc.comp) AS BIGINT) AS holes, true AS kept
FROM n JOIN cc USING (id) LEFT JOIN (SELECT page_id, count(*) AS m FROM e GROUP BY page_id) k USING (page_id) GROUP BY n.page_id""")
def topology_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and holes of each page, and whether it has as many once it is turned on its side: what a change of place
    must not change."""

    def f(axis):
        def g(texts):
            r = R.rasterise(texts, axis)
            c = kernel.components(r)
            page, of = np.unique(r.page[c["first"]], return_inverse=True)
            return page, [np.bincount(of, minlength=len(page)), np.bincount(of, c["n_edges"] - c["n_runs"] + 1, minlength=len(page)).astype(np.int64)]

        return g

    d = docs(spark, sf_dir)
    row, col = (R.pages(d, f(a), "components long, holes long") for a in ("row", "col"))
    turned = col.select("page_id", F.struct("components", "holes").alias("t"))
    return row.join(turned, "page_id").select("page_id", "components", "holes", F.struct("components", "holes").eqNullSafe(F.col("t")).alias("kept"))


@query("rotation_survival")
def rotation_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of crops of all pages that keep their holes, and their components, when turned by a small angle; counted
    within the page pass."""
    angles = (0.0, 0.5, 3.0, -3.0)

    def count(r: kernel.Runs, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = kernel.edges(r)
        first = np.flatnonzero(kernel.label(len(r), up, down) == np.arange(len(r)))
        components = np.bincount(r.page[first], minlength=n)
        return components, np.bincount(r.page[down], minlength=n) - np.bincount(r.page, minlength=n) + components

    def f(texts):
        r = R.rasterise(texts)
        crop = np.r_[0, np.cumsum((r.page[1:] != r.page[:-1]) | (r.line[1:] // CROP != r.line[:-1] // CROP))] if len(r) else r.page
        r = kernel.Runs(crop, r.line % CROP, r.lo, r.hi)
        n = int(crop[-1]) + 1 if len(r) else 0
        components, holes = count(r, n)
        kept = [n]
        for deg in angles:
            c, s = float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))
            turned, through = count(G.moved(r, (c, s, -s, c, 8.0, 8.0), R.WIDTH + 16, CROP + 16), n)
            kept += [((through == holes) & (turned > 0)).sum(), (turned == components).sum()]
        return [0], [np.array([k], np.int64) for k in kept]

    fields = ["n", *[f"{k}{i}" for i in range(len(angles)) for k in "hc"]]
    total = R.pages(docs(spark, sf_dir), f, ", ".join(f"{k} long" for k in fields)).agg(*[F.sum(k).alias(k) for k in fields])
    share = lambda k: F.try_divide(F.col(k).cast("double"), F.col("n").cast("double"))
    return total.select(F.inline(F.array(*[F.struct(F.lit(deg).alias("degrees"), share(f"h{i}").alias("holes_kept"), share(f"c{i}").alias("components_kept")) for i, deg in enumerate(angles)])))
