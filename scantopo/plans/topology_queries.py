"""Queries on the text raster: runs, adjacency, components, events, moments, containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantopo.operators import kernel
from scantopo.operators import topology as T
from scantopo.plans.catalogue import query, table
from scantopo.sources import text_raster as R

CELLS = """
c AS (SELECT doc_id AS page_id, regexp_extract_all(text, '(?s).') AS t FROM documents),
px AS (SELECT page_id, i // 64 AS line, i % 64 AS x, regexp_matches(ch, '^[aeiouyAEIOUY]$') AS ink FROM (
  SELECT page_id, unnest(t) AS ch, generate_subscripts(t, 1) - 1 AS i FROM c))
"""


def runs_sql(line: str = "line", x: str = "x", ink: str = "ink", name: str = "r") -> str:
    return f"""{name} AS (SELECT page_id, line, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM (
  SELECT page_id, {line} AS line, {x} AS x, {x} - row_number() OVER (PARTITION BY page_id, {line} ORDER BY {x}) AS g FROM px WHERE {ink}) GROUP BY page_id, line, g)"""


RUNS = f"WITH RECURSIVE {CELLS}, {runs_sql()}"
#: Runs with an id, and edges of touching runs on consecutive lines.
EDGES = RUNS + """, n AS (SELECT *, page_id * 1000000 + line * 64 + lo AS id FROM r),
e AS (SELECT u.page_id, u.id AS a, v.id AS b, v.line AS line, u.lo AS up_lo, v.lo AS lo FROM (SELECT *, line + 1 AS below FROM n) u JOIN n v ON u.page_id = v.page_id AND u.below = v.line WHERE u.hi >= v.lo - {reach} AND u.lo <= v.hi + {reach})"""
LABELS = """, two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM n UNION
  SELECT two.b, min(cc.comp) FROM cc JOIN two ON two.a = cc.id JOIN recurring.cc AS old ON old.id = two.b WHERE cc.comp < old.comp GROUP BY two.b)"""
E8 = EDGES.format(reach=1)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def as_longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long") if c in names else F.col(c) for c in df.columns])


@query("runs_row", RUNS + " SELECT page_id, CAST(line AS BIGINT) AS line, lo, hi FROM r")
def runs_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(R.runs(docs(spark, sf_dir)), "line", "lo", "hi")


@query("runs_col", f"WITH {CELLS}, {runs_sql('x', 'line')} SELECT page_id, CAST(line AS BIGINT) AS line, lo, hi FROM r")
def runs_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(R.runs(docs(spark, sf_dir), axis="col"), "line", "lo", "hi")


@query("runs_ground", f"WITH {CELLS}, {runs_sql(ink='NOT ink')} SELECT page_id, CAST(line AS BIGINT) AS line, lo, hi FROM r")
def runs_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complement by intervals: gaps between the runs of each line of the page, up to the text's end."""
    d = docs(spark, sf_dir).filter(F.length("text") > 0)
    n = d.select(F.col("doc_id").alias("page_id"), F.length("text").alias("n"))
    sizes = n.select("page_id", F.lit(R.WIDTH).alias("width"), F.ceil(F.col("n") / R.WIDTH).cast("int").alias("height"), "n")
    gaps = T.complement(R.runs(d), sizes).join(sizes.select("page_id", "n"), "page_id")
    end = F.least(F.col("hi"), F.col("n") - 1 - F.col("line") * R.WIDTH)
    return as_longs(gaps.select("page_id", "line", "lo", end.alias("hi")).filter("lo <= hi"), "line", "lo", "hi")


def sizes_of(d: DataFrame) -> DataFrame:
    h = F.ceil(F.length("text") / R.WIDTH).cast("int")
    return d.filter(F.length("text") > 0).select(F.col("doc_id").alias("page_id"), F.lit(R.WIDTH).alias("width"), h.alias("height"))


@query("run_profile", RUNS + """ SELECT page_id, CAST(line AS BIGINT) AS line, CAST(coalesce(sum(hi - lo + 1), 0) AS BIGINT) AS coverage, CAST(coalesce(max(hi) - min(lo) + 1, 0) AS BIGINT) AS extent, count(lo) AS run_count
FROM (SELECT DISTINCT page_id, line FROM px) LEFT JOIN r USING (page_id, line) GROUP BY page_id, line""")
def run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return as_longs(T.profile(R.runs(d), sizes_of(d)), "line")


@query("stroke_mode", RUNS + """ SELECT page_id, arg_min(len, struct_pack(a := -n, b := len)) AS mode_len, max(n) AS mode_n FROM (
SELECT page_id, hi - lo + 1 AS len, count(*) AS n FROM r GROUP BY ALL) GROUP BY page_id""")
def stroke_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stroke_mode(R.runs(docs(spark, sf_dir)))


def _edge_query(reach: int):
    def g(texts):
        r = R.rasterise(texts)
        up, down = kernel.edges(r, reach)
        return r.page[down], [r.line[down], r.lo[up], r.lo[down]]

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        """In the pass over whole pages; ``T.adjacency`` is the join for runs from elsewhere."""
        return R.pages(docs(spark, sf_dir), g, "line long, up_lo long, lo long")

    return f


for _reach, _name in ((1, "rag_edges_c8"), (0, "rag_edges_c4")):
    query(_name, EDGES.format(reach=_reach) + " SELECT page_id, CAST(line AS BIGINT) AS line, up_lo, lo FROM e")(_edge_query(_reach))


@query("termini", E8 + """ SELECT n.page_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.b = n.id)) AS starts, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.a = n.id)) AS ends FROM n GROUP BY n.page_id""")
def termini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree_counts(spark, sf_dir).select("page_id", F.col("births").alias("starts"), F.col("closes").alias("ends"))


def _degree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of each run within a pass over whole pages: no edge leaves a page."""

    def f(texts):
        r = R.rasterise(texts)
        up, down = kernel.edges(r)
        n = len(r)
        u, d = np.bincount(down, minlength=n), np.bincount(up, minlength=n)
        page, k = np.unique(r.page, return_inverse=True)
        return page, [np.bincount(k, w, minlength=len(page)).astype(np.int64) for w in (u == 0, d == 0, u >= 2, d >= 2)]

    return R.pages(docs(spark, sf_dir), f, "births long, closes long, merges long, splits long")


@query("reeb_signature", E8 + """, g AS (SELECT n.page_id, coalesce(x.c, 0) AS up, coalesce(y.c, 0) AS down FROM n LEFT JOIN (SELECT b, count(*) AS c FROM e GROUP BY b) x ON x.b = n.id LEFT JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) y ON y.a = n.id)
SELECT page_id, count(*) FILTER (up = 0) AS births, count(*) FILTER (down = 0) AS closes, count(*) FILTER (up >= 2) AS merges, count(*) FILTER (down >= 2) AS splits FROM g GROUP BY page_id""")
def reeb_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree_counts(spark, sf_dir)


#: Edges along which a run goes on with the arc above it, and the first run of each arc.
ARCS = E8 + """, d AS (SELECT n.*, coalesce(x.c, 0) AS up, coalesce(y.c, 0) AS down FROM n LEFT JOIN (SELECT b, count(*) AS c FROM e GROUP BY b) x ON x.b = n.id LEFT JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) y ON y.a = n.id),
k AS (SELECT e.a, e.b FROM e JOIN d u ON u.id = e.a JOIN d v ON v.id = e.b WHERE u.up < 2 AND u.down < 2 AND v.up < 2 AND v.down < 2),
two AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
cc(id, arc) USING KEY (id) AS (SELECT id, id FROM n UNION
  SELECT two.b, min(cc.arc) FROM cc JOIN two ON two.a = cc.id JOIN recurring.cc AS old ON old.id = two.b WHERE cc.arc < old.arc GROUP BY two.b),
w AS (SELECT x.arc AS a, y.arc AS b FROM (SELECT e.a, e.b FROM e ANTI JOIN k ON k.a = e.a AND k.b = e.b) j JOIN cc x ON x.id = j.a JOIN cc y ON y.id = j.b),
arcs AS (SELECT n.page_id, CAST(cc.arc % 1000000 AS BIGINT) AS arc, count(*) AS n_runs, CAST(min(line) AS BIGINT) AS first_line, CAST(max(line) AS BIGINT) AS last_line, coalesce(any_value(x.c), 0) AS up, coalesce(any_value(y.c), 0) AS down
  FROM n JOIN cc USING (id) LEFT JOIN (SELECT b, count(*) AS c FROM w GROUP BY b) x ON x.b = cc.arc LEFT JOIN (SELECT a, count(*) AS c FROM w GROUP BY a) y ON y.a = cc.arc GROUP BY n.page_id, cc.arc)"""


def _arcs(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    """One row an arc: runs, lines, and the arcs above and below; ``reverse`` reads the page from its foot."""

    def f(texts):
        r = R.rasterise(texts)
        first, above, below = kernel.arcs(r, *kernel.edges(r))
        names, of = np.unique(first, return_inverse=True)
        last = np.zeros(len(names), np.int64)
        np.maximum.at(last, of, r.line)
        ends = [np.bincount(np.searchsorted(names, x), minlength=len(names)) for x in (below, above)]
        up, down = ends[::-1] if reverse else ends
        return r.page[names], [r.line[names] * R.WIDTH + r.lo[names], np.bincount(of, minlength=len(names)), r.line[names], last, up, down]

    return R.pages(docs(spark, sf_dir), f, "arc long, n_runs long, first_line long, last_line long, up long, down long")


@query("reeb_arcs", ARCS + " SELECT * FROM arcs")
def reeb_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracted graph: chains of regular runs as one arc, junctions as arcs of their own."""
    return _arcs(spark, sf_dir)


@query("reeb_arcs_reversed", ARCS + " SELECT page_id, arc, n_runs, first_line, last_line, down AS up, up AS down FROM arcs")
def reeb_arcs_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph from foot to head: no second scan, only the ends of its edges change places."""
    return _arcs(spark, sf_dir, reverse=True)


@query("contraction_ratio", ARCS + " SELECT page_id, count(*) AS arcs, CAST(sum(n_runs) AS BIGINT) AS runs, round(count(*)::DOUBLE / sum(n_runs), 9) AS ratio FROM arcs GROUP BY page_id")
def contraction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs by runs of each page."""
    a = _arcs(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("arcs"), F.sum("n_runs").alias("runs"))
    return a.withColumn("ratio", F.round(F.col("arcs") / F.col("runs"), 9))


_COLUMN_RUNS = runs_sql("x", "line", name="rc") + """, nc AS (SELECT *, page_id * 10000000 + line * 100000 + lo AS id FROM rc),
ec AS (SELECT u.id AS a, v.id AS b FROM (SELECT *, line + 1 AS below FROM nc) u JOIN nc v ON u.page_id = v.page_id AND u.below = v.line WHERE u.hi >= v.lo - 1 AND u.lo <= v.hi + 1)"""


@query("serif_excess", E8 + ", " + _COLUMN_RUNS + """, s AS (SELECT page_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.b = n.id)) + count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.a = n.id)) AS t FROM n GROUP BY page_id),
k AS (SELECT page_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ec WHERE ec.b = nc.id)) + count(*) FILTER (NOT EXISTS (SELECT 1 FROM ec WHERE ec.a = nc.id)) AS t FROM nc GROUP BY page_id)
SELECT page_id, CAST(s.t AS BIGINT) AS row_ends, CAST(k.t AS BIGINT) AS column_ends, CAST(s.t + k.t - 2 * s.t AS BIGINT) AS excess FROM s JOIN k USING (page_id)""")
def serif_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stroke ends along both axes, less twice the ends of the contracted graph of the rows."""

    def f(texts):
        ends = []
        for axis in ("row", "col"):
            r = R.rasterise(texts, axis)
            up, down = kernel.edges(r)
            n = len(r)
            free = (np.bincount(down, minlength=n) == 0).astype(np.int64) + (np.bincount(up, minlength=n) == 0)
            ends.append(np.bincount(r.page, free, minlength=len(texts)).astype(np.int64))
        pages = np.unique(R.rasterise(texts).page)
        row, col = (x[pages] for x in ends)
        return pages, [row, col, row + col - 2 * row]

    return R.pages(docs(spark, sf_dir), f, "row_ends long, column_ends long, excess long")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with its component (line * width + lo of its first run), degrees and cycles."""

    def f(texts):
        r = R.rasterise(texts)
        a = T.analyse(r)
        first = r.line * R.WIDTH + r.lo
        return r.page, [r.line.astype(np.int32), r.lo.astype(np.int32), r.hi.astype(np.int32), first[a["comp"]], a["up"], a["down"], a["up"] - a["roots"], a["roots"]]

    return R.pages(docs(spark, sf_dir), f, "line int, lo int, hi int, comp long, up long, down long, cycles long, roots long")


@query("page_topology", E8 + LABELS + """ SELECT n.page_id, count(*) AS runs, CAST(coalesce(any_value(k.m), 0) AS BIGINT) AS edges, count(DISTINCT cc.comp) AS components, CAST(coalesce(any_value(k.m), 0) - count(*) + count(DISTINCT cc.comp) AS BIGINT) AS holes
FROM n JOIN cc USING (id) LEFT JOIN (SELECT page_id, count(*) AS m FROM e GROUP BY page_id) k USING (page_id) GROUP BY n.page_id""")
def page_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass, one row a page."""

    def f(texts):
        r = R.rasterise(texts)
        up, down = kernel.edges(r)
        comp = kernel.label(len(r), up, down)
        page, k = np.unique(r.page, return_inverse=True)
        runs, edges = np.bincount(k, minlength=len(page)), np.bincount(k[down], minlength=len(page))
        parts = np.bincount(k, comp == np.arange(len(r)), minlength=len(page)).astype(np.int64)
        return page, [runs, edges, parts, edges - runs + parts]

    return R.pages(docs(spark, sf_dir), f, "runs long, edges long, components long, holes long")


@query("components", E8 + LABELS + """ SELECT n.page_id, CAST(cc.comp % 1000000 AS BIGINT) AS comp, count(*) AS n_runs, CAST(sum(coalesce(k.m, 0)) AS BIGINT) AS n_edges, CAST(min(line) AS BIGINT) AS first_line, CAST(max(line) AS BIGINT) AS last_line, CAST(sum(coalesce(k.m, 0)) - count(*) + 1 AS BIGINT) AS holes
FROM n JOIN cc USING (id) LEFT JOIN (SELECT b, count(*) AS m FROM e GROUP BY b) k ON k.b = n.id GROUP BY n.page_id, cc.comp""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(T.component_table(labelled(spark, sf_dir)), "first_line", "last_line")


@query("hole_count", E8 + LABELS + """ SELECT page_id, CAST(sum(holes) AS BIGINT) AS holes, count(*) FILTER (holes > 0) AS with_holes, CAST(max(holes) AS BIGINT) AS most FROM (
SELECT n.page_id, cc.comp, sum(coalesce(k.m, 0)) - count(*) + 1 AS holes FROM n JOIN cc USING (id) LEFT JOIN (SELECT b, count(*) AS m FROM e GROUP BY b) k ON k.b = n.id GROUP BY n.page_id, cc.comp) GROUP BY page_id""")
def hole_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.component_table(labelled(spark, sf_dir))
    return t.groupBy("page_id").agg(F.sum("holes").alias("holes"), F.count(F.when(F.col("holes") > 0, 1)).alias("with_holes"), F.max("holes").alias("most"))


@query("scan_events_birth_split_close", E8 + LABELS + """, g AS (SELECT n.page_id, n.line, cc.comp, coalesce(x.c, 0) AS up, coalesce(y.c, 0) AS down FROM n JOIN cc USING (id) LEFT JOIN (SELECT b, count(*) AS c FROM e GROUP BY b) x ON x.b = n.id LEFT JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) y ON y.a = n.id),
l AS (SELECT DISTINCT page_id, line FROM n), f AS (SELECT page_id, line, coalesce(lead(line) OVER (PARTITION BY page_id ORDER BY line), line + 1) AS next FROM l)
SELECT page_id, CAST(line AS BIGINT) AS line, kind, count(*) AS n FROM (
SELECT page_id, line, 'birth' AS kind FROM g WHERE up = 0 UNION ALL SELECT page_id, line, 'split' FROM g WHERE down >= 2
UNION ALL SELECT k.page_id, f.next, 'close' FROM (SELECT page_id, comp, max(line) AS line FROM g GROUP BY ALL) k JOIN f USING (page_id, line)) GROUP BY ALL""")
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(T.events(labelled(spark, sf_dir)).filter("kind in ('birth', 'split', 'close')"), "line")


@query("scan_events_cycle_merge", E8 + LABELS + """ SELECT n.page_id, CAST(coalesce(any_value(k.m), 0) - count(*) + count(DISTINCT cc.comp) AS BIGINT) AS cycles, count(*) - count(DISTINCT cc.comp) AS joins
FROM n JOIN cc USING (id) LEFT JOIN (SELECT page_id, count(*) AS m FROM e GROUP BY page_id) k USING (page_id) GROUP BY n.page_id""")
def scan_events_cycle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in scan order: those that close a cycle, and those that join components."""
    return labelled(spark, sf_dir).groupBy("page_id").agg(F.sum("cycles").alias("cycles"), F.sum("roots").alias("joins"))


@query("scan_events_merge_lines")
def scan_events_merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a run meets two or more components, as they are on arrival; depends on order within a line."""
    return as_longs(T.events(labelled(spark, sf_dir)).filter("kind in ('merge', 'cycle')"), "line")


MOMENTS = "CAST(count(*) AS BIGINT) AS area, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(line) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(line * line) AS BIGINT) AS syy, CAST(sum(x * line) AS BIGINT) AS sxy, CAST(min(x) AS BIGINT) AS x0, CAST(min(line) AS BIGINT) AS y0, CAST(max(x) AS BIGINT) AS x1, CAST(max(line) AS BIGINT) AS y1"


def _long_ends(df: DataFrame) -> DataFrame:
    return as_longs(df, "x0", "y0", "x1", "y1")


@query("moments_page", f"WITH {CELLS} SELECT page_id, {MOMENTS} FROM px WHERE ink GROUP BY page_id")
def moments_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_ends(T.moments(R.runs(docs(spark, sf_dir)), "page_id"))


@query("moments_page_columns", f"WITH {CELLS} SELECT page_id, {MOMENTS} FROM px WHERE ink GROUP BY page_id")
def moments_page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums from runs along columns."""
    return _long_ends(T.moments(R.runs(docs(spark, sf_dir), axis="col"), "page_id", axis="col"))


@query("moments_component", E8 + LABELS + f" SELECT page_id, comp, {MOMENTS} FROM (SELECT n.page_id, CAST(cc.comp % 1000000 AS BIGINT) AS comp, n.line, unnest(range(n.lo, n.hi + 1)) AS x FROM n JOIN cc USING (id)) GROUP BY page_id, comp")
def moments_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_ends(T.moments(labelled(spark, sf_dir), "page_id", "comp"))


@query("moments_merged", f"WITH {CELLS} SELECT page_id, {MOMENTS} FROM px WHERE ink GROUP BY page_id")
def moments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by bands of eight lines, merged: partial results add."""
    b = T.bands(R.runs(docs(spark, sf_dir)), 8)
    return _long_ends(T.merge_moments(T.moments(b, "page_id", "band"), "page_id"))


@query("principal_axis", f"""WITH {CELLS}, m AS (SELECT page_id, count(*) AS n, avg(x) AS mx, avg(line) AS my, var_pop(x) + 1 / 12.0::DOUBLE AS a, var_pop(line) + 1 / 12.0::DOUBLE AS b, covar_pop(x, line) AS c FROM px WHERE ink GROUP BY page_id),
s AS (SELECT *, sqrt((a - b) * (a - b) + 4 * c * c) AS s FROM m) SELECT page_id, round(mx + 0.5::DOUBLE, 6) AS cx, round(my + 0.5::DOUBLE, 6) AS cy, round(2 * sqrt((a + b + s) / 2), 5) AS major, round(2 * sqrt(greatest((a + b - s) / 2, 1 / 12.0::DOUBLE)), 5) AS minor FROM s""")
def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.axis_columns()
    m = T.moments(R.runs(docs(spark, sf_dir)), "page_id")
    return m.select("page_id", F.round(a["cx"], 6).alias("cx"), F.round(a["cy"], 6).alias("cy"), F.round(a["major"], 5).alias("major"), F.round(a["minor"], 5).alias("minor"))


@query("texture_channels", E8 + LABELS + """, h AS (SELECT n.page_id, coalesce(any_value(k.m), 0) - count(*) + count(DISTINCT cc.comp) AS holes FROM n JOIN cc USING (id) LEFT JOIN (SELECT page_id, count(*) AS m FROM e GROUP BY page_id) k USING (page_id) GROUP BY n.page_id)
SELECT page_id, round(count(*) / sum(hi - lo + 1), 9) AS runs_per_area, round(avg(hi - lo + 1), 9) AS mean_run, round(stddev_pop(hi - lo + 1) / avg(hi - lo + 1), 6) AS cv_run, round(any_value(holes) / sum(hi - lo + 1), 9) AS cycles_per_area FROM n JOIN h USING (page_id) GROUP BY page_id""")
def texture_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir)
    t = T.texture(lab, T.page_table(lab).select("page_id", "holes"))
    return t.select("page_id", *[F.round(k, 6 if k == "cv_run" else 9).alias(k) for k in ("runs_per_area", "mean_run", "cv_run", "cycles_per_area")])


@query("band_stitch_equal", E8 + LABELS + " SELECT page_id, count(DISTINCT cc.comp) AS components FROM n JOIN cc USING (id) GROUP BY page_id")
def band_stitch_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components found in bands of four lines and joined over the seams."""
    c = T.band_components(R.runs(docs(spark, sf_dir)), 4)
    return c.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count_distinct("comp").alias("components"))


@query("block_histogram", f"WITH {CELLS} SELECT page_id, CAST(line // 8 AS BIGINT) AS by, CAST(x // 8 AS BIGINT) AS bx, count(*) AS ink FROM px WHERE ink GROUP BY ALL")
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.block_histogram(R.runs(docs(spark, sf_dir)), 8)


@query("region_clip", RUNS + " SELECT page_id, CAST(line - 2 AS BIGINT) AS line, greatest(lo, 10) - 10 AS lo, least(hi, 39) - 10 AS hi FROM r WHERE line >= 2 AND line < 12 AND lo <= 39 AND hi >= 10")
def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(T.clip(R.runs(docs(spark, sf_dir)), 10, 2, 40, 12), "line", "lo", "hi")


RECTS = "z AS (SELECT doc_id AS page_id, CAST(doc_id % 40 AS INT) AS x0, 1 AS y0, CAST(doc_id % 40 + 15 AS INT) AS x1, 5 AS y1 FROM documents UNION ALL SELECT doc_id, 20, 3, 50, 8 FROM documents)"
_SET = "WITH " + CELLS + ", " + RECTS + """, px2 AS (SELECT page_id, line, x, ink AND {no} EXISTS (SELECT 1 FROM z WHERE z.page_id = px.page_id AND x >= x0 AND x < x1 AND line >= y0 AND line < y1) AS ink FROM px)
SELECT page_id, CAST(line AS BIGINT) AS line, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM (SELECT page_id, line, x, x - row_number() OVER (PARTITION BY page_id, line ORDER BY x) AS g FROM px2 WHERE ink) GROUP BY page_id, line, g"""


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    x0 = F.pmod("page_id", F.lit(40)).cast("int")
    one = d.select("page_id", x0.alias("x0"), F.lit(1).alias("y0"), (x0 + 15).alias("x1"), F.lit(5).alias("y1"))
    return one.unionAll(d.select("page_id", F.lit(20), F.lit(3), F.lit(50), F.lit(8)))


@query("region_exclude", _SET.format(no="NOT"))
def region_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(T.without(R.runs(docs(spark, sf_dir)), _rects(spark, sf_dir)), "line", "lo", "hi")


@query("region_include", _SET.format(no=""))
def region_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(T.within(R.runs(docs(spark, sf_dir)), _rects(spark, sf_dir)), "line", "lo", "hi")


_SUMS = "SELECT page_id, sum({n}) AS a, sum({x}) AS sx, sum({y}) AS sy, sum({xx}) AS sxx, sum({yy}) AS syy, sum({xy}) AS sxy FROM {t} GROUP BY page_id"
_N, _S, _Q = "(hi - lo + 1)", "((lo + hi) * (hi - lo + 1) // 2)", "(hi * (hi + 1) * (2 * hi + 1) // 6 - (lo - 1) * lo * (2 * lo - 1) // 6)"


@query("mask_equality", f"""WITH {CELLS}, {runs_sql()}, {runs_sql('x', 'line', name='k')}, u AS ({_SUMS.format(t='r', n=_N, x=_S, y='line * ' + _N, xx=_Q, yy='line * line * ' + _N, xy='line * ' + _S)}), v AS ({_SUMS.format(t='k', n=_N, x='line * ' + _N, y=_S, xx='line * line * ' + _N, yy=_Q, xy='line * ' + _S)})
SELECT (SELECT count(*) FROM documents WHERE length(text) > 0) AS pages, (SELECT count(*) FROM u) AS inked, CAST((SELECT count(*) FROM u FULL JOIN v USING (page_id) WHERE (u.a, u.sx, u.sy, u.sxx, u.syy, u.sxy) IS DISTINCT FROM (v.a, v.sx, v.sy, v.sxx, v.syy, v.sxy)) AS BIGINT) AS different""")
def mask_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and column runs cover the same cells: area and all sums up to the second order are equal page by page."""
    sums = ["area", "sx", "sy", "sxx", "syy", "sxy"]
    by = [T.moments(R.runs(docs(spark, sf_dir), axis=a), "page_id", axis=a).select("page_id", F.struct(*sums).alias(a)) for a in ("row", "col")]
    both = by[0].join(by[1], "page_id", "full").agg(F.count("row").alias("inked"), F.count_if(~F.col("row").eqNullSafe(F.col("col"))).alias("different"))
    return docs(spark, sf_dir).filter(F.length("text") > 0).agg(F.count(F.lit(1)).alias("pages")).crossJoin(both)


@query("skew_profile", f"""WITH {CELLS}, a AS (SELECT unnest(range(-16, 17)) * 0.25::DOUBLE AS deg), b AS (SELECT page_id, deg, CAST(floor((line - x * tan(radians(deg))) / 4) AS BIGINT) AS bin, count(*) AS n FROM px, a WHERE ink GROUP BY ALL),
s AS (SELECT page_id, deg, CAST(sum(n * n) AS BIGINT) AS score FROM b GROUP BY ALL) SELECT page_id, arg_min(deg, struct_pack(a := -score, b := deg)) AS angle, max(score) AS score FROM s GROUP BY page_id""")
def skew_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle at which ink falls into the fewest lines: the sum of squares of binned counts, largest first."""

    def f(texts):
        r = R.rasterise(texts)
        n = r.hi - r.lo + 1
        which = np.repeat(np.arange(len(r)), n)
        x = r.lo[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        page, y = r.page[which], r.line[which]
        ids = np.unique(page)
        best, angle = np.full(len(ids), -1), np.zeros(len(ids))
        for deg in np.arange(-16, 17) * 0.25:
            at = np.floor((y - x * np.tan(np.radians(deg))) / 4).astype(np.int64)
            key, count = np.unique(page * (1 << 32) + at + (1 << 20), return_counts=True)
            score = np.bincount(np.searchsorted(ids, key >> 32), count.astype(np.float64) ** 2, minlength=len(ids)).astype(np.int64)
            better = score > best
            best[better], angle[better] = score[better], deg
        return ids, [angle, best]

    return R.pages(docs(spark, sf_dir), f, "angle double, score long")


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of ink labelled with corners, and of ground without on pages with a border of one cell; every page is the
    whole rectangle of its lines, cells past the text's end being ground."""

    def f(ground: bool):
        def g(texts):
            r = R.rasterise(texts)
            if ground:
                r = kernel.ground(r, R.heights(texts), R.WIDTH)
            a = T.analyse(r, 0 if ground else 1)
            first = (r.line + 1) * (R.WIDTH + 2) + r.lo + 1
            return r.page, [r.line.astype(np.int32), r.lo.astype(np.int32), r.hi.astype(np.int32), first[a["comp"]]]

        return g

    d = docs(spark, sf_dir)
    return tuple(R.pages(d, f(g), "line int, lo int, hi int, comp long") for g in (False, True))


@query("hole_regions", E8 + LABELS + """ SELECT n.page_id, CAST(coalesce(any_value(k.m), 0) - count(*) + count(DISTINCT cc.comp) AS BIGINT) AS holes
FROM n JOIN cc USING (id) LEFT JOIN (SELECT page_id, count(*) AS m FROM e GROUP BY page_id) k USING (page_id) GROUP BY n.page_id""")
def hole_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes as regions of ground that aren't the outside; by Euler's identity as many as edges - runs + components."""
    ink, ground = _regions(spark, sf_dir)
    n = ground.groupBy("page_id").agg((F.count_distinct("comp") - 1).alias("holes"))
    return ink.select("page_id").distinct().join(n, "page_id")


#: Regions of ink (8 neighbours) and of ground (4, with a border of one cell), and the cell above the first of each.
NEST = f"""WITH RECURSIVE {CELLS}, {runs_sql()},
h AS (SELECT doc_id AS page_id, (length(text) + 63) // 64 AS h FROM documents WHERE text IS NOT NULL),
q AS (SELECT page_id, line, lo, hi FROM r UNION ALL SELECT page_id, unnest(range(-1, h + 1)), -2, -2 FROM h),
gr AS (SELECT page_id, line, hi + 1 AS lo, coalesce(lead(lo) OVER (PARTITION BY page_id, line ORDER BY lo) - 1, 64) AS hi FROM q),
n AS (SELECT *, page_id * 10000000 + (line + 1) * 66 + lo + 1 AS id FROM (SELECT 'ink' AS kind, page_id, line, lo, hi, 1 AS reach FROM r UNION ALL SELECT 'ground', page_id, line, lo, hi, 0 FROM gr WHERE lo <= hi)),
e AS (SELECT u.kind, u.id AS a, v.id AS b FROM (SELECT *, line + 1 AS below FROM n) u JOIN n v ON u.kind = v.kind AND u.page_id = v.page_id AND u.below = v.line WHERE u.hi >= v.lo - v.reach AND u.lo <= v.hi + v.reach),
two AS (SELECT kind, a, b FROM e UNION ALL SELECT kind, b, a FROM e),
cc(kind, id, comp) USING KEY (kind, id) AS (SELECT kind, id, CASE WHEN kind = 'ground' AND (lo = -1 OR hi = 64) THEN page_id * 10000000 ELSE id END FROM n UNION  -- the border is one region
  SELECT two.kind, two.b, min(cc.comp) FROM cc JOIN two ON two.a = cc.id AND two.kind = cc.kind JOIN recurring.cc AS old ON old.id = two.b AND old.kind = two.kind WHERE cc.comp < old.comp GROUP BY two.kind, two.b),
t AS (SELECT n.page_id, n.kind, n.id, n.line - 1 AS line, n.lo AS x FROM n JOIN cc ON cc.kind = n.kind AND cc.id = n.id WHERE cc.comp = n.id),
p AS (SELECT t.page_id, t.kind, t.id, o.kind AS parent_kind, cc.comp AS parent FROM t LEFT JOIN n o ON o.page_id = t.page_id AND o.line = t.line AND o.lo <= t.x AND o.hi >= t.x AND o.kind <> t.kind LEFT JOIN cc ON cc.kind = o.kind AND cc.id = o.id)"""
DEPTH = NEST + """, y(kind, id, page_id, depth) AS (SELECT kind, id, page_id, 0 FROM p WHERE parent IS NULL UNION ALL SELECT p.kind, p.id, p.page_id, y.depth + 1 FROM y JOIN p ON p.parent_kind = y.kind AND p.parent = y.id)"""


@query("containment_parent", NEST + " SELECT page_id, kind, CAST(id % 10000000 AS BIGINT) AS comp, parent_kind, CAST(parent % 10000000 AS BIGINT) AS parent FROM p")
def containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region around each region: an as-of lookup of the run above each region's first cell, within the page pass.
    ``T.contain`` is the join for regions from elsewhere."""

    def f(texts):
        page, ink, name, up_name, _ = kernel.nested(R.rasterise(texts), R.heights(texts), R.WIDTH)
        kinds = np.array(["ground", "ink"])
        return page, [pa.array(kinds[ink.astype(int)]), pa.array(kinds[1 - ink.astype(int)], mask=up_name < 0), name, pa.array(up_name, mask=up_name < 0)]

    return R.pages(docs(spark, sf_dir), f, "kind string, parent_kind string, comp long, parent long")


@query("nesting_depth", DEPTH + " SELECT page_id, kind, depth, count(*) AS n FROM y GROUP BY ALL")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each kind at each depth; ground is even and ink odd, the outside 0."""

    def f(texts):
        page, ink, _, _, depth = kernel.nested(R.rasterise(texts), R.heights(texts), R.WIDTH)
        key, n = np.unique(np.stack([page, ink, depth]), axis=1, return_counts=True)
        return key[0], [pa.array(np.array(["ground", "ink"])[key[1]]), key[2].astype(np.int32), n]

    return R.pages(docs(spark, sf_dir), f, "kind string, depth int, n long")


@query("nesting_parity", DEPTH + " SELECT CAST(count(*) FILTER ((depth % 2 = 1) <> (kind = 'ink')) AS BIGINT) AS odd, count(*) AS regions, CAST(max(depth) AS INTEGER) AS deepest FROM y")
def nesting_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose kind does not fit their depth, of which there should be none, beside how many there are."""
    d = nesting_depth(spark, sf_dir)
    wrong = (F.col("depth") % 2 == 1) != (F.col("kind") == "ink")
    return d.agg(F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("odd"), F.sum("n").alias("regions"), F.max("depth").alias("deepest"))


_SIDES = " UNION ALL ".join(f"SELECT page_id, line, x, '{s}' AS side FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.page_id = p.page_id AND q.line = p.line + {dy} AND q.x = p.x + {dx})" for s, dy, dx in (("up", -1, 0), ("down", 1, 0), ("left", 0, -1), ("right", 0, 1)))


@query("cracks", f"WITH {CELLS}, p AS (SELECT page_id, line, x FROM px WHERE ink) SELECT page_id, side, count(*) AS n FROM ({_SIDES}) GROUP BY ALL")
def cracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell sides between ink and ground, by side: run ends, and runs less what touches them on the next line."""
    return T.cracks(R.runs(docs(spark, sf_dir)))


@query("contour_areas", f"WITH {CELLS} SELECT page_id, count(*) AS area FROM px WHERE ink GROUP BY page_id")
def contour_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed areas of all boundary loops of a page add up to its ink."""
    return T.contours(R.runs(docs(spark, sf_dir))).groupBy("page_id").agg(F.sum("area").alias("area"))


@query("contour_loops", E8 + LABELS + """ SELECT n.page_id, CAST(coalesce(any_value(k.m), 0) - count(*) + 2 * count(DISTINCT cc.comp) AS BIGINT) AS loops, count(DISTINCT cc.comp) AS outer_loops
FROM n JOIN cc USING (id) LEFT JOIN (SELECT page_id, count(*) AS m FROM e GROUP BY page_id) k USING (page_id) GROUP BY n.page_id""")
def contour_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loop around each component and one in each hole."""
    c = T.contours(R.runs(docs(spark, sf_dir)))
    return c.groupBy("page_id").agg(F.count(F.lit(1)).alias("loops"), F.count_if(F.col("area") > 0).alias("outer_loops"))


@query("bitmaps", f"""WITH {CELLS}, b AS (SELECT page_id, max(x) - min(x) + 1 AS w, max(line) - min(line) + 1 AS h, min(x) AS x0, min(line) AS y0 FROM px WHERE ink GROUP BY page_id),
g AS (SELECT DISTINCT px.page_id, j.i AS j, i.i AS i FROM px JOIN b USING (page_id), range(12) j(i), range(12) i(i) WHERE ink AND px.line - y0 >= j.i * h // 12 AND px.line - y0 < greatest(j.i * h // 12 + 1, (j.i + 1) * h // 12) AND px.x - x0 >= i.i * w // 12 AND px.x - x0 < greatest(i.i * w // 12 + 1, (i.i + 1) * w // 12))
SELECT page_id, CAST(sum(CASE WHEN j < 4 THEN CAST(1 AS BIGINT) << (j * 12 + i) ELSE 0 END) AS BIGINT) AS w0, CAST(sum(CASE WHEN j >= 4 AND j < 8 THEN CAST(1 AS BIGINT) << ((j - 4) * 12 + i) ELSE 0 END) AS BIGINT) AS w1, CAST(sum(CASE WHEN j >= 8 THEN CAST(1 AS BIGINT) << ((j - 8) * 12 + i) ELSE 0 END) AS BIGINT) AS w2 FROM g GROUP BY page_id""")
def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's ink as a grid of 12 by 12, a cell set where it has any; cells overlap on pages smaller than that.
    ``T.bitmap`` is the plan for runs from elsewhere, or of components."""

    return R.pages(docs(spark, sf_dir), lambda texts: kernel.bitmap(R.rasterise(texts)), "w0 long, w1 long, w2 long")


@query("topology_records")
def topology_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about each component in a row: runs, holes, moments, axis, events."""
    lab = labelled(spark, sf_dir)
    m = T.moments(lab, "page_id", "comp")
    t = T.component_table(lab)
    g = lab.groupBy("page_id", "comp").agg(*[F.count_if(c).alias(k) for k, c in (("births", F.col("up") == 0), ("closes", F.col("down") == 0), ("merges", F.col("up") >= 2), ("splits", F.col("down") >= 2))])
    return t.join(m, ["page_id", "comp"]).join(g, ["page_id", "comp"]).withColumns(T.axis_columns() | {"chi": 1 - F.col("holes")})
