"""Queries on sources and sinks: bytes are made from the tables, written, read back and compared; and small functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantopo.functions.evidence import general
from scantopo.operators import detect as D
from scantopo.operators import geometry as G
from scantopo.operators import stats
from scantopo.operators import topology as T
from scantopo.plans.catalogue import query, table
from scantopo.plans.spatial_queries import B, boxes
from scantopo.plans.topology_queries import CELLS, NEST, RUNS, as_longs, docs, sizes_of
from scantopo.sources import documents, images
from scantopo.sources import text_raster as R

_RUNS = RUNS + " SELECT page_id, CAST(line AS BIGINT) AS line, lo, hi FROM r"
_BAND = 16


def _picture(text: str) -> np.ndarray:
    """Gray levels of a page: ink 0, ground and what is past the end 255."""
    r = R.rasterise([text])
    img = np.full((-(-len(text) // R.WIDTH), R.WIDTH), 255, np.uint8)
    for y, a, z in zip(r.line.tolist(), r.lo.tolist(), r.hi.tolist(), strict=True):
        img[y, a : z + 1] = 0
    return img


def _files(spark: SparkSession, sf_dir: str, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(path, content): each page that has cells as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in R.groups(b.column(1)):
                made = [encode(_picture(t)) for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(made, pa.binary())], names=["path", "content"])

    d = docs(spark, sf_dir).filter(F.length("text") > 0)
    return d.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "path string, content binary")


def _read(found: DataFrame) -> DataFrame:
    r = images.runs(found)
    return as_longs(r.select(F.regexp_extract("page_id", "^(.*)#", 1).cast("long").alias("page_id"), F.regexp_extract("page_id", "#(.*)$", 1).cast("long").alias("page_no"), "line", "lo", "hi"), "line", "lo", "hi")


@query("png_scan", _RUNS)
def png_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as PNG files, their lines with each of the five filters in turn, and read back."""
    return _read(images.decode(_files(spark, sf_dir, lambda g: images.write_png(np.repeat(g[..., None], 3, 2), 300.0, (0, 1, 2, 3, 4))))).drop("page_no")


@query("png_pages", f"WITH {CELLS} SELECT page_id, CAST(0 AS INTEGER) AS page_no, CAST(64 AS INTEGER) AS width, CAST(max(line) + 1 AS INTEGER) AS height, 300 AS dpi, true AS neutral FROM px GROUP BY page_id")
def png_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, resolution and neutrality of the pages as files say them."""
    p = images.decode(_files(spark, sf_dir, lambda g: images.write_png(np.repeat(g[..., None], 3, 2), 300.0)))
    return p.select(F.col("path").cast("long").alias("page_id"), "page_no", "width", "height", F.round("dpi").cast("int").alias("dpi"), "neutral")


@query("pgm_scan", _RUNS)
def pgm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(images.decode(_files(spark, sf_dir, images.write_pgm), 300.0)).drop("page_no")


@query("pnm_stream_scan", RUNS + f" SELECT page_id, CAST(line // {_BAND} AS BIGINT) AS page_no, CAST(line % {_BAND} AS BIGINT) AS line, lo, hi FROM r")
def pnm_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several images, one after the other: bands of sixteen lines of a page."""
    return _read(images.decode(_files(spark, sf_dir, lambda g: b"".join(images.write_pgm(g[y : y + _BAND]) for y in range(0, len(g), _BAND))), 300.0))


@query("threshold_ink", "SELECT doc_id AS page_id, count(*) FILTER (g < 100) AS dark, count(*) FILTER (g >= 100) AS light FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?s).'), lambda ch: ord(ch) * 37 % 256)) AS g FROM documents) GROUP BY doc_id")
def threshold_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink under and over a threshold, where each code point has a gray level of its own."""

    def f(texts):
        points, page, _ = R.cells(texts)
        gray = (points.astype(np.int64) * 37 % 256).astype(np.uint8)
        n = [np.bincount(page, images.ink(gray, 100, dark), minlength=len(texts)).astype(np.int64) for dark in (True, False)]
        own = np.unique(page)
        return own, [x[own] for x in n]

    return R.pages(docs(spark, sf_dir), f, "dark long, light long")


@query("picture_scan", _RUNS)
def picture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn as pictures of characters and read again."""
    drawn = T.draw(R.runs(docs(spark, sf_dir)))
    return as_longs(T.runs_from_lines(T.pictures(drawn)), "line", "lo", "hi")


@query("fixed_width_scan", "SELECT n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def fixed_width_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a rule of dashes under their heads, one for each region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("path"), F.col("n_nationkey").cast("int").alias("k"), F.concat(F.rpad("n_name", 26, " "), F.col("n_nationkey").cast("string")).alias("value"))
    head = n.select("path").distinct().select("path", F.inline(F.array(F.struct(F.lit(-2).alias("k"), F.lit("name                      key").alias("value")), F.struct(F.lit(-1).alias("k"), F.lit("-" * 25 + " " + "-" * 10).alias("value")))))
    text = n.unionByName(head).select("path", F.col("k").alias("pos"), "value")
    cells = documents.fixed_width(text)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    return cells.select("path", rank.cast("long").alias("n"), F.col("cells")[0].alias("name"), F.col("cells")[1].alias("key"))


@query("coco_json_sink", B + " SELECT page_id, count(*) AS annotations, CAST(sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS BIGINT) AS size, (SELECT count(DISTINCT label) FROM b) AS categories FROM b GROUP BY page_id")
def coco_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written as JSON, read again and summed."""
    j = documents.coco_json(boxes(spark, sf_dir))
    kind = "struct<images:array<struct<id:long>>,annotations:array<struct<id:long,image_id:long,category_id:int,bbox:array<long>>>,categories:array<struct<id:int,name:string>>>"
    d = j.select(F.from_json("json", kind).alias("d"))
    size = F.aggregate("d.annotations", F.lit(0).cast("long"), lambda a, x: a + x["bbox"][2] * x["bbox"][3])
    return d.select(F.col("d.images")[0]["id"].alias("page_id"), F.size("d.annotations").cast("long").alias("annotations"), size.alias("size"), F.size("d.categories").cast("long").alias("categories"))


@query("padded_ground", NEST + " SELECT page_id, CAST(line AS BIGINT) AS line, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM gr WHERE lo <= hi AND page_id IN (SELECT doc_id FROM documents WHERE length(text) > 0)")
def padded_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complement with a border of one cell."""
    d = docs(spark, sf_dir).filter(F.length("text") > 0)
    return as_longs(T.complement(R.runs(d), sizes_of(d), pad=1), "line", "lo", "hi")


@query("page_features", f"WITH {CELLS} SELECT page_id, round((max(x) - min(x) + 1)::DOUBLE / (max(line) - min(line) + 1), 9) AS aspect, round(count(*)::DOUBLE / ((max(x) - min(x) + 1) * (max(line) - min(line) + 1)), 9) AS fill, round(CASE WHEN var_pop(x) > 0 AND var_pop(line) > 0 THEN covar_pop(x, line) / sqrt(var_pop(x) * var_pop(line)) ELSE 0 END, 6) + 0.0 AS slant FROM px WHERE ink GROUP BY page_id")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect, fill and lean of pages."""
    m = T.moments(R.runs(docs(spark, sf_dir)), "page_id")
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return m.select("page_id", F.round(w / h, 9).alias("aspect"), F.round(F.col("area") / (w * h), 9).alias("fill"), (F.round(T.axis_columns()["slant"], 6) + 0.0).alias("slant"))


_RELATIONS = "q AS (SELECT l_orderkey AS expr_id, CAST(1 AS BIGINT) AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax) + 1 AS j, CASE l_returnflag WHEN 'A' THEN 'SUB' WHEN 'N' THEN 'SUPER' ELSE 'NEXT' END AS rel FROM lineitem), p AS (SELECT expr_id, i, min(j) AS j, rel FROM q GROUP BY ALL)"


@query("script_chains", f"WITH {_RELATIONS} SELECT p.expr_id, CASE WHEN p.rel = 'SUPER' AND s.j IS NOT NULL THEN s.j ELSE p.i END AS i, p.j, p.rel FROM p LEFT JOIN p s ON s.expr_id = p.expr_id AND s.i = p.i AND s.rel = 'SUB'")
def script_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superscripts hung on subscripts where a base has both."""
    b = boxes(spark, sf_dir)
    rel = F.when(F.col("label") == "A", "SUB").when(F.col("label") == "N", "SUPER").otherwise("NEXT")
    p = b.select(F.col("page_id").alias("expr_id"), F.lit(1).cast("long").alias("i"), (F.col("id") + 1).alias("j"), rel.alias("rel")).groupBy("expr_id", "i", "rel").agg(F.min("j").alias("j"))
    return G.chained(p)


@query("angles", "SELECT l_orderkey AS id, l_linenumber AS n, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) + 0.0 AS angle FROM (SELECT l_orderkey, l_linenumber, degrees(atan2(-(l_quantity::DOUBLE - 25), (l_linenumber - 4)::DOUBLE)) AS a FROM lineitem WHERE l_quantity <> 25 OR l_linenumber <> 4)")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions counterclockwise as one sees them."""
    t = table(spark, sf_dir, "lineitem").filter("l_quantity <> 25 OR l_linenumber <> 4")
    a = G.angle_ccw((F.col("l_linenumber") - 4).cast("double"), F.col("l_quantity").cast("double") - 25)
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.round(a, 6) + 0.0).alias("angle"))


@query("page_maps", B + " SELECT page_id, id, 2.0::DOUBLE * x0 AS x0, 2.0::DOUBLE * (792 - y1) AS y0, 2.0::DOUBLE * x1 AS x1, 2.0::DOUBLE * (792 - y0) AS y1, 2.0::DOUBLE * y0 AS rx0, 2.0::DOUBLE * x0 AS ry0 FROM b")
def page_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in points from the lower left as pixels from the upper left, upright and after a quarter turn."""
    b = boxes(spark, sf_dir)
    own = [F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")]
    up, turned = (G.box(G.page_map(792.0, 144.0, r), *own) for r in (0, 90))
    return b.select("page_id", "id", *[c.alias(k) for c, k in zip(up, ("x0", "y0", "x1", "y1"), strict=True)], turned[0].alias("rx0"), turned[1].alias("ry0"))


@query("entropies", "SELECT l_linestatus AS by, round(entropy(l_returnflag), 9) AS h FROM lineitem GROUP BY l_linestatus")
def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("by"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return stats.entropy_of(n, ["by"]).select("by", F.round("h", 9).alias("h"))


@query("thin_columns", """WITH t AS (SELECT l_orderkey AS page_id, l_linenumber AS col, l_partkey % 500 AS x0, l_partkey % 500 + CAST(l_quantity AS BIGINT) AS x1 FROM lineitem), w AS (SELECT page_id, max(x1) - min(x0) AS w FROM t GROUP BY page_id),
s AS (SELECT page_id, col, quantile_cont(x0, 0.5) AS x0, quantile_cont(x1, 0.5) AS x1, any_value(w) AS w FROM t JOIN w USING (page_id) GROUP BY page_id, col), l AS (SELECT * FROM s WHERE x1 - x0 >= 0.02::DOUBLE * w),
k AS (SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.page_id = a.page_id AND b.x1 - b.x0 > a.x1 - a.x0 AND a.x0 >= b.x0 AND a.x1 <= b.x1)) SELECT page_id, count(*) AS kept, min(x0) AS first FROM k GROUP BY page_id""")
def thin_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns left once the thin ones and those within wider ones are gone."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.monotonically_increasing_id().alias("id"), F.lit(0).alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_partkey") % 500).alias("x0"), (F.col("l_partkey") % 500 + F.col("l_quantity").cast("long")).alias("x1"))
    c = D.drop_thin_columns(t)
    by = c.groupBy("page_id", "col").agg(F.percentile("x0", F.lit(0.5)).alias("x0"))
    return by.groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"), F.min("x0").alias("first"))


@query("number_format", "SELECT l_orderkey AS id, l_linenumber AS n, format('{:.3g}', l_extendedprice::DOUBLE / power(10, l_linenumber * 2 - 3)) AS text FROM lineitem")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in three significant digits, over many powers of ten."""
    v = F.col("l_extendedprice").cast("double") / F.pow(F.lit(10.0), F.col("l_linenumber") * 2 - 3)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), general(v).alias("text"))
