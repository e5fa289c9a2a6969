"""Records of a page: glyphs and rules, the two routes to its blocks, ink from outside a crop, drift, run metrics, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantopo.functions.intervals import gap
from scantopo.operators.formulas import parts_of_glyphs
from scantopo.operators.spatial import group_by_links, is_rule, pairs
from scantopo.operators.stats import at_index
from scantopo.operators.topology import axis_columns

#: The dimensions of each domain that features are sorted into; two domains have none yet.
DIMENSIONS = {
    "size": ("aspect", "width", "area", "height"),
    "shape": ("elongation", "fill"),
    "topology": ("splits", "merges", "births", "cycles", "depth"),
    "position": ("x", "y"),
    "transform": (),
    "typographic": (),
}
#: Selections above either are large and must be confirmed.
LARGE_DOCS, LARGE_PAGES = 25, 5000
SUMS = ("area", "sx", "sy", "sxx", "syy", "sxy")


def dimensions_of(domain: str) -> tuple[str, ...]:
    """The dimensions of a domain, possibly none; an unknown domain is an error."""
    return DIMENSIONS[domain]


def width() -> Column:
    return F.col("x1") - F.col("x0") + 1


def height() -> Column:
    return F.col("y1") - F.col("y0") + 1


def rule_records(boxes: DataFrame, pt: float) -> DataFrame:
    """(page_id, id, width_pt, orient): a stroke's width is its area over its longer side."""
    w, h = width(), height()
    return boxes.select("page_id", "id", (F.col("area") / F.greatest(w, h) * pt).alias("width_pt"), F.when(w >= h, "h").otherwise("v").alias("orient"))


def glyph_lines(parts: DataFrame) -> DataFrame:
    """(page_id, id, box, area, holes, components, parts, cx, cy, elongation): a line for each glyph, the parts of which
    stand over one another in a row.

    ``parts`` are components with row, holes and their sums; rules are left out. A glyph's axis is that of the sums of
    its parts, which add exactly; its id is the least of theirs.
    """
    own = parts.filter(~is_rule(F.col("area"), width(), height()))
    g = parts_of_glyphs(own).groupBy("page_id", F.col("grp").alias("id"))
    box = [*[F.min(k).alias(k) for k in ("x0", "y0")], *[F.max(k).alias(k) for k in ("x1", "y1")]]
    g = g.agg(*box, *[F.sum(k).alias(k) for k in (*SUMS, "holes")], F.count(F.lit(1)).alias("components"), F.array_sort(F.collect_list(F.col("id").cast("long"))).alias("parts"))
    axis = axis_columns()
    return g.select("page_id", "id", "x0", "y0", "x1", "y1", "area", "holes", "components", "parts", *[axis[k].alias(k) for k in ("cx", "cy", "elongation")])


def both_routes(ink: DataFrame, white: DataFrame) -> DataFrame:
    """Lines found as ink and as content between white, beside each other: neither route takes in the other, so nothing
    that they both see is left out. Columns that one route lacks are null."""
    return ink.withColumn("route", F.lit("ink")).unionByName(white.withColumn("route", F.lit("white")), allowMissingColumns=True)


def foreign_ink(boxes: DataFrame, sizes: DataFrame, scale: float = 1.0, tol: int = 0, anchor: str = "edge") -> DataFrame:
    """``boxes`` (page_id, id, box, area) of crops with at_edge, separated, edged, extreme and overrun.

    Boxes at most ``scale`` median widths apart are one cluster, and the cluster of most ink (then of most boxes, then
    of the least id) is the crop's own; the others are separated. Such a cluster is edged if a box of it reaches within
    ``tol`` of the border of ``sizes`` (page_id, width, height), and extreme if no cluster reaches further on some side.
    ``anchor`` says which of the two makes it ink from outside.
    """
    if anchor not in ("edge", "extreme"):
        raise ValueError(f"anchor must be 'edge' or 'extreme', not {anchor!r}")
    med = boxes.groupBy("page_id").agg(F.percentile(width(), F.lit(0.5)).alias("med_width"))
    b = boxes.join(med, "page_id").join(sizes, "page_id")
    near = (F.col("a.id") < F.col("b.id")) & (F.greatest(F.lit(0), gap("a", "b") - 1) <= scale * F.col("a.med_width"))
    links = pairs(b, b, near).select("a.page_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    b = group_by_links(b, links)
    b = b.withColumn("at_edge", (F.col("x0") <= tol) | (F.col("y0") <= tol) | (F.col("x1") >= F.col("width") - 1 - tol) | (F.col("y1") >= F.col("height") - 1 - tol))
    page, of = Window.partitionBy("page_id"), Window.partitionBy("page_id", "grp")
    rank = F.struct(F.sum("area").over(of).alias("area"), F.count(F.lit(1)).over(of).alias("n"), (-F.col("grp")).alias("grp"))
    b = b.withColumn("_rank", rank).withColumn("separated", F.col("_rank") != F.max("_rank").over(page))
    ends = [(F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")]
    reach = F.lit(False)
    for f, k in ends:
        reach |= f(k).over(of) == f(k).over(page)
    b = b.withColumns({"edged": F.col("separated") & F.max("at_edge").over(of), "extreme": F.col("separated") & reach}).drop("_rank")
    return b.withColumn("overrun", F.col("edged" if anchor == "edge" else "extreme"))


def fit_affine(points: DataFrame, by: str) -> DataFrame:
    """(by, a, b, c, d, e, f): x' = a x + b y + e and y' = c x + d y + f from matched points (by, x, y, u, v), by least
    squares with each axis taken by itself; null with fewer than three points or without spread on an axis."""
    mean = points.groupBy(by).agg(*[F.avg(k).alias(f"m{k}") for k in "xyuv"], F.count(F.lit(1)).alias("n"))
    off = {k: F.col(k) - F.col(f"m{k}") for k in "xyuv"}
    s = points.join(mean, by).groupBy(by).agg(
        *[F.sum(off[p] * off[q]).alias(p + q) for p, q in ("xx", "yy", "xu", "yu", "xv", "yv")], *[F.first(f"m{k}").alias(f"m{k}") for k in "xyuv"], F.first("n").alias("n")
    )
    ok = (F.col("n") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0)
    a, b, c, d = (F.when(ok, F.try_divide(n, m)) for n, m in ((F.col("xu"), F.col("xx")), (F.col("yu"), F.col("yy")), (F.col("xv"), F.col("xx")), (F.col("yv"), F.col("yy"))))
    e, f = F.col("mu") - a * F.col("mx") - b * F.col("my"), F.col("mv") - c * F.col("mx") - d * F.col("my")
    return s.select(by, *[v.alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def drift(a: Column, b: Column) -> Column:
    """By how much two counts differ, as a share of the larger; 0 where both are 0."""
    return F.when((a == 0) & (b == 0), 0.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1)))


def compare_drift(source: DataFrame, moved: DataFrame, sampled: DataFrame, channels: tuple[str, ...] = ("components", "holes")) -> DataFrame:
    """(page_id, moved_..., sampled_..., moved_is_nearer): drift of each channel of two readings from the source's; the
    verdict is null where the channels disagree."""
    side = lambda d, p: d.select("page_id", *[F.col(k).alias(f"{p}_{k}") for k in channels])
    j = source.join(side(moved, "m"), "page_id", "left").join(side(sampled, "s"), "page_id", "left").fillna(0, [f"{p}_{k}" for p in "ms" for k in channels])
    out = j.select("page_id", *[drift(F.col(k), F.col(f"{p[0]}_{k}")).alias(f"{p}_{k}") for p in ("moved", "sampled") for k in channels])
    nearer = [F.col(f"moved_{k}") < F.col(f"sampled_{k}") for k in channels]
    same = F.lit(True)
    for x in nearer[1:]:
        same &= x == nearer[0]
    return out.withColumn("moved_is_nearer", F.when(same, nearer[0]))


def run_metrics(tasks: DataFrame, by: str, seconds: str, wall: Column, workers: int) -> DataFrame:
    """(by, tasks, busy, longest, wall, utilisation, speedup, ceiling) of the tasks of each run: busy time over wall time
    and workers, over wall time, and over the longest task, which bounds any speedup."""
    t = tasks.groupBy(by).agg(F.count(F.lit(1)).alias("tasks"), F.sum(seconds).cast("double").alias("busy"), F.max(seconds).cast("double").alias("longest"), wall.cast("double").alias("wall"))
    share = lambda n, m: F.coalesce(F.try_divide(n, m), F.lit(0.0))
    return t.withColumns({"utilisation": share(F.col("busy"), F.col("wall") * workers), "speedup": share(F.col("busy"), F.col("wall")), "ceiling": share(F.col("busy"), F.col("longest"))})


def select(docs: DataFrame, limit: int | str | None, order: str = "doc_id") -> DataFrame:
    """The first ``limit`` documents, or "all" of them; a run over a corpus is asked for and never fallen into."""
    if limit is None:
        raise ValueError("limit is required: a number of documents, or 'all'")
    if str(limit).lower() == "all":
        return docs
    if not str(limit).isdigit() or int(limit) < 1:
        raise ValueError(f"limit must be a number of at least 1 or 'all', not {limit!r}")
    return docs.orderBy(order).limit(int(limit))


def plan(chosen: DataFrame, pages: Column) -> DataFrame:
    """(docs, pages, large) of a selection, counted exactly in one narrow aggregate; large ones are to be confirmed."""
    p = chosen.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(pages), F.lit(0)).cast("long").alias("pages"))
    return p.withColumn("large", (F.col("docs") > LARGE_DOCS) | (F.col("pages") > LARGE_PAGES))


def gate(docs: DataFrame, limit: int | str | None, pages: Column, yes: bool = False, order: str = "doc_id") -> DataFrame:
    """``select``, refused if large unless ``yes``."""
    chosen = select(docs, limit, order)
    p = plan(chosen, pages).collect()[0]
    if p["large"] and not yes:
        raise ValueError(f"{p['docs']} documents, {p['pages']} pages: above {LARGE_DOCS} documents or {LARGE_PAGES} pages, so this needs yes=True")
    return chosen


def keyed(tasks: DataFrame, key: str) -> DataFrame:
    """``tasks`` in order of ``key``; a key that occurs twice is an error, as results are named by it."""
    n = tasks.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("task named twice: "), F.col(key).cast("string"))).cast("long")))
    return tasks.join(n, key).filter("_n = 1").drop("_n").orderBy(key)


def split_by(rows: DataFrame, group: str, label: str, share: int = 4, least: int = 12) -> DataFrame:
    """``rows`` with train: whole groups go to one side, by the first byte of the digest of their name, so that no twin of a
    test row is in training. Classes of fewer than ``least`` rows are left out, and those not on both sides."""
    byte = F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 2), 16, 10).cast("int")
    r = rows.withColumn("train", byte % share != 0)
    both = r.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("m")).filter((F.col("n") >= least) & (F.col("m") > 0) & (F.col("m") < F.col("n")))
    return r.join(both.select(label), label, "left_semi")


def percentiles_by_index(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(by, n, p10, p50, p90): the sorted value at floor(share * n), the last at most."""
    at = lambda s: F.least(F.floor(F.col("n") * s), F.col("n") - 1)
    return at_index(rows, [by], value, **{f"p{round(100 * s)}": at(s) for s in shares})
