"""Grids, bands, rows and sequences of boxes: window operators in one pass over sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper of two; an aggregate."""
    s = F.array_sort(F.collect_list(values))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def mode_of(values: Column, quantum: float = 1.0) -> Column:
    """The commonest value, rounded half to even to ``quantum``; the smallest of those as common; an aggregate."""
    return F.mode(F.bround(values / quantum, 0) * quantum, True)


def bands(df: DataFrame, key: list[str], value: str, tol: float, name: str) -> DataFrame:
    """``df`` with ``name``: the number of the band of its value, a new one where the gap to the value before exceeds
    ``tol``. Distinct values are numbered, so that a crowded value costs the window one row."""
    w = Window.partitionBy(*key).orderBy(value)
    d = df.select(*key, value).distinct()
    new = F.when(F.col(value) - F.lag(value).over(w) > tol, 1).otherwise(0)
    d = d.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")
    return df.join(d, [*key, value])


def cell_grid(cells: DataFrame, tol: float = 0) -> DataFrame:
    """(page_id, id, row, col, row_span, col_span) of cells (page_id, id, x0, y0, x1, y1): the bands of their upper left
    corners, and how many bands start within each."""
    g = bands(bands(cells, ["page_id"], "y0", tol, "row"), ["page_id"], "x0", tol, "col")
    starts = {k: g.groupBy("page_id", k).agg(F.min(v).alias("at")).groupBy("page_id").agg(F.array_sort(F.collect_list("at")).alias(f"{k}_starts")) for k, v in (("row", "y0"), ("col", "x0"))}
    g = g.join(starts["row"], "page_id").join(starts["col"], "page_id")
    span = lambda k, lo, hi: F.greatest(F.lit(1), F.size(F.filter(f"{k}_starts", lambda s: (s >= F.col(lo)) & (s < F.col(hi)))))
    return g.select("page_id", "id", "row", "col", span("row", "y0", "y1").alias("row_span"), span("col", "x0", "x1").alias("col_span"))


def weight_classes(items: DataFrame, tol: float = 0.25) -> DataFrame:
    """(page_id, id, weight): bands of ratio, cut at gaps above ``tol`` medians of the page; and whether it is the modal."""
    med = items.groupBy("page_id").agg(F.percentile("ratio", F.lit(0.5)).alias("med"))
    w = Window.partitionBy("page_id").orderBy("ratio")
    d = items.select("page_id", "ratio").distinct().join(med, "page_id")
    d = d.withColumn("new", F.when(F.col("ratio") - F.lag("ratio").over(w) > tol * F.col("med"), 1).otherwise(0)).withColumn("weight", F.sum("new").over(w))
    c = items.join(d.select("page_id", "ratio", "weight"), ["page_id", "ratio"])
    modal = c.groupBy("page_id").agg(F.mode("weight", True).alias("modal"))
    return c.join(modal, "page_id").select("page_id", "id", "weight", (F.col("weight") == F.col("modal")).alias("modal"))


def white_gaps(runs: DataFrame, least: int) -> DataFrame:
    """(page_id, line, lo, hi) of white between runs of a line, of at least ``least`` cells; none at the line's ends."""
    w = Window.partitionBy("page_id", "line").orderBy("lo")
    return runs.withColumns({"a": F.col("hi") + 1, "z": F.lead("lo").over(w) - 1}).filter(F.col("z") - F.col("a") + 1 >= least).select("page_id", "line", F.col("a").alias("lo"), F.col("z").alias("hi"))


def widest_gap(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """The middle of the widest gap between sorted values, the first of equal ones; nothing for one value."""
    w = Window.partitionBy(*key).orderBy(value)
    g = values.select(*key, value).withColumn("next", F.lead(value).over(w)).filter("next is not null")
    return g.groupBy(*key).agg(F.max_by((F.col(value) + F.col("next")) / 2.0, F.struct(F.col("next") - F.col(value), -F.col(value))).alias("cut"), F.max(F.col("next") - F.col(value)).alias("gap"))


def gap_histogram(values: DataFrame, key: list[str], value: str, edges: list[float]) -> DataFrame:
    """Gaps between neighbours counted by the number of ``edges`` at or below them."""
    w = Window.partitionBy(*key).orderBy(value)
    g = values.select(*key, value).withColumn("gap", F.col(value) - F.lag(value).over(w)).filter("gap is not null")
    bin_ = sum((F.when(F.col("gap") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return g.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scripts(glyphs: DataFrame, ratio: float = 0.8, offset: float = 0.25) -> DataFrame:
    """(page_id, id, script): sub or super for glyphs of a row that are small and off its line, by the row's modal height
    (``h``) and commonest foot (``y1``)."""
    row = glyphs.groupBy("page_id", "row").agg(mode_of(F.col("h").cast("double")).alias("x"), F.mode("y1", True).alias("foot"))
    g = glyphs.join(row, ["page_id", "row"])
    rise = F.col("foot") - F.col("y1")
    kind = F.when((F.col("h") / F.col("x") < ratio) & (F.abs(rise) > offset * F.col("x")), F.when(rise > 0, "super").otherwise("sub")).otherwise("none")
    return g.select("page_id", "id", kind.alias("script"))


def rightmost(boxes: DataFrame) -> DataFrame:
    """The last box of each page by (x1, -y1), and its height over the median height."""
    h = F.col("y1") - F.col("y0") + 1
    a = boxes.groupBy("page_id").agg(F.max_by(F.struct("id", h.alias("h")), F.struct("x1", -F.col("y1"), -F.col("id"))).alias("m"), F.percentile(h, F.lit(0.5)).alias("med"))
    return a.select("page_id", F.col("m.id").alias("id"), F.round(F.col("m.h") / F.col("med"), 9).alias("ratio"))


def locate(rows: DataFrame, target: list[float], slack: int = 2) -> DataFrame:
    """The window of consecutive items of a row whose sums are nearest ``target`` in absolute differences.

    ``rows`` has page_id, row, pos and features f0, f1, ... as many as ``target`` after its first entry, which is the
    number of items; windows have from n - slack to n + slack items. The first of equals in (row, length, place).
    """
    n = int(target[0])
    out = None
    for k in range(max(1, n - slack), n + slack + 1):
        w = Window.partitionBy("page_id", "row").orderBy("pos").rowsBetween(0, k - 1)
        sums = [F.sum(f"f{i}").over(w) for i in range(len(target) - 1)]
        d = sum((F.abs(s - t) for s, t in zip(sums, target[1:], strict=True)), F.lit(abs(k - n)).cast("double"))
        one = rows.select("page_id", "row", "pos", F.lit(k).alias("k"), d.alias("d"), F.count(F.lit(1)).over(w).alias("c")).filter(F.col("c") == k)
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("page_id").agg(F.min_by(F.struct("row", "k", "pos", "d"), F.struct("d", "row", "k", "pos")).alias("b"))
    return best.select("page_id", "b.row", "b.k", "b.pos", "b.d")


def resample(points: DataFrame, count: int) -> DataFrame:
    """(line_id, i, x, y): ``count`` points evenly spaced along each polyline (line_id, pos, x, y)."""
    w = Window.partitionBy("line_id").orderBy("pos")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    p = points.withColumn("step", step).withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumns({"s1": F.lead("s").over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w)})
    total = p.groupBy("line_id").agg(F.max("s").alias("len"), F.max("pos").alias("last"))
    at = total.select("line_id", "len", "last", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).withColumn("t", F.col("len") * F.col("i") / (count - 1))
    on = (at["t"] >= F.col("s")) & ((at["t"] < F.col("s1")) | F.col("s1").isNull())
    j = at.join(p.drop("len"), "line_id").filter(on)
    f = F.when(F.col("s1").isNull() | (F.col("s1") == F.col("s")), 0.0).otherwise((F.col("t") - F.col("s")) / (F.col("s1") - F.col("s")))
    mid = lambda k: F.when(F.col("s1").isNull(), F.col(k)).otherwise(F.col(k) + f * (F.col(f"{k}1") - F.col(k)))
    return j.select("line_id", "i", mid("x").alias("x"), mid("y").alias("y"))


def fit_line(points: DataFrame) -> DataFrame:
    """(line_id, tall, slope, intercept): least squares along the longer side of the points' box."""
    a = points.groupBy("line_id").agg(
        (F.max("y") - F.min("y") > F.max("x") - F.min("x")).alias("tall"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.regr_slope("x", "y").alias("c"), F.regr_intercept("x", "y").alias("d")
    )
    return a.select("line_id", "tall", F.when(F.col("tall"), F.col("c")).otherwise(F.col("a")).alias("slope"), F.when(F.col("tall"), F.col("d")).otherwise(F.col("b")).alias("intercept"))


def seam(blocks: DataFrame, width: int, budget: int = 1) -> DataFrame:
    """(page_id, cost, path) of the path of least ink from the first block row to the last, one block a row, moving at
    most ``budget`` sideways; the leftmost of equals. ``blocks`` has page_id, by, bx, ink for blocks with ink.

    A fold over the page's rows: the cost of reaching each block, with the path to it.
    """
    row = blocks.groupBy("page_id", "by").agg(F.map_from_entries(F.collect_list(F.struct("bx", "ink"))).alias("m"))
    page = row.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("by", "m"))).alias("rows"), F.max("by").cast("int").alias("last"))
    cols = F.sequence(F.lit(0), F.lit(width - 1))
    ink = lambda y, x: F.coalesce(F.element_at(F.element_at(F.col("rows"), y.cast("long")), x.cast("long")), F.lit(0)).cast("long")
    start = F.transform(cols, lambda x: F.struct(ink(F.lit(0), x).alias("cost"), F.array(x).alias("path")))

    def step(acc: Column, y: Column) -> Column:
        def reach(x: Column) -> Column:
            near = F.slice(acc, F.greatest(F.lit(1), x + 1 - budget), F.least(F.lit(width), x + 1 + budget) - F.greatest(F.lit(1), x + 1 - budget) + 1)
            best = F.array_min(F.transform(near, lambda p: F.struct(p["cost"].alias("cost"), F.element_at(p["path"], -1).alias("x"), p["path"].alias("path"))))
            return F.struct((best["cost"] + ink(y, x)).alias("cost"), F.concat(best["path"], F.array(x)).alias("path"))

        return F.transform(cols, reach)

    ends = F.when(F.col("last") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("last"))), start, step)).otherwise(start)
    best = F.array_min(F.transform(ends, lambda p: F.struct(p["cost"].alias("cost"), F.element_at(p["path"], -1).alias("x"), p["path"].alias("path"))))
    return page.select("page_id", best.alias("b")).select("page_id", F.col("b.cost").alias("cost"), F.col("b.path").alias("path"))
