"""Objects of a page from its regions: tables, diagrams, rules; lattice repair; residual of two readings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scantopo.functions.intervals import inside
from scantopo.operators.layout import cell_grid, upper_median
from scantopo.operators.spatial import is_rule, pairs, size

#: Ink regions at least so many median heights large are looked at; a hollow one is filled less than this.
SCALE, HOLLOW = 3.0, 0.35


def holes_of(regions: DataFrame) -> DataFrame:
    """(page_id, id, holes, cells) of ink regions: how many background regions stand in each, and how many of these are
    at least as large as SCALE / 3 median heights on both sides. ``regions`` has kind, parent, area and a closed box."""
    h = F.col("y1") - F.col("y0") + 1
    med = regions.filter("kind = 'ink'").groupBy("page_id").agg(upper_median(h).alias("med"))
    hole = regions.filter("kind = 'ground' and parent is not null").join(med, "page_id")
    big = (F.col("x1") - F.col("x0") + 1 >= F.col("med")) & (h >= F.col("med"))
    return hole.groupBy("page_id", F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("holes"), F.count_if(big).alias("cells"))


def page_objects(regions: DataFrame) -> DataFrame:
    """(page_id, id, type, x0, y0, x1, y1, area, holes): tables (two cells or more), diagrams (hollow, large enough and
    with ink in them) and rules (long, filled), largest first within a page by ``rank``."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    ink = regions.filter("kind = 'ink'")
    med = ink.groupBy("page_id").agg(upper_median(h).alias("med"))
    r = ink.join(med, "page_id").join(holes_of(regions), ["page_id", "id"], "left").fillna(0, ["holes", "cells"])
    large = F.greatest(w, h) >= SCALE * F.col("med")
    content = pairs(r, ink, (F.col("a.id") != F.col("b.id")) & inside("b", "a")).select("a.page_id", F.col("a.id").alias("id")).distinct().withColumn("content", F.lit(True))
    r = r.join(content, ["page_id", "id"], "left")
    hollow = (F.col("area") / (w * h) < HOLLOW) & (F.col("holes") > 0)
    kind = F.when(is_rule(F.col("area"), w, h), "rule").when(large & (F.col("cells") >= 2), "table").when(large & hollow & F.col("content"), "diagram")
    out = r.withColumn("type", kind).filter("type is not null")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(size("a")), "id"))
    return out.alias("a").withColumn("rank", rank).select("page_id", "id", "type", "x0", "y0", "x1", "y1", "area", "holes", "rank")


def table_cells(regions: DataFrame, tol: float = 0.0) -> DataFrame:
    """(page_id, table, id, row, col, row_span, col_span): the cells of the region with the most holes on each page (the
    first of equals), in its grid."""
    n = holes_of(regions)
    best = n.groupBy("page_id").agg(F.min_by("id", F.struct(-F.col("holes"), F.col("id"))).alias("table"))
    cells = regions.filter("kind = 'ground'").join(best, (regions["page_id"] == best["page_id"]) & (regions["parent"] == best["table"])).drop(best["page_id"])
    return cell_grid(cells, tol).join(best, "page_id").select("page_id", "table", "id", "row", "col", "row_span", "col_span")


def _holes(r: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """``holes_of`` for regions of ``n`` pages as arrays: the median height of ink of each page, the ground regions that
    stand in ink, their places among the regions, and holes and cells of every region."""
    h = r["y1"] - r["y0"] + 1
    ink = np.flatnonzero(r["ink"])
    order = ink[np.lexsort((h[ink], r["page"][ink]))]
    count = np.bincount(r["page"][ink], minlength=n)
    med = np.zeros(n, np.int64)
    own = np.flatnonzero(count)
    med[own] = h[order[(np.cumsum(count) - count + count // 2)[own]]]
    hole = np.flatnonzero(~r["ink"] & (r["parent"] >= 0))
    by = np.lexsort((r["id"][ink], r["page"][ink]))
    wide = int(r["id"].max(initial=0)) + 1
    at = ink[by[np.searchsorted((r["page"] * wide + r["id"])[ink[by]], (r["page"] * wide + r["parent"])[hole])]]
    big = (r["x1"] - r["x0"] + 1 >= med[r["page"]]) & (h >= med[r["page"]])
    return med, hole, at, np.bincount(at, minlength=len(h)), np.bincount(at, big[hole], minlength=len(h)).astype(np.int64)


def objects_of(r: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``page_objects`` for regions of ``n`` whole pages as ``kernel.regions`` gives them: the places of objects among
    the regions, by page and rank, with type, holes and rank."""
    med, _, _, holes, cells = _holes(r, n)
    w, h = r["x1"] - r["x0"] + 1, r["y1"] - r["y0"] + 1
    fill = r["area"] / (w * h)
    large = np.maximum(w, h) >= SCALE * med[r["page"]]
    rule = r["ink"] & (fill > 0.8) & (np.maximum(w, h) >= 20 * np.maximum(1, np.minimum(w, h)))
    table = r["ink"] & ~rule & large & (cells >= 2)
    hollow = np.flatnonzero(r["ink"] & ~rule & ~table & large & (fill < HOLLOW) & (holes > 0))
    ink = np.flatnonzero(r["ink"])
    ink = ink[np.lexsort((r["y0"][ink], r["page"][ink]))]
    tall = int(r["y1"].max(initial=0)) + 2
    key = (r["page"] * tall + r["y0"])[ink]
    lo, hi = np.searchsorted(key, (r["page"] * tall + r["y0"])[hollow]), np.searchsorted(key, (r["page"] * tall + r["y1"])[hollow], "right")
    x0, x1, y1 = (r[k][ink] for k in ("x0", "x1", "y1"))
    diagram = np.zeros(len(w), bool)
    for a, z, i in zip(lo.tolist(), hi.tolist(), hollow.tolist(), strict=True):
        within = (x0[a:z] >= r["x0"][i]) & (x1[a:z] <= r["x1"][i]) & (y1[a:z] <= r["y1"][i])
        diagram[i] = within.sum() > 1  # itself is one of them
    at = np.flatnonzero(rule | table | diagram)
    at = at[np.lexsort((r["id"][at], -(w * h)[at], r["page"][at]))]
    rank = np.arange(len(at)) - np.searchsorted(r["page"][at], r["page"][at]) + 1
    return at, np.where(rule[at], "rule", np.where(table[at], "table", "diagram")), holes[at], rank


def _band(page: np.ndarray, value: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the band of each value on its page, and page and value of the first of each band, sorted."""
    order = np.lexsort((value, page))
    p, v = page[order], value[order]
    fresh = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)
    new = fresh | np.r_[True, v[1:] - v[:-1] > tol] if len(p) else fresh
    number = np.cumsum(new)
    band = np.empty(len(p), np.int64)
    band[order] = number - number[np.searchsorted(p, p)] if len(p) else number
    return band, p[new], v[new]


def cells_of(r: dict[str, np.ndarray], n: int, tol: float = 0.0) -> tuple[np.ndarray, ...]:
    """``table_cells`` for regions of ``n`` whole pages as ``kernel.regions`` gives them: the places of the cells among the
    regions, table, row, column and the spans of both."""
    _, hole, at, holes, _ = _holes(r, n)
    some = np.flatnonzero(holes)
    some = some[np.lexsort((r["id"][some], -holes[some], r["page"][some]))]
    best = np.full(n, -1)
    pages, first = np.unique(r["page"][some], return_index=True)
    best[pages] = some[first]
    own = hole[best[r["page"][hole]] == at]
    page, out = r["page"][own], []
    for lo, hi in (("y0", "y1"), ("x0", "x1")):
        a, z = r[lo][own], r[hi][own]
        band, p, v = _band(page, a, tol)
        low = int(v.min(initial=0))
        wide = int(max(v.max(initial=0), z.max(initial=0))) - low + 1
        key = p * wide + v - low
        span = np.searchsorted(key, page * wide + z - low) - np.searchsorted(key, page * wide + a - low)
        out.append((band, np.maximum(1, span)))
    return own, r["id"][best[page]], out[0][0], out[1][0], out[0][1], out[1][1]


def drop_thin_columns(cells: DataFrame, share: float = 0.02) -> DataFrame:
    """Cells (page_id, id, row, col, x0, x1) of columns whose median span is at least ``share`` of the table's width and
    isn't within that of a wider one; columns are numbered anew."""
    span = cells.groupBy("page_id", "col").agg(F.percentile("x0", F.lit(0.5)).alias("x0"), F.percentile("x1", F.lit(0.5)).alias("x1"))
    whole = cells.groupBy("page_id").agg((F.max("x1") - F.min("x0")).alias("w"))
    s = span.join(whole, "page_id").filter(F.col("x1") - F.col("x0") >= share * F.col("w")).drop("w")
    wider = (F.col("b.x1") - F.col("b.x0") > F.col("a.x1") - F.col("a.x0")) & (F.col("a.x0") >= F.col("b.x0")) & (F.col("a.x1") <= F.col("b.x1"))
    kept = pairs(s, s, wider, "left_anti").withColumn("new", F.row_number().over(Window.partitionBy("page_id").orderBy("x0", "col")) - 1)
    return cells.join(kept.select("page_id", "col", "new"), ["page_id", "col"]).drop("col").withColumnRenamed("new", "col")


def compare(left: DataFrame, right: DataFrame, features: list[str], halves: DataFrame | None = None) -> DataFrame:
    """(page_id, row, distance, comp_delta, scale_stable): two readings of each row by the sum of absolute differences of
    ``features``, the first of which counts components; whether the same rows at half scale differ as much."""
    key = ["page_id", "row"]
    l, r = left.select(*key, *[F.col(f).alias(f"l_{f}") for f in features]), right.select(*key, *[F.col(f).alias(f"r_{f}") for f in features])
    d = sum((F.abs(F.coalesce(f"l_{f}", F.lit(0)) - F.coalesce(f"r_{f}", F.lit(0))) for f in features), F.lit(0))
    j = l.join(r, key, "full").select(*key, d.alias("distance"), F.abs(F.coalesce(f"l_{features[0]}", F.lit(0)) - F.coalesce(f"r_{features[0]}", F.lit(0))).alias("comp_delta"))
    if halves is None:
        return j.withColumn("scale_stable", F.lit(None).cast("boolean"))
    return j.join(halves.select(*key, F.col("distance").alias("_half")), key, "left").withColumn("scale_stable", F.col("_half") == F.col("distance")).drop("_half")


def three_way(readings: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """(page_id, row, a distance for each two readings, missing): three readings of each row by the sums of absolute
    differences of ``features``, null where one of the two has no such row, and the names of those that haven't."""
    key, names = ["page_id", "row"], list(readings)
    out = None
    for n, d in readings.items():
        own = d.select(*key, F.struct(*[F.col(f).alias(f) for f in features]).alias(n))
        out = own if out is None else out.join(own, key, "full")
    far = lambda a, b: sum((F.abs(F.col(a)[f] - F.col(b)[f]) for f in features), F.lit(0))
    pairs_ = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return out.select(*key, *[far(a, b).alias(f"{a}_{b}") for a, b in pairs_], missing.alias("missing"))
