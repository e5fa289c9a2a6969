"""Joins of boxes by place: containment, intersection, sight, distance, overlap.

Boxes have page_id, id, x0, y0, x1, y1, with whole, closed ends. Every join is an equi-join on the page with the place as
residual condition; ``tile_join`` also cuts crowded pages into tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantopo.functions.batches import whole_groups
from scantopo.functions.intervals import gap, inside, iou, meets
from scantopo.operators import kernel

BOX = ["x0", "y0", "x1", "y1"]


def pairs(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Rows of ``a`` (as ``a``) with those of ``b`` (as ``b``) on the same page where ``on`` holds."""
    return a.alias("a").join(b.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & on, how)


def tile_join(a: DataFrame, b: DataFrame, tile: int, on: Column) -> DataFrame:
    """``pairs`` for conditions that imply that the boxes meet: both sides go to the tiles they touch, and a pair is kept
    in the tile that holds the upper left corner of its intersection, so that it comes once."""

    def deal(d: DataFrame) -> DataFrame:
        at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
        return d.withColumn("tx", at("x0", "x1")).withColumn("ty", at("y0", "y1"))

    x, y = F.floor(F.greatest("a.x0", "b.x0") / tile), F.floor(F.greatest("a.y0", "b.y0") / tile)
    same = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")) & (F.col("a.tx") == x) & (F.col("a.ty") == y)
    return pairs(deal(a), deal(b), same & on)


def coverage(ink: DataFrame, regions: DataFrame, tile: int | None = None) -> DataFrame:
    """(page_id, side, id, class) for both sides: ink MISSED, OVERLAPPING, INSIDE or STRADDLE; regions HIT or EMPTY.

    More than one region around a box makes it OVERLAPPING, one INSIDE, whatever else it touches."""
    on = meets("a", "b")
    hits = pairs(ink, regions, on) if tile is None else tile_join(ink, regions, tile, on)
    hits = hits.select("a.page_id", F.col("a.id").alias("id"), F.col("b.id").alias("region"), inside("a", "b").alias("inside"))
    by = hits.groupBy("page_id", "id").agg(F.count_if("inside").alias("around"))
    kind = F.when(F.col("around").isNull(), "MISSED").when(F.col("around") > 1, "OVERLAPPING").when(F.col("around") == 1, "INSIDE").otherwise("STRADDLE")
    left = ink.join(by, ["page_id", "id"], "left").select("page_id", F.lit("ink").alias("side"), "id", kind.alias("class"))
    used = hits.select("page_id", F.col("region").alias("id")).distinct().withColumn("hit", F.lit(True))
    right = regions.join(used, ["page_id", "id"], "left").select("page_id", F.lit("region").alias("side"), "id", F.when(F.col("hit"), "HIT").otherwise("EMPTY").alias("class"))
    return left.unionByName(right)


def coverage_report(classes: DataFrame) -> DataFrame:
    """Counts and shares: of classes of ink in all ink, of EMPTY in all regions."""
    n = classes.groupBy("side", "class").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("side")), 9))


def centre_in(a: str, b: str) -> Column:
    """Whether the centre of box ``a`` lies in the closed box ``b``; halves are compared as wholes."""
    x, y = F.col(f"{a}.x0") + F.col(f"{a}.x1"), F.col(f"{a}.y0") + F.col(f"{a}.y1")
    return x.between(2 * F.col(f"{b}.x0"), 2 * F.col(f"{b}.x1")) & y.between(2 * F.col(f"{b}.y0"), 2 * F.col(f"{b}.y1"))


def match(components: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, side, id, kind): which components and glyphs belong together, by centres in glyph boxes."""
    hit = pairs(components, glyphs, centre_in("a", "b")).select("a.page_id", F.col("a.id").alias("c"), F.col("b.id").alias("g"))
    of_c, of_g = Window.partitionBy("page_id", "c"), Window.partitionBy("page_id", "g")
    hit = hit.withColumns({"glyphs": F.count(F.lit(1)).over(of_c), "parts": F.count(F.lit(1)).over(of_g)})
    c = hit.groupBy("page_id", F.col("c").alias("id")).agg(F.max("glyphs").alias("n"), F.max("parts").alias("m"))
    g = hit.groupBy("page_id", F.col("g").alias("id")).agg(F.max("parts").alias("n"), F.max("glyphs").alias("m"))
    kind_c = F.when(F.col("n").isNull(), "IMAGE_ONLY").when(F.col("n") > 1, "MERGED").when(F.col("m") > 1, "SPLIT").otherwise("ONE")
    kind_g = F.when(F.col("n").isNull(), "MISSING_INK").when(F.col("n") > 1, "SPLIT").when(F.col("m") > 1, "MERGED").otherwise("ONE")
    side = lambda d, k, name, v: d.select("page_id", "id").join(k, ["page_id", "id"], "left").select("page_id", F.lit(name).alias("side"), "id", v.alias("kind"))
    return side(components, c, "component", kind_c).unionByName(side(glyphs, g, "glyph", kind_g))


def label_transfer(components: DataFrame, glyphs: DataFrame, label: str) -> DataFrame:
    """(page_id, id, label) of components whose centre exactly one glyph box holds."""
    hit = pairs(components, glyphs, centre_in("a", "b")).groupBy("a.page_id", "a.id").agg(F.count(F.lit(1)).alias("n"), F.first(f"b.{label}").alias("label"))
    return hit.filter("n = 1").select("page_id", "id", "label")


def is_rule(area: Column, w: Column, h: Column, fill: float = 0.8, aspect: float = 20.0) -> Column:
    return (area / (w * h) > fill) & (F.greatest(w, h) >= aspect * F.greatest(F.lit(1), F.least(w, h)))


def size(t: str) -> Column:
    return (F.col(f"{t}.x1") - F.col(f"{t}.x0") + 1) * (F.col(f"{t}.y1") - F.col(f"{t}.y0") + 1)


def not_inside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boxes of ``a`` that no box of ``b`` contains."""
    return pairs(a, b, inside("a", "b"), "left_anti")


def innermost(a: DataFrame, b: DataFrame) -> DataFrame:
    """(page_id, id, region): for each box of ``a`` the smallest box of ``b`` around it, the first of equals."""
    return pairs(a, b, inside("a", "b")).groupBy("a.page_id", "a.id").agg(F.min_by("b.id", F.struct(size("b"), F.col("b.id"))).alias("region"))


def depth_of(a: DataFrame) -> DataFrame:
    """(page_id, id, depth): strictly larger boxes around each."""
    n = pairs(a, a, inside("a", "b") & (size("b") > size("a"))).groupBy("a.page_id", "a.id").agg(F.count(F.lit(1)).alias("depth"))
    return a.select("page_id", "id").join(n, ["page_id", "id"], "left").select("page_id", "id", F.coalesce("depth", F.lit(0)).alias("depth"))


def largest_hole(a: DataFrame, b: DataFrame, share: float = 0.5) -> DataFrame:
    """(page_id, id, hole): the largest box of ``b`` inside each of ``a`` with at least ``share`` of its size."""
    hit = pairs(a, b, inside("b", "a") & (F.col("a.id") != F.col("b.id")) & (size("b") >= share * size("a")))
    return hit.groupBy("a.page_id", "a.id").agg(F.min_by("b.id", F.struct(-size("b"), F.col("b.id"))).alias("hole"))


def crosses(ax: Column, ay: Column, bx: Column, by: Column, box: str, low: float = 0.02, high: float = 0.98) -> Column:
    """Whether the segment passes through the closed box between shares ``low`` and ``high`` of its way (clipping)."""
    dx, dy = bx - ax, by - ay
    enter, leave, off = [F.lit(low)], [F.lit(high)], []
    for d, p, lo, hi in ((dx, ax, "x0", "x1"), (dy, ay, "y0", "y1")):
        lo, hi = F.col(f"{box}.{lo}"), F.col(f"{box}.{hi}")
        t0, t1 = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        enter.append(F.when(d == 0, F.lit(low)).otherwise(F.least(t0, t1)))
        leave.append(F.when(d == 0, F.lit(high)).otherwise(F.greatest(t0, t1)))
        off.append((d == 0) & ((p < lo) | (p > hi)))
    return ~(off[0] | off[1]) & (F.greatest(*enter) <= F.least(*leave))


def with_centres(a: DataFrame) -> DataFrame:
    return a.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2.0, "cy": (F.col("y0") + F.col("y1")) / 2.0})


def sight(boxes: DataFrame, most: int | None = 400) -> DataFrame:
    """(page_id, a, b) of pairs with nothing between their centres. Pages of more than ``most`` boxes raise."""
    c = with_centres(boxes)
    if most:
        n = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
        c = c.withColumn("n", n).withColumn("page_id", F.when(F.col("n") <= most, F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("too many boxes on page "), F.col("page_id").cast("string"))).cast(boxes.schema["page_id"].dataType))).drop("n")
    ij = pairs(c, c, F.col("a.id") < F.col("b.id")).select("a.page_id", F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.cx").alias("ax"), F.col("a.cy").alias("ay"), F.col("b.cx").alias("bx"), F.col("b.cy").alias("by"))
    between = (F.col("k.id") != F.col("p.i")) & (F.col("k.id") != F.col("p.j")) & crosses(*(F.col(f"p.{x}") for x in ("ax", "ay", "bx", "by")), "k")
    return ij.alias("p").join(c.alias("k"), (F.col("p.page_id") == F.col("k.page_id")) & between, "left_anti").select("page_id", F.col("i").alias("a"), F.col("j").alias("b"))


def nearest_edges(boxes: DataFrame, k: int) -> DataFrame:
    """(page_id, a, b), a < b: pairs of which one is among the ``k`` nearest centres of the other, ids breaking ties."""
    x, y = F.col("a.x0") + F.col("a.x1") - F.col("b.x0") - F.col("b.x1"), F.col("a.y0") + F.col("a.y1") - F.col("b.y0") - F.col("b.y1")
    d = pairs(boxes, boxes, F.col("a.id") != F.col("b.id")).select("a.page_id", F.col("a.id").alias("i"), F.col("b.id").alias("j"), (x * x + y * y).alias("d"))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "i").orderBy("d", "j"))).filter(F.col("r") <= k)
    return near.select("page_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def stacked_pairs(boxes: DataFrame, centred: float = 0.15, reach: float = 1.5) -> DataFrame:
    """(page_id, a, b, kind) of boxes over one another: fraction, stacked_centred or stacked_offset.

    ``boxes`` also has rule. The upper ends above the lower; they share half the width of the narrower; the gap is at
    most ``reach`` median heights of the page's boxes that aren't rules; no box but a rule is between. A rule between
    makes a fraction.
    """
    h = F.col("y1") - F.col("y0") + 1
    med = boxes.filter("not rule").groupBy("page_id").agg(F.percentile(h, F.lit(0.5)).alias("med"))
    b = boxes.join(med, "page_id")
    width = lambda t: F.col(f"{t}.x1") - F.col(f"{t}.x0") + 1
    over = lambda s, t: F.least(F.col(f"{s}.x1"), F.col(f"{t}.x1")) - F.greatest(F.col(f"{s}.x0"), F.col(f"{t}.x0")) + 1
    dy = F.col("b.y0") - F.col("a.y1")
    near = (dy > 0) & (dy <= reach * F.col("a.med")) & (2 * over("a", "b") >= F.least(width("a"), width("b"))) & ~F.col("a.rule") & ~F.col("b.rule")
    off = F.abs(F.col("a.x0") + F.col("a.x1") - F.col("b.x0") - F.col("b.x1")) / 2.0
    p = pairs(b, b, near).select("a.page_id", F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.y1").alias("y0"), F.col("b.y0").alias("y1"), F.greatest("a.x0", "b.x0").alias("x0"), F.least("a.x1", "b.x1").alias("x1"), (off <= centred * F.greatest(width("a"), width("b"))).alias("mid"))
    third = (F.col("p.page_id") == F.col("k.page_id")) & ~F.col("k.id").isin(F.col("p.i"), F.col("p.j")) & (F.col("k.y0") > F.col("p.y0")) & (F.col("k.y1") < F.col("p.y1")) & (F.col("k.x0") <= F.col("p.x1")) & (F.col("k.x1") >= F.col("p.x0"))
    free = p.alias("p").join(b.filter("not rule").alias("k"), third, "left_anti")
    ruled = free.alias("p").join(b.filter("rule").alias("k"), third, "left_semi").select("page_id", "i", "j").withColumn("ruled", F.lit(True))
    kind = F.when(F.col("ruled"), "fraction").when(F.col("mid"), "stacked_centred").otherwise("stacked_offset")
    return free.join(ruled, ["page_id", "i", "j"], "left").select("page_id", F.col("i").alias("a"), F.col("j").alias("b"), kind.alias("kind"))


def group_by_links(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """``boxes`` with grp, the least id of those that ``links`` (page_id, a, b) connect, page by page."""
    kind, ids = (boxes.schema[k].dataType.simpleString() for k in ("page_id", "id"))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        page = pd.factorize(pdf["page_id"])[0]
        ends = np.stack([np.r_[page, page], np.r_[pdf["a"], pdf["b"]]], 1)
        names, at = np.unique(ends, axis=0, return_inverse=True)
        root = kernel.label(len(names), at[: len(pdf)], at[len(pdf) :])
        own = pdf["page_id"].to_numpy()[np.searchsorted(page, names[:, 0])]
        return pd.DataFrame({"page_id": own, "id": names[:, 1], "grp": names[root, 1]})

    found = whole_groups(links.select("page_id", "a", "b"), ["page_id"], [], f, f"page_id {kind}, id {ids}, grp {ids}")
    return boxes.join(found, ["page_id", "id"], "left").withColumn("grp", F.coalesce("grp", "id"))


def linkage(boxes: DataFrame, scale: float = 1.0) -> DataFrame:
    """Single linkage: boxes whose gap is at most ``scale`` median widths of the page, in groups."""
    med = boxes.groupBy("page_id").agg(F.percentile(F.col("x1") - F.col("x0") + 1, F.lit(0.5)).alias("med"))
    b = boxes.join(med, "page_id")
    links = pairs(b, b, (F.col("a.id") < F.col("b.id")) & (gap("a", "b") <= scale * F.col("a.med"))).select("a.page_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return group_by_links(boxes, links)


def merge_round(boxes: DataFrame, tol: int) -> DataFrame:
    """One round of merging boxes within ``tol`` on both axes: (page_id, id, x0, y0, x1, y1, n)."""
    links = pairs(boxes, boxes, (F.col("a.id") < F.col("b.id")) & (gap("a", "b") <= tol)).select("a.page_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    g = group_by_links(boxes, links)
    return g.groupBy("page_id", F.col("grp").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def merge_boxes(boxes: DataFrame, tol: int, rounds: int = 32) -> DataFrame:
    """``merge_round`` until no box is left to merge; each round is cut from the plan of the last."""
    now = boxes.select("page_id", "id", *BOX).persist()
    n = now.count()
    for _ in range(rounds):
        after = merge_round(now, tol).drop("n").persist()
        m = after.count()
        now.unpersist()
        now = after
        if m == n:
            return now
        n = m
    raise ValueError(f"boxes still merge after {rounds} rounds")


def iou_match(truth: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, side, id, kind): truth matched, split, merged, fragmented or missed; blocks spurious or used."""
    p = pairs(truth, blocks, meets("a", "b")).select("a.page_id", F.col("a.id").alias("t"), F.col("b.id").alias("k"), iou("a", "b").alias("iou"))
    p = p.filter("iou > 0").withColumn("good", F.col("iou") >= least)
    of_k = Window.partitionBy("page_id", "k")
    p = p.withColumn("shared", F.count_if("good").over(of_k))
    t = p.groupBy("page_id", F.col("t").alias("id")).agg(F.count_if("good").alias("g"), F.max(F.when(F.col("good"), F.col("shared"))).alias("s"))
    kind = F.when(F.col("g").isNull(), "missed").when(F.col("g") == 0, "fragmented").when(F.col("g") > 1, "split").when(F.col("s") > 1, "merged").otherwise("matched")
    left = truth.select("page_id", "id").join(t, ["page_id", "id"], "left").select("page_id", F.lit("truth").alias("side"), "id", kind.alias("kind"))
    used = p.select("page_id", F.col("k").alias("id")).distinct().withColumn("u", F.lit(True))
    right = blocks.select("page_id", "id").join(used, ["page_id", "id"], "left").select("page_id", F.lit("block").alias("side"), "id", F.when(F.col("u"), "used").otherwise("spurious").alias("kind"))
    return left.unionByName(right)


def fit_in_regions(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, region, n, excess): the box around all boxes whose centre a region holds, by how much it is larger than
    the region; boxes with a side longer than the region's are left out, regions without boxes have no row."""
    w = lambda t, a, b: F.col(f"{t}.{b}") - F.col(f"{t}.{a}")
    small = (w("a", "x0", "x1") <= w("b", "x0", "x1")) & (w("a", "y0", "y1") <= w("b", "y0", "y1"))
    g = pairs(boxes, regions, centre_in("a", "b") & small).groupBy("a.page_id", F.col("b.id").alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.max("a.x1").alias("x1"), F.min("a.x0").alias("x0"), F.max("a.y1").alias("y1"), F.min("a.y0").alias("y0"), F.max(size("b")).alias("s")
    )
    return g.select("page_id", "region", "n", F.round((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) / F.col("s"), 9).alias("excess"))


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """(page_id, id) of boxes of ``a`` that meet none of ``b`` strictly, both taken as shares of the box around their
    page's side."""

    def share(d: DataFrame) -> DataFrame:
        w = Window.partitionBy("page_id")
        lo = {k: F.min(k).over(w) for k in ("x0", "y0")}
        span = {"x": F.greatest(F.lit(1), F.max("x1").over(w) - lo["x0"]), "y": F.greatest(F.lit(1), F.max("y1").over(w) - lo["y0"])}
        return d.select("page_id", "id", *[((F.col(k) - lo[k[0] + "0"]) / span[k[0]]).alias(k) for k in BOX])

    strict = (F.col("a.x0") < F.col("b.x1")) & (F.col("a.x1") > F.col("b.x0")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("a.y1") > F.col("b.y0"))
    return pairs(share(a), share(b), strict, "left_anti").select("page_id", "id")
