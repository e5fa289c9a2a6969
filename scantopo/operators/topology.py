"""Runs, adjacency, components, events, signatures and containment of pages.

A page is a key of every table. Operators on tables of runs are DataFrame plans whose joins and groups are on the page
and line; those that follow a page's whole graph (components, cycles) run the kernel on whole pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantopo.functions.batches import whole_groups
from scantopo.functions.intervals import overlaps, squares_range, sum_range
from scantopo.operators import kernel

RUN = ["line", "lo", "hi"]


def runs_from_lines(lines: DataFrame, ink: str = "#") -> DataFrame:
    """(page_id, line, lo, hi) from rows of text (page_id, line, chars): a fold over the pieces of each line."""
    one = F.regexp_extract_all("chars", F.lit(f"([{ink}]+|[^{ink}]+)"), F.lit(1))
    step = F.aggregate(
        one,
        F.struct(F.lit(0).alias("x"), F.array().cast("array<struct<lo:int,hi:int,on:boolean>>").alias("r")),
        lambda a, p: F.struct((a["x"] + F.length(p)).alias("x"), F.concat(a["r"], F.array(F.struct(a["x"].alias("lo"), (a["x"] + F.length(p) - 1).alias("hi"), p.rlike(f"^[{ink}]").alias("on")))).alias("r")),
    )
    return lines.select("page_id", "line", F.explode(step["r"]).alias("r")).filter("r.on").select("page_id", "line", "r.lo", "r.hi")


def pictures(rows: DataFrame) -> DataFrame:
    """(page_id, line, chars) of pictures (page_id, picture), one line of text to a line."""
    return rows.select("page_id", F.posexplode(F.split("picture", "\n")).alias("line", "chars"))


def draw(runs: DataFrame, ink: str = "#", ground: str = ".") -> DataFrame:
    """(page_id, picture): the inverse of ``pictures`` and ``runs_from_lines``, to the last column of ink."""
    w = runs.groupBy("page_id").agg((F.max("hi") + 1).alias("w"), (F.max("line") + 1).alias("h"))
    line = runs.groupBy("page_id", "line").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    every = w.select("page_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("line")).join(line, ["page_id", "line"], "left")
    put = F.aggregate(F.coalesce("r", F.array().cast("array<struct<lo:int,hi:int>>")), F.lit(""), lambda a, r: F.concat(a, F.repeat(F.lit(ground), r["lo"] - F.length(a)), F.repeat(F.lit(ink), r["hi"] - r["lo"] + 1)))
    return every.withColumn("chars", F.rpad(put, F.col("w"), F.lit(ground))).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "chars"))), lambda s: s["chars"]), "\n").alias("picture"))


def complement(runs: DataFrame, sizes: DataFrame, pad: int = 0) -> DataFrame:
    """Background runs of pages of ``sizes`` (page_id, width, height), with a border of ``pad`` cells all around."""
    low, high = F.lit(-pad), F.col("width") - 1 + pad
    edge = sizes.select("page_id", F.explode(F.sequence(low, F.col("height") - 1 + pad)).alias("line"), high.alias("last"))
    w = Window.partitionBy("page_id", "line").orderBy("lo")
    all_ = edge.join(runs.select("page_id", *RUN), ["page_id", "line"], "left")
    before = F.coalesce(F.lag("hi").over(w) + 1, low)
    gaps = all_.withColumns({"a": before, "z": F.coalesce(F.col("lo") - 1, F.col("last")), "tail": F.when(F.lead("lo").over(w).isNull() & F.col("hi").isNotNull(), F.col("hi") + 1)})
    both = F.array(F.struct(F.col("a").alias("lo"), F.col("z").alias("hi")), F.struct(F.col("tail").alias("lo"), F.col("last").alias("hi")))
    return gaps.select("page_id", "line", F.explode(both).alias("g")).filter("g.lo <= g.hi").select("page_id", "line", "g.lo", "g.hi")


def clip(runs: DataFrame, x0: Column | int, y0: Column | int, x1: Column | int, y1: Column | int) -> DataFrame:
    """Runs within the half-open rectangle, moved to its corner."""
    lo, hi = F.greatest("lo", F.lit(x0)), F.least("hi", F.lit(x1) - 1)
    cut = runs.filter((F.col("line") >= y0) & (F.col("line") < y1)).withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
    return cut.withColumns({"lo": F.col("lo") - x0, "hi": F.col("hi") - x0, "line": F.col("line") - y0})


def coalesce_runs(runs: DataFrame) -> DataFrame:
    """Runs that touch or overlap on a line, joined."""
    w = Window.partitionBy("page_id", "line").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    return runs.select("page_id", *RUN).withColumn("new", new).withColumn("g", F.sum("new").over(w)).groupBy("page_id", "line", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def within(runs: DataFrame, rects: DataFrame) -> DataFrame:
    """Ink inside the union of half-open ``rects`` (page_id, x0, y0, x1, y1)."""
    r = rects.select("page_id", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("line"), F.col("x0").alias("a"), (F.col("x1") - 1).alias("z")).filter("a <= z")
    hit = runs.join(r, ["page_id", "line"]).filter(overlaps("lo", "hi", "a", "z"))
    return coalesce_runs(hit.select("page_id", "line", F.greatest("lo", "a").alias("lo"), F.least("hi", "z").alias("hi")))


def without(runs: DataFrame, rects: DataFrame) -> DataFrame:
    """Ink outside the union of half-open ``rects``: for each run, the gaps between the parts that are covered."""
    cover = within(runs, rects).select(F.col("page_id").alias("p"), F.col("line").alias("l"), F.col("lo").alias("a"), F.col("hi").alias("z"))
    w = Window.partitionBy("page_id", "line", "lo", "hi").orderBy("a")
    j = runs.select("page_id", *RUN).join(cover, F.expr("page_id = p and line = l and a >= lo and z <= hi"), "left").drop("p", "l")
    j = j.withColumns({"from": F.coalesce(F.lag("z").over(w) + 1, F.col("lo")), "more": F.lead("a").over(w).isNotNull()})
    before = F.struct(F.col("from").alias("lo"), F.coalesce(F.col("a") - 1, F.col("hi")).alias("hi"))
    last = F.when(~F.col("more") & F.col("z").isNotNull(), F.struct((F.col("z") + 1).alias("lo"), F.col("hi")))
    return j.select("page_id", "line", F.explode(F.array(before, last)).alias("p")).filter("p.lo <= p.hi").select("page_id", "line", "p.lo", "p.hi")


def adjacency(runs: DataFrame, reach: int = 1) -> DataFrame:
    """(page_id, line, up_lo, lo): runs of consecutive lines that touch; an equi-join on page and line with the overlap
    as residual condition. ``reach`` 1 joins corners (8 neighbours), 0 doesn't (4)."""
    up = runs.select("page_id", (F.col("line") + 1).alias("line"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"))
    return runs.join(up, ["page_id", "line"]).filter(overlaps("up_lo", "up_hi", "lo", "hi", reach)).select("page_id", "line", "up_lo", "lo")


def degrees(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each run with ``up`` and ``down``, its neighbours on the line before and after."""
    up = edges.groupBy("page_id", "line", "lo").agg(F.count(F.lit(1)).alias("up"))
    down = edges.groupBy("page_id", (F.col("line") - 1).alias("line"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("down"))
    key = ["page_id", "line", "lo"]
    return runs.join(up, key, "left").join(down, key, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("up", "down")})


def signature(deg: DataFrame) -> DataFrame:
    """births, closes, merges and splits of the contracted graph of each page, from degrees alone."""
    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    return deg.groupBy("page_id").agg(n("up = 0").alias("births"), n("down = 0").alias("closes"), n("up >= 2").alias("merges"), n("down >= 2").alias("splits"))


def profile(runs: DataFrame, sizes: DataFrame, axis_length: str = "height") -> DataFrame:
    """Coverage, extent and number of runs of every line of each page, blank lines too."""
    got = runs.groupBy("page_id", "line").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("coverage"), (F.max("hi") - F.min("lo") + 1).alias("extent"), F.count(F.lit(1)).alias("run_count"))
    every = sizes.filter(F.col(axis_length) > 0).select("page_id", F.explode(F.sequence(F.lit(0), (F.col(axis_length) - 1).cast("int"))).alias("line"))
    zero = F.lit(0).cast("long")
    return every.join(got, ["page_id", "line"], "left").select("page_id", "line", *[F.coalesce(F.col(k).cast("long"), zero).alias(k) for k in ("coverage", "extent", "run_count")])


def stroke_mode(runs: DataFrame) -> DataFrame:
    """The commonest run length of each page and how often it occurs; the shorter of two as common."""
    by = runs.groupBy("page_id", (F.col("hi") - F.col("lo") + 1).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("page_id").agg(F.min_by(F.struct("len", "n"), F.struct(-F.col("n"), "len")).alias("m")).select("page_id", F.col("m.len").cast("long").alias("mode_len"), F.col("m.n").alias("mode_n"))


def moment_columns(by_row: bool = True) -> list[Column]:
    """Exact sums over pixels of runs: area, x, y, xx, yy, xy, and the closed extents."""
    n, line = (F.col("hi") - F.col("lo") + 1).cast("long"), F.col("line").cast("long")
    along, across, both = sum_range("lo", "hi"), line * n, line * sum_range("lo", "hi")
    sums = {"area": n, "sx": along, "sy": across, "sxx": squares_range("lo", "hi"), "syy": line * line * n, "sxy": both}
    if not by_row:
        sums |= {"sx": across, "sy": along, "sxx": line * line * n, "syy": squares_range("lo", "hi")}
    x, y = (("lo", "hi"), ("line", "line")) if by_row else (("line", "line"), ("lo", "hi"))
    ends = [F.min(x[0]).alias("x0"), F.min(y[0]).alias("y0"), F.max(x[1]).alias("x1"), F.max(y[1]).alias("y1")]
    return [*[F.sum(v).alias(k) for k, v in sums.items()], *ends]


def moments(runs: DataFrame, *by: str, axis: str = "row") -> DataFrame:
    return runs.groupBy(*by).agg(*moment_columns(axis == "row"))


def merge_moments(parts: DataFrame, *by: str) -> DataFrame:
    """Sums of disjoint parts: what partial and final aggregation do anyway, on stored partials."""
    return parts.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("area", "sx", "sy", "sxx", "syy", "sxy")], *[F.min(k).alias(k) for k in ("x0", "y0")], *[F.max(k).alias(k) for k in ("x1", "y1")])


def axis_columns() -> dict[str, Column]:
    """Centroid, axis lengths, elongation and unit axis from moment columns.

    Pixels are unit squares, so a variance is at least 1/12; the axis points right, or up where it is vertical, and is
    (1, 0) for figures alike in both directions.
    """
    n, d = F.col("area"), (lambda k: F.col(k).cast("double"))
    mx, my = d("sx") / n, d("sy") / n
    a, b, m = d("sxx") / n - mx * mx + 1 / 12, d("syy") / n - my * my + 1 / 12, d("sxy") / n - mx * my
    spread = F.sqrt((a - b) * (a - b) + 4 * m * m)
    big, small = F.greatest((a + b + spread) / 2, F.lit(1 / 12)), F.greatest((a + b - spread) / 2, F.lit(1 / 12))
    return {"cx": mx + 0.5, "cy": my + 0.5, "major": 2 * F.sqrt(big), "minor": 2 * F.sqrt(small), "elongation": F.sqrt(big / small), "slant": F.when((a - 1 / 12 <= 0) | (b - 1 / 12 <= 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m / F.sqrt((a - 1 / 12) * (b - 1 / 12)))))}


def texture(runs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Runs by area, mean run, spread of run lengths over their mean, and cycles (page_id, holes) by area."""
    n = (F.col("hi") - F.col("lo") + 1).cast("long")
    t = runs.groupBy("page_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(n).alias("area"), F.sum(n * n).alias("sq")).join(cycles, "page_id", "left")
    mean = F.col("area") / F.col("runs")
    return t.select("page_id", (F.col("runs") / F.col("area")).alias("runs_per_area"), mean.alias("mean_run"), (F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / F.col("runs") - mean * mean)) / mean).alias("cv_run"), (F.coalesce("holes", F.lit(0)) / F.col("area")).alias("cycles_per_area"))


def analyse(r: kernel.Runs, reach: int = 1) -> dict[str, np.ndarray]:
    """Degrees, component (index of its first run) and kept edges of the runs of a batch."""
    up, down = kernel.edges(r, reach)
    n = len(r)
    joins = kernel.forest_edges(r, up, down)
    return {"up": np.bincount(down, minlength=n), "down": np.bincount(up, minlength=n), "comp": kernel.label(n, up, down), "upper": up, "lower": down, "joins": joins, "roots": np.bincount(down[joins], minlength=n)}


def components(runs: DataFrame, reach: int = 1) -> DataFrame:
    """Each run with comp, the component of its page, and up and down: for runs from any source. comp is the rank of the
    component's first run on the page, cycles and roots the edges of a run that close a cycle or join components.

    Pages are the unit: one page's runs fit in a task's memory (a 600 dpi sheet has a few hundred thousand)."""
    kind = runs.schema["page_id"].dataType.simpleString()

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        page = pd.factorize(pdf["page_id"])[0]
        a = analyse(kernel.Runs(page, *(pdf[k].to_numpy(np.int64) for k in RUN)), reach)
        first = np.searchsorted(page, page)
        return pdf.assign(comp=a["comp"] - first, up=a["up"], down=a["down"], cycles=a["up"] - a["roots"], roots=a["roots"])

    return whole_groups(runs.select("page_id", *RUN), ["page_id"], ["line", "lo"], some, f"page_id {kind}, line int, lo int, hi int, comp long, up long, down long, cycles long, roots long")


def component_table(labelled: DataFrame) -> DataFrame:
    """Runs, edges and holes (edges - runs + 1) of each component."""
    return labelled.groupBy("page_id", "comp").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("up").alias("n_edges"), F.min("line").alias("first_line"), F.max("line").alias("last_line")).withColumn("holes", F.col("n_edges") - F.col("n_runs") + 1)


def page_table(labelled: DataFrame) -> DataFrame:
    """Runs, edges, components and holes of each page: holes are edges - runs + components."""
    t = labelled.groupBy("page_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("up").alias("edges"), F.count_distinct("comp").alias("components"))
    return t.withColumn("holes", F.col("edges") - F.col("runs") + F.col("components"))


def bands(labelled_runs: DataFrame, height: int) -> DataFrame:
    """Each run with the band of ``height`` lines it is in."""
    return labelled_runs.withColumn("band", F.floor(F.col("line") / height).cast("int"))


def band_components(runs: DataFrame, height: int, reach: int = 1) -> DataFrame:
    """(page_id, line, lo, hi, comp): components found band by band, then joined over the seams.

    A band is labelled on its own, so one page is shared by many tasks. Seams are the adjacency of the last line of a
    band and the first of the next; the graph of (band, component) they make is small, and is labelled by page.
    """
    b = bands(runs, height)
    key = F.concat_ws(":", "page_id", "band")
    own = components(b.withColumn("page_id", key).select("page_id", *RUN), reach)
    own = own.select(F.regexp_extract("page_id", "^(.*):", 1).alias("page"), F.regexp_extract("page_id", "([0-9-]+)$", 1).cast("long").alias("band"), *RUN, "comp")
    part = own.withColumn("node", F.col("band") * F.lit(1 << 40) + F.col("comp"))
    seam = part.filter((F.pmod("line", F.lit(height)) == 0) | (F.pmod("line", F.lit(height)) == height - 1))
    up = seam.select("page", (F.col("line") + 1).alias("line"), F.col("lo").alias("a"), F.col("hi").alias("z"), F.col("node").alias("up"))
    links = seam.join(up, ["page", "line"]).filter((F.pmod("line", F.lit(height)) == 0) & overlaps("a", "z", "lo", "hi", reach)).select("page", "up", "node").distinct()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        page = pd.factorize(pdf["page"])[0]
        ends = np.stack([np.r_[page, page], np.r_[pdf["up"], pdf["node"]]], 1)
        names, at = np.unique(ends, axis=0, return_inverse=True)
        root = kernel.label(len(names), at[: len(pdf)], at[len(pdf) :])
        own = pdf["page"].to_numpy()[np.searchsorted(page, names[:, 0])]
        return pd.DataFrame({"page": own, "node": names[:, 1], "whole": names[root, 1]})

    merged = whole_groups(links, ["page"], [], merge, "page string, node long, whole long")
    return part.join(merged, ["page", "node"], "left").select(F.col("page").alias("page_id"), *RUN, F.coalesce("whole", "node").alias("comp"))


def contain(ink: DataFrame, ground: DataFrame) -> DataFrame:
    """(page_id, kind, comp, parent_kind, parent): the region around each region.

    ``ink`` (labelled with corners) and ``ground`` (labelled without, on pages with a border) tile the plane, so the
    cell above a region's first run is in just one run of the other kind: a join on the line with the cell between.
    """
    tag = lambda d, k: d.select("page_id", F.lit(k).alias("kind"), *RUN, "comp")
    every = tag(ink, "ink").unionByName(tag(ground, "ground"))
    top = every.groupBy("page_id", "kind", "comp").agg(F.min(F.struct("line", "lo")).alias("t")).select("page_id", "kind", "comp", (F.col("t.line") - 1).alias("line"), F.col("t.lo").alias("x"))
    around = every.select("page_id", F.col("kind").alias("parent_kind"), "line", "lo", "hi", F.col("comp").alias("parent"))
    return top.join(around, ["page_id", "line"], "left").filter("lo is null or x between lo and hi").groupBy("page_id", "kind", "comp").agg(F.max("parent_kind").alias("parent_kind"), F.max("parent").alias("parent"))


def depths(parents: DataFrame) -> DataFrame:
    """``parents`` with depth: 0 for a region without parent, else one more than its parent's."""

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pd.MultiIndex.from_frame(pdf[["page_id", "kind", "comp"]])
        up = own.get_indexer(pd.MultiIndex.from_frame(pdf[["page_id", "parent_kind", "parent"]]))
        depth, at = np.zeros(len(pdf), np.int32), up.copy()
        while (at >= 0).any():
            depth += at >= 0
            at = np.where(at >= 0, up[at], -1)
        return pdf.assign(depth=depth)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parents.schema)
    return whole_groups(parents, ["page_id"], ["kind", "comp"], some, f"{fields}, depth int")


def events(labelled: DataFrame) -> DataFrame:
    """(page_id, line, kind, n): scan events of each line, from runs with comp, up, down, cycles and roots.

    A run without upper neighbours is a birth; one with two lower ones a split, on its own line; one that meets two
    components on arrival a merge; an edge within a component a cycle. A component closes on the next line with ink, or
    one line after the page's last.
    """
    lines = labelled.select("page_id", "line").distinct()
    after = F.coalesce(F.lead("line").over(Window.partitionBy("page_id").orderBy("line")), F.col("line") + 1)
    lines = lines.withColumn("next", after)
    close = labelled.groupBy("page_id", "comp").agg(F.max("line").alias("line")).join(lines, ["page_id", "line"]).groupBy("page_id", F.col("next").alias("line")).agg(F.count(F.lit(1)).alias("n")).select("page_id", "line", F.lit("close").alias("kind"), "n")
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    kinds = {"birth": n("up = 0"), "split": n("down >= 2"), "merge": n("roots >= 2"), "cycle": F.sum("cycles")}
    by = labelled.groupBy("page_id", "line").agg(*[v.alias(k) for k, v in kinds.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])
    return by.select("page_id", "line", F.inline(pairs)).filter("n > 0").unionByName(close)


def block_histogram(runs: DataFrame, block: int = 8) -> DataFrame:
    """Ink in each ``block`` by ``block`` cell: a run is cut where it crosses a border."""
    cut = runs.select("page_id", F.floor(F.col("line") / block).alias("by"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("bx"))
    n = F.least(F.col("hi"), (F.col("bx") + 1) * block - 1) - F.greatest(F.col("lo"), F.col("bx") * block) + 1
    return cut.groupBy("page_id", "by", "bx").agg(F.sum(n).cast("long").alias("ink"))


def cracks(runs: DataFrame) -> DataFrame:
    """(page_id, side, n): sides of cells between ink and ground. Left and right are run ends; up and down are the cells
    of a line less those they share with the line before or after."""
    n = (F.col("hi") - F.col("lo") + 1).cast("long")
    a = runs.groupBy("page_id").agg(F.count(F.lit(1)).alias("r"), F.sum(n).alias("s"))
    up = runs.select("page_id", (F.col("line") + 1).alias("line"), F.col("lo").alias("a"), F.col("hi").alias("z"))
    both = runs.join(up, ["page_id", "line"]).filter(overlaps("a", "z", "lo", "hi")).groupBy("page_id").agg(F.sum(F.least("hi", "z") - F.greatest("lo", "a") + 1).cast("long").alias("b"))
    j = a.join(both, "page_id", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    side = lambda k, v: F.struct(F.lit(k).alias("side"), v.alias("n"))
    return j.select("page_id", F.inline(F.array(side("left", F.col("r")), side("right", F.col("r")), side("up", F.col("s") - F.col("b")), side("down", F.col("s") - F.col("b")))))


def contours(runs: DataFrame) -> DataFrame:
    """(page_id, loop, area, length): boundary loops; areas are positive around ink and negative around holes."""
    kind = runs.schema["page_id"].dataType.simpleString()

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        page, names = pd.factorize(pdf["page_id"])
        p, loop, area, length = kernel.contours(kernel.Runs(page, *(pdf[k].to_numpy(np.int64) for k in RUN)))
        return pd.DataFrame({"page_id": names.take(p), "loop": loop, "area": area, "length": length})

    return whole_groups(runs.select("page_id", *RUN), ["page_id"], ["line", "lo"], some, f"page_id {kind}, loop long, area long, length long")


def bitmap(runs: DataFrame, grid: int = 12, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, w0, w1, w2): any ink in each cell of a ``grid`` over the box around it, as three words of grid / 3 rows.

    A cell spans j * h // grid to (j + 1) * h // grid, but one row or column at least."""
    box = runs.groupBy(*by).agg(F.min("lo").alias("x0"), F.min("line").alias("y0"), (F.max("hi") - F.min("lo") + 1).alias("w"), (F.max("line") - F.min("line") + 1).alias("h"))
    cells = F.sequence(F.lit(0), F.lit(grid - 1))
    at = lambda j, size: F.floor(j * F.col(size) / grid)
    end = lambda j, size: F.greatest(at(j, size) + 1, F.floor((j + 1) * F.col(size) / grid))
    r = runs.join(box, list(by)).withColumns({"y": F.col("line") - F.col("y0"), "a": F.col("lo") - F.col("x0"), "z": F.col("hi") - F.col("x0")})
    row = F.filter(cells, lambda j: (at(j, "h") <= F.col("y")) & (F.col("y") < end(j, "h")))
    bits = F.aggregate(cells, F.lit(0).cast("long"), lambda s, i: s + F.when((at(i, "w") <= F.col("z")) & (end(i, "w") > F.col("a")), F.pow(F.lit(2.0), i).cast("long")).otherwise(0))
    third = grid // 3
    g = r.select(*by, bits.alias("bits"), F.explode(row).alias("j")).groupBy(*by, "j").agg(F.bit_or("bits").alias("bits"))
    word = lambda k: F.sum(F.when(F.floor(F.col("j") / third) == k, F.col("bits") * F.pow(F.lit(2.0), F.pmod("j", F.lit(third)) * grid).cast("long")).otherwise(0)).alias(f"w{k}")
    return g.groupBy(*by).agg(word(0), word(1), word(2))
