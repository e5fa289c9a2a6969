"""Rows, clusters and layout trees of glyphs: the operators whose steps depend on their order."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scantopo.functions.batches import whole_groups
from scantopo.operators.layout import mode_of
from scantopo.operators.spatial import group_by_links, pairs

#: Relations from a symbol to what belongs to it, and the names of the nodes they make.
SUB, SUPER, OVER, UNDER, NEXT = "SUB", "SUPER", "OVER", "UNDER", "NEXT"


def greedy_rows(glyphs: DataFrame, overlap: float = 0.4) -> DataFrame:
    """(page_id, id, row): glyphs (page_id, id, x0, y0, x1, y1) put in rows one by one, those of heights nearest the modal
    first; a glyph joins the first row that covers more than ``overlap`` of its height, and the row grows.

    Each step depends on those before it, so a page is folded in Python; equal modes take the smaller height.
    """
    kind, ids = (glyphs.schema[k].dataType.simpleString() for k in ("page_id", "id"))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for page, g in pdf.groupby("page_id", sort=False):
            h = (g["y1"] - g["y0"] + 1).to_numpy()
            values, n = np.unique(h, return_counts=True)
            modal = values[np.argmax(n)]
            order = np.lexsort((g["id"], g["x0"], abs(h - modal)))
            rows: list[list[float]] = []
            for i in order:
                top, foot = g["y0"].iat[i], g["y1"].iat[i]
                for k, r in enumerate(rows):
                    if min(foot, r[1]) - max(top, r[0]) + 1 > overlap * h[i]:
                        rows[k] = [min(top, r[0]), max(foot, r[1])]
                        out.append((page, g["id"].iat[i], k))
                        break
                else:
                    rows.append([top, foot])
                    out.append((page, g["id"].iat[i], len(rows) - 1))
        return pd.DataFrame(out, columns=["page_id", "id", "row"])

    return whole_groups(glyphs.select("page_id", "id", "x0", "y0", "x1", "y1"), ["page_id"], ["id"], some, f"page_id {kind}, id {ids}, row int")


def parts_of_glyphs(glyphs: DataFrame, share: float = 0.5, max_gap: float = 2.5, stack: float = 0.5) -> DataFrame:
    """``glyphs`` (page_id, row, id, box) with grp: parts over one another in a row, such as a dot and its stem.

    Parts share ``share`` of the narrower's width, overlap in height by half a pixel at most, and are at most ``max_gap``
    heights of the taller apart."""
    w = lambda t: F.col(f"{t}.x1") - F.col(f"{t}.x0") + 1
    h = lambda t: F.col(f"{t}.y1") - F.col(f"{t}.y0")
    side = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0") + 1
    tall = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    near = (side >= share * F.least(w("a"), w("b"))) & (tall <= stack * F.least(h("a"), h("b"), F.lit(1.0))) & (-tall <= max_gap * F.greatest(h("a"), h("b"), F.lit(1)))
    links = pairs(glyphs, glyphs, (F.col("a.row") == F.col("b.row")) & (F.col("a.id") < F.col("b.id")) & near).select("a.page_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return group_by_links(glyphs, links)


def rewrite(symbols: dict[int, tuple], relations: dict[tuple[int, int], str], order=None) -> list[tuple]:
    """A forest of nested tuples from symbols (name or None, box) and relations between them.

    Productions: a symbol with just one neighbour over and one under is a fraction; with one sub and one super a base
    with both; with one of them a script; neighbours in line are a row. Each round applies matches that share no symbol,
    in order of place (or as ``order`` sorts them), until none is left. Symbols without a name become placeholders.
    """
    node = {i: ("symbol", s[0]) if s[0] is not None else ("placeholder",) for i, s in symbols.items()}
    box = {i: s[1] for i, s in symbols.items()}
    rel = dict(relations)

    def of(i: int, kind: str) -> list[int]:
        return [b for (a, b), k in rel.items() if a == i and k == kind]

    def leaf(i: int) -> bool:
        return not any(a == i and k != NEXT for (a, _), k in rel.items())

    def matches() -> list[tuple[str, int, list[int]]]:
        out = []
        for i in node:
            got = {k: of(i, k) for k in (OVER, UNDER, SUB, SUPER)}
            for name, need in (("fraction", (OVER, UNDER)), ("scripts", (SUB, SUPER)), ("sub", (SUB,)), ("super", (SUPER,))):
                if all(len(got[k]) == 1 and leaf(got[k][0]) for k in need) and not any(got[k] for k in got if k not in need):
                    out.append((name, i, [got[k][0] for k in need]))
                    break
            else:
                nxt = of(i, NEXT)
                if len(nxt) == 1 and leaf(i) and leaf(nxt[0]) and not any(b == i and k == NEXT for (_, b), k in rel.items()):
                    out.append(("row", i, nxt))
        return sorted(out, key=order or (lambda m: (box[m[1]], str(node[m[1]]))))

    while found := matches():
        used: set[int] = set()
        for name, i, parts in found:
            if used & {i, *parts}:
                continue
            used |= {i, *parts}
            if name == "row":
                left = node[i][1:] if node[i][0] == "row" else (node[i],)
                right = node[parts[0]][1:] if node[parts[0]][0] == "row" else (node[parts[0]],)
                node[i] = ("row", *left, *right)
            else:
                node[i] = (name, node[i], *[node[p] for p in parts])
            all_ = [box[i], *[box[p] for p in parts]]
            box[i] = (min(b[0] for b in all_), min(b[1] for b in all_), max(b[2] for b in all_), max(b[3] for b in all_))
            for p in parts:
                del node[p], box[p]
            gone = set(parts)
            rel = {(i if a in gone else a, b): k for (a, b), k in rel.items() if b not in gone and not (a in gone and b == i)}
    return [node[i] for i in sorted(node, key=lambda i: (box[i], str(node[i])))]


def rewrite_all(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(expr_id, tree): the forest of each expression as text, from symbols (expr_id, id, name, x0, y0, x1, y1) and
    relations (expr_id, i, j, rel); an expression is folded in one go."""
    kind = symbols.schema["expr_id"].dataType.simpleString()

    def one(key: tuple, s: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        own = {int(i): (n if isinstance(n, str) else None, (a, b, c, d)) for i, n, a, b, c, d in zip(*(s[k] for k in ("id", "name", "x0", "y0", "x1", "y1")), strict=True)}
        rel = {(int(i), int(j)): k for i, j, k in zip(r["i"], r["j"], r["rel"], strict=True)}
        return pd.DataFrame([(key[0], repr(rewrite(own, rel)))], columns=["expr_id", "tree"])

    return symbols.groupBy("expr_id").cogroup(relations.groupBy("expr_id")).applyInPandas(one, f"expr_id {kind}, tree string")


def confluent(symbols: dict[int, tuple], relations: dict[tuple[int, int], str], trials: int = 24, seed: int = 0) -> bool:
    """Whether ``rewrite`` makes the same forest in whatever order its matches are taken: ``trials`` random orders."""
    r = np.random.default_rng(seed)
    want = rewrite(symbols, relations)
    for _ in range(trials):
        turn = {i: float(x) for i, x in zip(symbols, r.random(len(symbols)), strict=True)}
        if rewrite(symbols, relations, order=lambda m, turn=turn: turn[m[1]]) != want:
            return False
    return True


def dotted_leader(sizes: list[float], places: list[float], feet: list[float], least: int = 20) -> bool:
    """Whether blobs are a dotted line: ``least`` of about one size and height, most gaps alike."""
    if len(sizes) < least:
        return False
    med = float(np.median(sizes))
    row = float(np.median(feet))
    x = sorted(p for s, p, f in zip(sizes, places, feet, strict=True) if abs(s - med) <= 0.5 * med and abs(f - row) <= med)
    if len(x) < least:
        return False
    gaps = [b - a for a, b in pairwise(x)]
    mid = float(np.median(gaps))
    return sum(abs(g - mid) <= 0.5 * mid for g in gaps) >= 0.8 * len(gaps)


def rule_context(runs: DataFrame, rules: DataFrame, reach: float = 1.0) -> DataFrame:
    """(page_id, id, above, below): share of ink in bands over and under each level rule (page_id, id, box) of ``reach``
    times its length; upright rules have 0."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    tall = F.greatest(F.lit(1), F.bround(reach * w).cast("long"))
    band = lambda k, a, z: F.struct(F.lit(k).alias("side"), F.greatest(F.lit(0), a).cast("long").alias("a"), z.cast("long").alias("z"))
    b = rules.filter(w >= h).select("page_id", "id", "x0", "x1", F.inline(F.array(band("above", F.col("y0") - tall, F.col("y0") - 1), band("below", F.col("y1") + 1, F.col("y1") + tall)))).filter("a <= z")
    line = b.select("*", F.explode(F.sequence("a", "z")).alias("line"))
    n = line.join(runs, ["page_id", "line"], "left").withColumn("n", F.when(F.col("lo").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least("hi", "x1") - F.greatest("lo", "x0") + 1)))
    s = n.groupBy("page_id", "id", "side").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.max((F.col("x1") - F.col("x0") + 1) * (F.col("z") - F.col("a") + 1))).alias("v"))
    p = s.groupBy("page_id", "id").pivot("side", ["above", "below"]).agg(F.max("v"))
    return rules.select("page_id", "id").join(p, ["page_id", "id"], "left").fillna(0.0, ["above", "below"])


def row_modes(glyphs: DataFrame, least: int = 6, height: int = 45) -> DataFrame:
    """(page_id, row, ratio): modal height over modal width of rows with enough glyphs that are tall enough."""
    h, w = (F.col("y1") - F.col("y0") + 1).cast("double"), (F.col("x1") - F.col("x0") + 1).cast("double")
    r = glyphs.groupBy("page_id", "row").agg(F.count(F.lit(1)).alias("n"), F.percentile(h, F.lit(0.5)).alias("med"), mode_of(h).alias("mh"), mode_of(w).alias("mw"))
    return r.filter((F.col("n") >= least) & (F.col("med") >= height)).select("page_id", "row", (F.col("mh") / F.col("mw")).alias("ratio"))


def leading_block(pages: DataFrame, doc: str, good: str, gap: int = 3) -> DataFrame:
    """(doc, first, last, n): the first stretch of pages with ``good``, broken where more than ``gap`` pages lack it;
    documents without any have nulls."""
    w = Window.partitionBy(doc).orderBy("page")
    g = pages.filter(good).withColumn("new", F.when(F.col("page") - F.lag("page").over(w) > gap, 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    b = g.filter("part = 0").groupBy(doc).agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n"))
    return pages.select(doc).distinct().join(b, doc, "left")
