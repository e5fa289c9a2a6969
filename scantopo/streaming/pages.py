"""Pages that arrive: topology of new texts, sessions with late data, and lines folded into open components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scantopo.sources import text_raster


def topology(stream: DataFrame) -> DataFrame:
    """Runs, edges, components and holes of each text of a stream (doc_id, text): stateless, so in any output mode."""
    from scantopo.operators import kernel

    def f(texts):
        r = text_raster.rasterise(texts)
        up, down = kernel.edges(r)
        comp = kernel.label(len(r), up, down)
        page, k = np.unique(r.page, return_inverse=True)
        runs, edges = np.bincount(k, minlength=len(page)), np.bincount(k[down], minlength=len(page))
        parts = np.bincount(k, comp == np.arange(len(r)), minlength=len(page)).astype(np.int64)
        return page, [runs, edges, parts, edges - runs + parts]

    return text_raster.pages(stream, f, "runs long, edges long, components long, holes long")


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): sessions that end after ``gap`` without events; events later than ``late`` are dropped."""
    s = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, "w.start", "w.end", "n")


def closures(stream: DataFrame) -> DataFrame:
    """(page_id, comp, runs, first_line, last_line) of components as they close, from runs (page_id, line, lo, hi) whose
    lines arrive in order on each page; a run of line -1 ends its page.

    The state of a page is the runs of its last line and its open components: bounded by the page's width.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, names, opened = state.get if state.exists else ([], [], [])
        row, opened = [tuple(r) for r in zip(*row, strict=True)] if row else [], {int(n): list(o) for n, o in zip(names, opened, strict=True)}
        out = []
        df = pd.concat(list(frames))
        end = bool((df["line"] < 0).any())
        for line, now in df[df["line"] >= 0].sort_values(["line", "lo"]).groupby("line"):
            fresh: list[tuple[int, int, int, int]] = []
            for lo, hi in zip(now["lo"], now["hi"], strict=True):
                comp = int(line) * (1 << 20) + int(lo)
                touch = {c for at, a, z, c in row if at == line - 1 and z >= lo - 1 and a <= hi + 1}
                comp, n, first = min(touch, default=comp), 1, int(line)
                for c in touch:
                    n, first = n + opened[c][0], min(first, opened.pop(c)[1])
                rename = lambda rows, t=touch, k=comp: [(at, a, z, k if x in t else x) for at, a, z, x in rows]
                row, fresh = rename(row), rename(fresh)
                opened[comp] = [n, first, int(line)]
                fresh.append((int(line), int(lo), int(hi), comp))
            out += [(*key, c, *o) for c, o in opened.items() if o[2] < line]
            opened = {c: o for c, o in opened.items() if o[2] == line}
            row = fresh
        if end:
            out += [(*key, c, *o) for c, o in opened.items()]
            state.remove()
        else:
            state.update(([list(x) for x in zip(*row, strict=True)] if row else [[], [], [], []], list(opened), list(opened.values())))
        yield pd.DataFrame(out, columns=["page_id", "comp", "runs", "first_line", "last_line"])

    return stream.groupBy("page_id").applyInPandasWithState(
        step, "page_id long, comp long, runs long, first_line long, last_line long", "row array<array<long>>, names array<long>, opened array<array<long>>", "append", GroupStateTimeout.NoTimeout
    )
