"""A text as a page: its code points in lines of ``width``, vowels being ink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantopo.operators.kernel import Runs, from_mask

WIDTH = 64
#: The code points that are ink.
INK = np.array([ord(ch) for ch in "aeiouyAEIOUY"], np.uint32)
BATCH = 1 << 21


def cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the text each is of, and its place there."""
    n = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    page = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    return points, page, at


def rasterise(texts: list[str | None], axis: str = "row", polarity: str = "ink", width: int = WIDTH) -> Runs:
    """Runs of ink, or of ground among the cells there are, along rows or columns; a null text has no cells."""
    points, page, at = cells(texts)
    ink = (points < 128) & np.isin(points & 127, INK)
    mask = ink if polarity == "ink" else ~ink
    line, x = at // width, at % width
    if axis == "row":
        return from_mask(mask, page, line, x)
    order = np.lexsort((line, x, page))
    return from_mask(mask[order], page[order], x[order], line[order])


def heights(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """Lines of each page."""
    return np.fromiter((-(-len(t or "") // width) for t in texts), np.int64, len(texts))


def groups(col: pa.Array, limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters."""
    lo = size = 0
    for i, n in enumerate(col.cast(pa.binary()).fill_null(b"")):
        size += len(n.as_py())
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(col):
        yield lo, len(col)


def pages(docs: DataFrame, kernel, fields: str, id_col: str = "doc_id") -> DataFrame:
    """page_id and what ``kernel`` makes of it, for texts in ``docs`` (id, text), in one pass without a shuffle.

    ``kernel`` takes a list of texts and returns the text index of each output row and its columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in groups(b.column(1)):
                which, columns = kernel(b.column(1).slice(lo, hi - lo).to_pylist())
                ids = b.column(0).slice(lo, hi - lo).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([ids, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=["page_id", *[f.split()[0] for f in fields.split(", ")]])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), "text").mapInArrow(run, f"page_id {kind}, {fields}")


def runs(docs: DataFrame, axis: str = "row", polarity: str = "ink", width: int = WIDTH) -> DataFrame:
    """(page_id, line, lo, hi) of the maximal runs of each text, both ends included."""

    def kernel(texts: list[str | None]):
        r = rasterise(texts, axis, polarity, width)
        return r.page, [x.astype(np.int32) for x in (r.line, r.lo, r.hi)]

    return pages(docs, kernel, "line int, lo int, hi int")
