"""Page images: scanning PNG and PGM files, thresholds, polarity, and writing them."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantopo.operators.kernel import Runs, edges, from_mask, label

PNG = b"\x89PNG\r\n\x1a\n"


def read_png(raw: bytes) -> tuple[np.ndarray, float | None, bool]:
    """(gray, dpi, neutral) of an 8-bit RGB PNG without interlace; anything else raises.

    Gray is (299 R + 587 G + 114 B + 500) // 1000; neutral says that all three channels are equal everywhere.
    """
    if raw[:8] != PNG:
        raise ValueError("not a PNG")
    at, size, dpi, data, ended = 8, None, None, [], False
    while at < len(raw) and not ended:
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body, crc = raw[at + 8 : at + 8 + n], raw[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            w, h, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 2, 0, 0, 0]:
                raise ValueError(f"unsupported PNG {form}")
            size = (h, w)
        elif kind == b"pHYs" and body[8] == 1:
            dpi = struct.unpack(">I", body[:4])[0] * 0.0254
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("PNG without header or end")
    h, w = size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + 3 * w)
    rgb = np.zeros((h, w, 3), np.uint8)
    above = np.zeros((w, 3), np.int32)
    for y in range(h):
        above = _unfilter(int(lines[y, 0]), lines[y, 1:].reshape(w, 3).astype(np.int32), above)
        rgb[y] = above
    wide = rgb.astype(np.int32)
    gray = ((299 * wide[..., 0] + 587 * wide[..., 1] + 114 * wide[..., 2] + 500) // 1000).astype(np.uint8)
    return gray, dpi, bool((rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 1] == rgb[..., 2]).all())


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0) & 255
    if kind == 2:
        return (line + above) & 255
    if kind not in (3, 4):
        raise ValueError(f"unknown filter {kind}")
    # each byte needs the one before it: plain integers are the fastest here
    raw, up, out = line.ravel().tolist(), above.ravel().tolist(), [0, 0, 0]
    if kind == 3:
        for x, b in zip(raw, up, strict=True):
            out.append((x + (out[-3] + b) // 2) & 255)
    else:
        for x, b, c in zip(raw, up, [0, 0, 0, *up], strict=False):
            a = out[-3]
            p, q = b - c, a - c
            r = abs(p + q)
            p, q = abs(p), abs(q)
            out.append((x + (a if p <= q and p <= r else b if q <= r else c)) & 255)
    return np.array(out[3:], np.int32).reshape(line.shape)


def _filter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What ``_unfilter`` turns into ``line``; all bytes are known, so none has to wait for another."""
    left, corner = np.zeros_like(line), np.zeros_like(line)
    left[1:], corner[1:] = line[:-1], above[:-1]
    p, q, r = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
    guess = (0, left, above, (left + above) // 2, np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner)))[kind]
    return (line - guess) & 255


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def read_pnm(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(gray, end) of the P5 or P2 image at ``at``; the largest value must be 255."""
    kind = raw[at : at + 2]
    if kind not in (b"P5", b"P2"):
        raise ValueError(f"not a PGM: {kind!r}")
    end, head = at + 2, []
    for _ in range(3):
        if not (m := _FIELD.match(raw, end)):
            raise ValueError("PGM header is cut short")
        head.append(int(m[1]))
        end = m.end()
    w, h, most = head
    if most != 255:
        raise ValueError(f"largest value {most}, not 255")
    if kind == b"P5":
        end += 1  # one byte of space, exactly
        if len(raw) < end + w * h:
            raise ValueError("PGM is cut short")
        return np.frombuffer(raw, np.uint8, w * h, end).reshape(h, w), end + w * h
    values = []
    for _ in range(w * h):
        if not (m := _FIELD.match(raw, end)):
            raise ValueError("PGM is cut short")
        values.append(int(m[1]))
        end = m.end()
    return np.array(values, np.uint8).reshape(h, w), end


def read_pnm_stream(raw: bytes) -> Iterator[np.ndarray]:
    """The images of a file one after the other; anything but space between or after them raises."""
    at = 0
    while at < len(raw):
        gray, at = read_pnm(raw, at)
        yield gray
        while raw[at : at + 1].isspace():
            at += 1


def write_pgm(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.astype(np.uint8).tobytes()


def write_png(rgb: np.ndarray, dpi: float | None = None, filters: tuple[int, ...] = (0,)) -> bytes:
    """An 8-bit RGB PNG, its lines filtered by ``filters`` in turn."""
    h, w, _ = rgb.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    wide = np.concatenate([np.zeros((1, w, 3), np.int32), rgb.astype(np.int32)])
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    for y in range(h):
        lines[y, 0] = kind = filters[y % len(filters)]
        lines[y, 1:] = _filter(kind, wide[y + 1], wide[y]).ravel()
    phys = chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) if dpi else b""
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + phys + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def ink(gray: np.ndarray, threshold: int = 128, dark: bool | str = True) -> np.ndarray:
    """Ink is darker than the threshold, or, if light, as light at least. "auto" takes light only if dark ink covers more
    than half of the page and the light reading has strictly more components."""
    if not 0 <= threshold <= 256:
        raise ValueError(f"threshold {threshold} outside 0..256")
    mask = gray < threshold
    if dark == "auto":
        return ~mask if 2 * mask.sum() > mask.size and parts(~mask) > parts(mask) else mask
    return mask if dark else ~mask


def runs_of(mask: np.ndarray) -> Runs:
    h, w = mask.shape
    y, x = np.divmod(np.arange(h * w), max(1, w))
    return from_mask(mask.ravel(), np.zeros(h * w, np.int64), y, x)


def parts(mask: np.ndarray) -> int:
    r = runs_of(mask)
    return len(np.unique(label(len(r), *edges(r))))


SCHEMA = "path string, page_no int, width int, height int, dpi double, neutral boolean, error string, gray binary"


def scan(spark: SparkSession, path: str, dpi: float | None = None, pattern: str = "*") -> DataFrame:
    """One row for each image of the PNG and PGM files under ``path``; a PGM must be told its ``dpi``.

    A file that can't be read gives a row with an error and no image, so that one doesn't end a corpus's job; callers
    who want it to filter on ``error`` and raise.
    """
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content"), dpi)


def decode(files: DataFrame, dpi: float | None = None) -> DataFrame:
    """``scan`` of files that are rows already: (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, rows = raw.as_py(), []
                try:
                    if raw[:8] == PNG:
                        gray, own, neutral = read_png(raw)
                        rows = [(name, 0, gray.shape[1], gray.shape[0], own, neutral, None, gray.tobytes())]
                    elif dpi is None:
                        raise ValueError("a PGM has no dpi of its own")
                    else:
                        rows = [(name, i, g.shape[1], g.shape[0], float(dpi), True, None, g.tobytes()) for i, g in enumerate(read_pnm_stream(raw))]
                except Exception as e:  # noqa: BLE001
                    rows = [(name, None, None, None, None, None, str(e), None)]
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], _ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMA.split(", ")])


def runs(pages: DataFrame, threshold: int = 128, dark: bool | str = True) -> DataFrame:
    """(page_id, line, lo, hi) of the images of ``scan``; page_id is path#page_no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, w, h, gray in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = runs_of(ink(np.frombuffer(gray, np.uint8).reshape(h, w), threshold, dark))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(r), pa.string()), *[pa.array(x.astype(np.int32)) for x in (r.line, r.lo, r.hi)]], names=["page_id", "line", "lo", "hi"])

    p = pages.filter("error is null").select(F.concat_ws("#", "path", "page_no"), "width", "height", "gray")
    return p.mapInArrow(run, "page_id string, line int, lo int, hi int")


def new_or_changed(files: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Files (path, modificationTime, length) that the cache ``known`` (these and threshold) doesn't hold as they are."""
    return files.join(known.filter(F.col("threshold") == threshold).select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")
