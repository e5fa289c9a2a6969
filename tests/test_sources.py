"""Images, region files, font lists, sinks and streams."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest

from scantopo.operators import layout, spatial
from scantopo.sources import documents, images
from scantopo.streaming import pages


def filtered_png(rgb: np.ndarray, kinds: list[int]) -> bytes:
    """A PNG whose lines use the given filters."""
    h, w, _ = rgb.shape
    out, above = b"", np.zeros((w, 3), int)
    for y in range(h):
        k, line = kinds[y % len(kinds)], rgb[y].astype(int)
        left = np.vstack([np.zeros((1, 3), int), line[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][k]
        out += bytes([k]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png_filters():
    rgb = np.random.default_rng(1).integers(0, 256, (11, 7, 3), dtype=np.uint8)
    gray, dpi, neutral = images.read_png(filtered_png(rgb, [0, 1, 2, 3, 4]))
    want = (rgb.astype(int) @ [299, 587, 114] + 500) // 1000
    assert (gray == want).all() and dpi is None and not neutral
    gray, dpi, neutral = images.read_png(images.write_png(np.repeat(rgb[..., :1], 3, axis=2), dpi=300))
    assert neutral and dpi == pytest.approx(300, abs=0.05) and (gray == rgb[..., 0]).all()


@pytest.mark.parametrize("spoil", [lambda b: b[:-1], lambda b: b[:40] + b"x" + b[41:], lambda b: b"GIF" + b])
def test_damaged_png(spoil):
    with pytest.raises(ValueError):
        images.read_png(spoil(images.write_png(np.zeros((3, 3, 3), np.uint8))))


def test_pgm():
    g = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert (images.read_pnm(images.write_pgm(g))[0] == g).all()
    assert (images.read_pnm(b"P2 # c\n3 2\n255\n0 1 2 3 4 5")[0] == g).all()
    assert len(list(images.read_pnm_stream(images.write_pgm(g) * 3))) == 3
    for bad in (b"P5\n3 2\n254\n......", b"P5\n3 2\n255\n..", b"P6\n1 1\n255\n...", images.write_pgm(g) + b"!"):
        with pytest.raises(ValueError):
            list(images.read_pnm_stream(bad))


def test_polarity():
    m = np.full((9, 9), 0, np.uint8)
    m[2, 2] = m[5, 5] = 255
    assert images.ink(m, dark="auto").sum() == 2 and images.ink(255 - m, dark="auto").sum() == 2 and images.ink(m).sum() == 79


def test_scan(spark, tmp_path):
    g = np.full((5, 5), 255, np.uint8)
    g[0] = g[4] = 0
    g[:, 0] = g[:, 4] = 0
    (tmp_path / "a.png").write_bytes(images.write_png(np.repeat(g[..., None], 3, axis=2), 72))
    (tmp_path / "b.pgm").write_bytes(images.write_pgm(g) * 2)
    (tmp_path / "c.png").write_bytes(b"junk")
    s = images.scan(spark, str(tmp_path), dpi=100)
    assert sorted((r["path"][-5:], r["page_no"], r["error"] is None) for r in s.collect()) == [("a.png", 0, True), ("b.pgm", 0, True), ("b.pgm", 1, True), ("c.png", None, False)]
    from scantopo.operators import topology

    t = topology.page_table(topology.components(images.runs(s))).collect()
    assert [(r["runs"], r["edges"], r["components"], r["holes"]) for r in t] == [(8, 8, 1, 1)] * 3


def test_regions_and_sinks(spark):
    doc = {"pages": [{"page": 1, "lines": [{"type": "text", "region": {"top_left_x": 1, "top_left_y": 2, "width": 3, "height": 4}}]}, {"page": 2, "lines": []}]}
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc string, json string")
    assert [tuple(r) for r in documents.regions(df, "json", "doc").collect()] == [("d", 1, 0, "text", 1.0, 2.0, 4.0, 6.0)]
    with pytest.raises(Exception, match="no pages"):
        documents.regions(spark.createDataFrame([("d", "{}")], "doc string, json string"), "json", "doc").collect()
    b = spark.createDataFrame([(7, 1, "table", 0, 0, 99, 49, 300.0, "x"), (7, 2, "rule", 10, 10, 10, 90, 300.0, "y")], "page_id long, id long, type string, x0 long, y0 long, x1 long, y1 long, dpi double, label string")
    page = json.loads(documents.page_json(b).collect()[0]["json"])
    assert page["lines"][0]["region"] == {"top_left_x": 0.0, "top_left_y": 0.0, "width": 24.0, "height": 12.0} and page["lines"][0]["text"] == ""
    coco = json.loads(documents.coco_json(b).collect()[0]["json"])
    assert [c["name"] for c in coco["categories"]] == ["x", "y"] and coco["annotations"][1]["bbox"] == [10, 10, 1, 81] and coco["annotations"][1]["category_id"] == 2


def test_fixed_width(spark):
    lines = ["name        type   emb", "----------- ------ ---", "ABC+Times   Type 1 yes", "Foo Bar     TrueTy no"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "path string, pos int, value string")
    assert [r["cells"] for r in documents.fixed_width(df).orderBy("n").collect()] == [["ABC+Times", "Type 1", "yes"], ["Foo Bar", "TrueTy", "no"]]


def test_merge_to_fixed_point(spark):
    rows = [(1, i, 3 * i, 0, 3 * i + 1, 1) for i in range(6)] + [(1, 9, 100, 100, 101, 101)]
    b = spark.createDataFrame(rows, "page_id long, id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted((r["x0"], r["x1"]) for r in spatial.merge_boxes(b, 2).collect()) == [(0, 16), (100, 101)]


def test_seam_of_a_wall_with_a_door(spark):
    rows = [(1, y, x, 9) for y in range(3) for x in range(5) if not (y == 1 and x == 3)] + [(1, 1, 3, 1)]
    df = spark.createDataFrame(rows, "page_id long, by long, bx long, ink long")
    r = layout.seam(df, 5).collect()[0]
    assert r["cost"] == 19 and r["path"][1] == 3


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aaa bbb"), (2, "x" * 70 + "e")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = pages.topology(s).writeStream.format("memory").queryName("topo").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.sql("select page_id, components from topo").collect()) == [(1, 1), (2, 1)]
    ring = [(1, 0, 0, 4), (1, 1, 0, 0), (1, 1, 4, 4), (1, 2, 0, 4), (1, 5, 0, 1), (1, 5, 3, 3), (1, 6, 2, 2), (1, -1, 0, 0)]
    runs = spark.createDataFrame(ring, "page_id long, line long, lo long, hi long")
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    s = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    q = pages.closures(s).writeStream.format("memory").queryName("closed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r)[2:] for r in spark.sql("select * from closed").collect()) == [(3, 5, 6), (4, 0, 2)]
