"""A font put together in memory."""

from __future__ import annotations

import pytest

from scantopo.sources import fonts


def number(n: int) -> bytes:
    if -107 <= n <= 107:
        return bytes([n + 139])
    if 108 <= n <= 1131:
        return bytes([247 + (n - 108) // 256, (n - 108) % 256])
    if -1131 <= n <= -108:
        return bytes([251 + (-n - 108) // 256, (-n - 108) % 256])
    return b"\xff" + n.to_bytes(4, "big", signed=True)


def code(*items) -> bytes:
    return b"".join(number(i) if isinstance(i, int) else bytes(map(int, i.split())) for i in items)


BOX = code(10, 500, "13", 0, 0, "21", 300, "6", 400, "7", -300, "6", "9", "14")
FLEX = code(0, 600, "13", 0, 0, "21", 1, "10", 10, 0, "21", 2, "10", 0, 10, "21", 2, "10", 5, 5, "21", 2, "10", 5, 0, "21", 2, "10", 5, 0, "21", 2, "10", 5, -5, "21", 2, "10", 0, -10, "21", 2, "10", 50, 30, 0, 0, "10", "9", "14")


def font_bytes(hexed: bool = False, pfb: bool = False, skip: int = 4) -> bytes:
    subrs = [code(3, 0, "12 16", "12 17", "12 17", "12 33", "11"), code(0, 1, "12 16", "11"), code(0, 2, "12 16", "11")]
    glyphs = {"A": BOX, "acute": BOX, "f": FLEX, "bad": code(1, "12 99"), "none": code(5), "Aacute": code(0, 500, "13", 10, 100, 200, 65, 194, "12 6")}
    body = b"dup /Private\n/lenIV %d def\n/Subrs 3 array\n" % skip
    for i, s in enumerate(subrs):
        e = fonts.encrypt(s, fonts.CHAR_KEY, skip)
        body += b"dup %d %d RD " % (i, len(e)) + e + b" NP\n"
    body += b"/CharStrings 3 dict dup begin\n"
    for g, s in glyphs.items():
        e = fonts.encrypt(s, fonts.CHAR_KEY, skip)
        body += b"/%s %d RD " % (g.encode(), len(e)) + e + b" ND\n"
    clear = b"%!PS-AdobeFont-1.0\n/FontName /Test def\ndup 65 /A put\ncurrentfile eexec\n"
    dark = fonts.encrypt(body, fonts.EEXEC_KEY)
    if pfb:
        return b"\x80\x01" + len(clear).to_bytes(4, "little") + clear + b"\x80\x02" + len(dark).to_bytes(4, "little") + dark + b"\x80\x03"
    return clear + (dark.hex().encode() if hexed else dark)


@pytest.mark.parametrize("how", [{}, {"hexed": True}, {"pfb": True}, {"skip": 0}])
def test_load_and_outline(how):
    f = fonts.load(font_bytes(**how))
    assert f.name == "Test" and f.encoding == {65: "A"} and len(f.glyphs) == 6
    a = fonts.outline(f, "A")
    assert a.width == 500 and a.paths == [[("M", 10.0, 0.0), ("L", 310.0, 0.0), ("L", 310.0, 400.0), ("L", 10.0, 400.0)]]
    both = fonts.outline(f, "Aacute").paths
    assert both[0] == a.paths[0] and both[1][0] == ("M", 100.0, 200.0)
    bends = fonts.outline(f, "f").paths[0]
    assert [p[0] for p in bends] == ["M", "C", "C"] and bends[-1][-2:] == (30.0, 0.0)
    with pytest.raises(ValueError, match="unknown operator"):
        fonts.outline(f, "bad")
    assert [fonts.first_operator(f, g) for g in ("A", "bad", "none")] == ["hsbw", "cmd", "truncated"]


def test_negative_skip():
    with pytest.raises(ValueError, match="lenIV -1"):
        fonts.load(_with_skip(b"-1"))


def _with_skip(text: bytes) -> bytes:
    raw = font_bytes()
    clear, dark = raw.split(b"eexec\n", 1)
    return clear + b"eexec\n" + fonts.encrypt(fonts.decrypt(dark, fonts.EEXEC_KEY, 4).replace(b"/lenIV 4", b"/lenIV " + text), fonts.EEXEC_KEY)


def test_glyphs(spark):
    df = spark.createDataFrame([("x", font_bytes()), ("y", b"junk")], "path string, content binary")
    got = {(r["path"], r["glyph"]): (r["n_paths"], r["error"] is None) for r in fonts.glyphs(df).collect()}
    assert got["x", "A"] == (1, True) and got["x", "bad"] == (None, False) and got["y", None] == (None, False)
