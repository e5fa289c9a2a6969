"""Type 1 fonts: reading programs, interpreting glyphs as outlines, counting first operators.

After Adobe's published description of the format. Fixed values are its keys, constants and operator numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

EEXEC_KEY, CHAR_KEY, C1, C2 = 55665, 4330, 52845, 22719
STANDARD = {65: "A", 66: "B", 97: "a", 193: "grave", 194: "acute", 195: "circumflex", 196: "tilde", 200: "dieresis", 202: "ring", 203: "cedilla"} | {ord(c): c for c in "CDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz"}
DEPTH = 30


def decrypt(data: bytes, key: int, skip: int) -> bytes:
    out = bytearray()
    for c in data:
        out.append(c ^ (key >> 8))
        key = ((c + key) * C1 + C2) & 0xFFFF
    return bytes(out[skip:])


def encrypt(data: bytes, key: int, skip: int = 4) -> bytes:
    out = bytearray()
    for p in bytes(skip) + data:
        c = p ^ (key >> 8)
        out.append(c)
        key = ((c + key) * C1 + C2) & 0xFFFF
    return bytes(out)


def segments(raw: bytes) -> tuple[bytes, bytes]:
    """The clear and the encrypted part of a font, from either container."""
    if raw[:1] == b"\x80":
        clear, dark, at = b"", b"", 0
        while raw[at] == 0x80 and raw[at + 1] in (1, 2):
            n = int.from_bytes(raw[at + 2 : at + 6], "little")
            body = raw[at + 6 : at + 6 + n]
            if raw[at + 1] == 2:
                dark += body
            elif not dark:
                clear += body
            at += 6 + n
        return clear, dark
    mark = raw.find(b"eexec")
    if mark < 0:
        raise ValueError("no encrypted part")
    dark = raw[mark + 5 :].lstrip()
    if re.match(rb"[0-9A-Fa-f\s]{8}", dark):
        digits = re.sub(rb"\s", b"", re.match(rb"[0-9A-Fa-f\s]*", dark)[0])
        dark = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    return raw[:mark], dark


@dataclass
class Font:
    name: str
    encoding: dict[int, str]
    subrs: dict[int, bytes]
    glyphs: dict[str, bytes]


def load(raw: bytes, name: str = "") -> Font:
    clear, dark = segments(raw)
    private = decrypt(dark, EEXEC_KEY, 4)
    own = re.search(rb"/FontName\s*/(\S+)", clear)
    skip = int(m[1]) if (m := re.search(rb"/lenIV\s+([+-]?\d+)", private)) else 4
    if skip < 0:
        raise ValueError(f"lenIV {skip} is negative")
    encoding = {int(c): g.decode("latin-1") for c, g in re.findall(rb"dup\s+(\d+)\s*/(\S+)\s+put", clear)}
    subrs, glyphs = {}, {}
    # a string is a length, the font's own word for reading it, a space and as many bytes
    for m in re.finditer(rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\||\S+) ", private):
        subrs.setdefault(int(m[1]), decrypt(private[m.end() : m.end() + int(m[2])], CHAR_KEY, skip))
    at = private.find(b"/CharStrings")
    while at >= 0 and (m := re.compile(rb"/(\S+)\s+(\d+)\s+(?:RD|-\||\S+) ").search(private, at + 12 if private[at : at + 12] == b"/CharStrings" else at)):
        glyphs[m[1].decode("latin-1")] = decrypt(private[m.end() : m.end() + int(m[2])], CHAR_KEY, skip)
        at = m.end() + int(m[2])
    return Font(name or (own[1].decode("latin-1") if own else ""), encoding, subrs, glyphs)


def tokens(code: bytes) -> Iterator[int | str]:
    """Numbers as they are, operators as "n" or "12 n"."""
    i = 0
    while i < len(code):
        v = code[i]
        i += 1
        if v >= 32:
            if v <= 246:
                yield v - 139
            elif v <= 250:
                yield (v - 247) * 256 + code[i] + 108
                i += 1
            elif v <= 254:
                yield -(v - 251) * 256 - code[i] - 108
                i += 1
            else:
                yield int.from_bytes(code[i : i + 4], "big", signed=True)
                i += 4
        elif v == 12:
            yield f"12 {code[i]}"
            i += 1
        else:
            yield str(v)


@dataclass
class Outline:
    width: float = 0.0
    paths: list[list[tuple]] = field(default_factory=list)


def outline(font: Font, name: str) -> Outline:
    """The paths of a glyph: ("M", x, y), ("L", x, y), ("C", x1, y1, x2, y2, x, y). Unknown operators raise."""
    out, pen, stack, post, flex = Outline(), [0.0, 0.0], [], [], []
    state = {"flex": False}

    def move(dx: float, dy: float) -> None:
        pen[0] += dx
        pen[1] += dy
        if state["flex"]:
            flex.append(tuple(pen))
        else:
            out.paths.append([("M", *pen)])

    def line(dx: float, dy: float) -> None:
        pen[0] += dx
        pen[1] += dy
        out.paths[-1].append(("L", *pen))

    def curve(a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        x1, y1 = pen[0] + a, pen[1] + b
        x2, y2 = x1 + c, y1 + d
        pen[:] = [x2 + e, y2 + f]
        out.paths[-1].append(("C", x1, y1, x2, y2, *pen))

    def other(n: int, args: list[float]) -> None:
        if n == 1:
            state["flex"] = True
            flex.clear()
        elif n == 0:
            state["flex"] = False
            p = flex[1:]
            for a, b, c in (p[0:3], p[3:6]):
                out.paths[-1].append(("C", *a, *b, *c))
            post.extend([args[2], args[1]])
        elif n == 3:
            post.append(3)
        elif n != 2:
            post.extend(args[::-1])

    def run(code: bytes, depth: int) -> bool:
        if depth > DEPTH:
            raise ValueError(f"{name}: subroutines nest too deeply")
        for t in tokens(code):
            if not isinstance(t, str):
                stack.append(float(t))
                continue
            s = list(stack)
            if t == "10":
                if run(font.subrs[int(stack.pop())], depth + 1):
                    return True
                continue
            if t == "12 16":
                n, k = int(stack.pop()), int(stack.pop())
                args = [stack.pop() for _ in range(k)][::-1]
                other(n, args)
                continue
            if t == "12 17":
                stack.append(post.pop() if post else 0.0)
                continue
            if t == "12 12":
                b = stack.pop()
                stack[-1] /= b
                continue
            if t == "11":
                return False
            if t == "13":
                pen[0], out.width = s[0], s[1]
            elif t == "12 7":
                pen[:], out.width = s[:2], s[2]
            elif t == "21":
                move(s[-2], s[-1])
            elif t == "22":
                move(s[-1], 0)
            elif t == "4":
                move(0, s[-1])
            elif t == "5":
                line(*s[-2:])
            elif t == "6":
                line(s[-1], 0)
            elif t == "7":
                line(0, s[-1])
            elif t == "8":
                curve(*s[-6:])
            elif t == "30":
                curve(0, s[0], s[1], s[2], s[3], 0)
            elif t == "31":
                curve(s[0], 0, s[1], s[2], 0, s[3])
            elif t == "12 33":
                pen[:] = s[-2:]
            elif t == "12 6":
                asb, dx, dy, base, accent = s[-5:]
                b, a = outline(font, STANDARD[int(base)]), outline(font, STANDARD[int(accent)])
                shift = lambda p: (p[0], *[v + (dx - asb, dy)[i % 2] for i, v in enumerate(p[1:])])
                out.paths += b.paths + [[shift(p) for p in path] for path in a.paths]
                return True
            elif t == "14":
                return True
            elif t not in ("1", "3", "9", "12 0", "12 1", "12 2"):
                raise ValueError(f"{name}: unknown operator {t}")
            stack.clear()
        return False

    run(font.glyphs[name], 0)
    return out


def first_operator(font: Font, name: str) -> str:
    """The class of a glyph's first operator: hsbw, sbw, callsubr, another command, or truncated."""
    for t in tokens(font.glyphs[name]):
        if isinstance(t, str):
            return {"13": "hsbw", "12 7": "sbw", "10": "callsubr"}.get(t, "cmd")
    return "truncated"


def glyphs(files: DataFrame) -> DataFrame:
    """(path, font, glyph, width, first, n_paths, error) of the fonts of ``binaryFile`` rows (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                try:
                    font = load(bytes(raw))
                except (ValueError, IndexError) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
                    continue
                for g in font.glyphs:
                    try:
                        o = outline(font, g)
                        rows.append((path, font.name, g, o.width, first_operator(font, g), len(o.paths), None))
                    except (ValueError, IndexError, KeyError) as e:
                        rows.append((path, font.name, g, None, first_operator(font, g), None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "font", "glyph", "width", "first", "n_paths", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, font string, glyph string, width double, first string, n_paths int, error string")
