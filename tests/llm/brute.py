"""Plain, slow versions of the contracts, without Spark."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
import zstandard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        spans: list[list[int]] = []
        for p in range(len(t) - length + 1):
            if n[t[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        kept, at = b"", 0
        for a, z in spans:
            kept += t[at:a]
            at = z
        out.append((len(t), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept + t[at:]).hexdigest()))
    return out


def decontaminate(texts: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple[int, int, int, str, bool]]:
    windows: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if x := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= x
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def bag(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_classes(texts: list[str | None]) -> list[int]:
    """For each text the least index in its class."""
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    holders, shared = defaultdict(list), Counter()
    for i, b in enumerate(bags):
        for s in b:
            holders[s].append(i)
    for s, own in holders.items():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                shared[i, j] += min(bags[i][s], bags[j][s])
    pairs = [p for p, n in shared.items() if 5 * n >= 4 * (bags[p[0]].total() + bags[p[1]].total() - n)]
    bare = defaultdict(list)
    for i, b in enumerate(bags):
        if not b:
            bare[texts[i] or ""].append(i)
    pairs += [(own[0], j) for own in bare.values() for j in own[1:]]
    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    t = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    w = words(text)
    at = [(i, x) for p, x in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def _operand(t: list[str], i: int) -> tuple[int, set[str], bool] | None:
    from scantopo.llm.licenses import PERMISSIVE, family

    if i < len(t) and t[i] == "(":
        found = _expression(t, i + 1)
        return (found[0] + 1, *found[1:]) if found and found[0] < len(t) and t[found[0]] == ")" else None
    if i == len(t) or t[i] == ")" or t[i].lower() in ("or", "and", "with"):
        return None
    return i + 1, {family(t[i])}, family(t[i]) in PERMISSIVE


def _expression(t: list[str], i: int, level: int = 0) -> tuple[int, set[str], bool] | None:
    """By recursive descent: level 0 is OR, 1 AND, 2 WITH."""
    inner = (lambda k: _operand(t, k)) if level == 2 else (lambda k: _expression(t, k, level + 1))
    a = inner(i)
    while a and a[0] < len(t) and t[a[0]].lower() == ("or", "and", "with")[level]:
        b = inner(a[0] + 1)
        if not b:
            return None
        a = (b[0], a[1], a[2]) if level == 2 else (b[0], a[1] | b[1], (a[2] or b[2]) if level == 0 else (a[2] and b[2]))
    return a


def license_labels(text: str | None) -> tuple[str, float]:
    """All labels, and the score."""
    from scantopo.llm.licenses import NOTICES

    w = words(text)
    phrases = {**NOTICES, **PHRASES}
    found = [x for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    doubt, labels = 0.5 ** len(found), set(found)
    if any(w[i : i + 3] == ["spdx", "license", "identifier"] for i in range(len(w))):
        for line in re.findall(r"(?ai:spdx[^0-9A-Za-z\n\x80-\U0010ffff]+license[^0-9A-Za-z\n\x80-\U0010ffff]+identifier)[ \t]*[:=]([^\n]*)", text or ""):
            t, at = [], 0
            while m := re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)").match(line, at):
                t.append(m[1])
                at = m.end()
            for n in range(len(t), 0, -1):
                e = _expression(t[:n], 0)
                if e and e[0] == n:
                    labels |= e[1]
                    doubt *= 0.05
                    break
    return ",".join(sorted(labels)), 1 - doubt


def languages(docs: list[tuple]) -> list[tuple[str, float]]:
    """Predictions and margins for rows (doc_id, text, lang), learned from those that aren't held out."""
    from scantopo.llm import langid

    letters = lambda t: " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split())
    name = lambda i: "" if i is None else str(i)
    known = [(i, t, x) for i, t, x in docs if t is not None and x is not None and zlib.crc32(name(i).encode()) % 3 != 1]
    n, sample = Counter(x for _, _, x in known), defaultdict(set)
    for i, t, x in known:
        h = 42
        for v in ("langid", name(i), t):
            h = xxhash.xxh64_intdigest(v.encode(), seed=h)
        signed = h - (1 << 64) if h >> 63 else h
        if (signed % (1 << 30)) / (1 << 30) < langid.SAMPLE / n[x]:
            lo = max(1, (len(t) - langid.SHARE) // 2)
            sample[x].add((signed, t[lo - 1 : lo - 1 + langid.SHARE]))
    how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
    tools = {x: zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict("".join(letters(t) + " " for _, t in sorted(s)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for x, s in sample.items()}
    out = []
    for _, t, _ in docs:
        raw = letters(t or "").encode()
        k = max(1, round(len(raw) / langid.PIECE))
        step = max(1, -(-len(raw) // k))
        size = sorted((sum(len(z.compress(raw[a : a + step])) for a in range(0, len(raw), step)), x) for x, z in tools.items())
        out.append((size[0][1], 1 - size[0][0] / size[1][0] if len(size) > 1 else 1.0) if raw and size else ("und", 0.0))
    return out


def toxicity(texts: list[str | None], examples: list[tuple], share: float) -> list[tuple[float, list]]:
    """Score and evidence of each text, from examples (doc_id, toxic, text): all vectors against all, without an index."""
    from scantopo.llm.toxicity import BEGINNINGS, BY_CHANCE, LEAST_TEXTS, NEIGHBOURS, isotonic

    def terms(text: str | None) -> Counter:
        w = [x.encode() for x in words(text)]
        n = Counter(("word", x) for x in w) + Counter((k, x[:k]) for x in w for k in BEGINNINGS if len(x) > k)
        return Counter(n) + Counter({(t, k): c for t, c in n.items() for k in (2, 3) if c >= k})

    rows = [(i, y, terms(t)) for i, y, t in examples]
    size = Counter(y for _, y, _ in rows)
    held = {c: Counter(t for _, y, n in rows if y == c for t in n) for c in (0, 1)}
    every, p, n = set(held[0]) | set(held[1]), size[1], size[0]
    part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
    vocabulary = set()
    for t in every if p and n else ():
        a, b = held[1][t], held[0][t]
        g = 2 * (part(a, (a + b) * p / (p + n)) + part(b, (a + b) * n / (p + n)) + part(p - a, (p + n - a - b) * p / (p + n)) + part(n - b, (p + n - a - b) * n / (p + n)))
        if a + b >= LEAST_TEXTS and g >= 2 * math.log(max(2, len(every)) / BY_CHANCE) and a / p > b / n:
            vocabulary.add(t)
    of = [{t: c for t, c in terms(x).items() if t in vocabulary} for x in texts]
    freq = Counter(t for x in of for t in x)
    idf = {t: math.log((len(texts) + 1) / (freq[t] + 1)) + 1 for t in vocabulary}

    def vector(x: dict) -> dict:
        w = {t: (1 + math.log(c)) * idf[t] for t, c in x.items()}
        z = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / z for t, v in w.items()}

    weigh = [max(1 - share, 1e-9) / max(1, n), max(share, 1e-9) / max(1, p)]
    votes: dict = {}
    bare = [0.0, 0.0]
    for i, y, x in sorted(rows, key=lambda r: r[0]):
        x = {t: c for t, c in x.items() if t in vocabulary}
        own = votes.setdefault(frozenset(x.items()), (i, [0.0, 0.0], vector(x)))[1] if x else bare
        own[y] += weigh[y] / min(weigh)
    known = list(votes.values())

    def near(v: dict, skip: object = None) -> list:
        s = [(-round(sum(v[t] * w.get(t, 0.0) for t in v), 12), i, y) for i, y, w in known if (i, y) != skip]
        return sorted(x for x in s if x[0] < 0)[:NEIGHBOURS]

    def raw(found: list) -> float:
        w = [(1 / (1.05 + max(s, -1)), y) for s, _, y in found]
        return (sum(a * y[1] for a, y in w) + share) / (sum(a * sum(y) for a, y in w) + 1)

    x = np.array([raw(near(w, (i, y))) for i, y, w in known])
    steps = isotonic(x, np.array([y[1] / sum(y) for _, y, _ in known]), np.array([sum(y) for _, y, _ in known])) if known else None
    out = []
    for t in of:
        found = near(vector(t)) if t else []
        s = float(np.interp(raw(found), *steps)) if found else (bare[1] + share) / (sum(bare) + 1)
        out.append((min(1.0, max(0.0, s)), [(i, round(-c, 9)) for c, i, _ in found[:5]]))
    return out
