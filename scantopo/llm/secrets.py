"""Secret scans: fixed patterns, and strings that zstandard can't derive from what stands around them [operator 8]."""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantopo.llm._text import Carried, parts

KINDS = ("assign", "access", "hex", "novel")
#: The three patterns every scan must find.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Words that stand near secrets in configuration and code.
SENSITIVE = re.compile(r"(?ai:passw(or)?d|passphrase|secret|token|credential|private.?key|api.?key|access.?key|auth(orization)?\b|bearer|client.?id|signature|connection.?string)")
#: Strings that may be secrets: long, of one alphabet of encodings, with a digit and a letter.
PART = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Such strings joined by dots, with shorter ones between, as in signed tokens.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}+(?:(?:\.[A-Za-z0-9+/_=-]++)*\.[A-Za-z0-9+/_=-]{16,})?")
#: A next line, or one after an escaped line break, that holds nothing else.
LINE = re.compile(r"""(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_=-]++)(?=[ \t]*(?:\r?\n|\\|["']|\Z))""")
#: Least width of the lines that a long encoded string is wrapped to.
WRAP = 40
#: What code and identifiers commonly hold; candidates made of it compress away.
DICTIONARY = b" ".join(
    [
        b"import from return class function const static public private void string int boolean null none true false",
        b"get set is has to of for with by id key value name type index count list map array object default config settings",
        b"user name first last item items result error message handler manager service request response session cookie",
        b"create update delete remove add find load save read write parse format string builder factory provider context",
        b"http https www com org net example localhost html json xml yaml utf-8 base64 sha256 md5 version latest release",
        b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 ffffffff 11111111 12345678",
        b"username user_name password_hash access_token_url client_secret_path api_key_name token_type secret_name",
    ]
)
CONTEXT, NEAR = 200, 60
#: Lines below a sensitive word whose first NEAR characters are near it as well.
BELOW = 2
#: Bits a character of strings that are compressed at all; 16 random hexadecimal digits are under 3 now and then.
LEAST_ENTROPY = 2.5
#: Reported: marginal compressed bytes of at least this share of what a random string of the same alphabet and length
#: costs at the same place, or RAW bytes a character, as short strings vary by whole bytes. Neither bar rises with length.
NOVELTY, RAW = 0.9, 0.75
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets smaller than that of the kinds of characters they have.
_SMALL = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _LOWER + "234567")


@functools.lru_cache(maxsize=1)
def _tools() -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(19, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def random_like(candidate: str) -> str:
    """A random string, the same each time, of the candidate's alphabet and length."""
    own = set(candidate) - set("=.")
    kinds = [k for k in (_LOWER, _UPPER, _DIGITS) if own & set(k)]
    whole = "".join(kinds) + "".join(sorted(own - set(_LOWER + _UPPER + _DIGITS)))
    return "".join(random.Random(len(candidate)).choices(next((k for k in _SMALL if own <= set(k)), whole), k=len(candidate)))


def marginal(candidate: str, around: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, as a share of what NOVELTY and RAW call random: 1 at the bar.

    The difference of two frames with the same dictionary, less the byte of the space between. Letter case is left out, as
    identifiers change it from word to word; so it is in the random string, which hence costs what a secret can at most.
    """
    z = _tools()
    near = around.lower().encode("utf-8", "replace")
    base = len(z.compress(near))
    more = lambda c: max(0, len(z.compress(near + b" " + c.lower().encode())) - base - 1)
    own = more(candidate)
    plain = own / (len(candidate) * RAW)
    return plain if plain >= 1 else max(plain, own / max(1, more(random_like(candidate))) / NOVELTY)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and without overlap in each kind; matches that fail their length are dropped."""
    out = []
    low = t.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in t:
        out += [("access", *m.span()) for m in ACCESS.finditer(t) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in _LONG_HEX.finditer(t)]


#: A maximal run of HEX is kept if it has LEAST_HEX characters, which this finds directly.
_LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
_HINT = ("passw", "passphrase", "secret", "token", "credential", "private", "api", "access", "auth", "bearer", "client", "signature", "connection")


def unions(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The unions of overlapping spans, in order."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def whole(t: str, a: int) -> int:
    """Where the candidate that starts at ``a`` ends: at its own end, and past the lines it is wrapped to.

    Lines after it belong to it while they are as wide as the first of them, which is WRAP at least; so does one shorter
    line at last.
    """
    b = CANDIDATE.match(t, a).end()
    width = 0
    while m := LINE.match(t, b):
        n = m.end() - m.start(1)
        if n > width if width else n < WRAP:
            break
        b = m.end()
        if n < width:
            break
        width = n
    return b


def novel_spans(t: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Incompressible strings that start up to NEAR characters after a sensitive word, or after the start of one of the
    BELOW lines under it, to their own ends; not those of which spans already taken leave less than a candidate's length.

    A string that isn't incompressible as a whole is judged part by part, and again from sensitive words within it. Where
    over 512 characters are left, this is done only if they are at most 7/8 of what was judged last: if more of it were
    random, all of it would have passed. So a run of many sensitive words takes linear time.
    """
    low = t.lower()
    if not any(h in low for h in _HINT):
        return []
    ends = [s.end() for s in SENSITIVE.finditer(t)]
    lines = [m.end() for m in re.finditer("\n", t)] if ends else []
    starts = set(ends)
    for e in ends:
        at = bisect_right(lines, e)
        starts.update(lines[at : at + BELOW])
    covered = unions([(x, y) for _, x, y in taken])
    out: list[tuple[int, int]] = []

    def novel(a: int, b: int) -> bool:
        c = re.sub(r"\s+|\\[rn]", "", t[a:b])
        if not (re.search(r"\d", c) and re.search(r"[A-Za-z]", c)) or entropy(c) < LEAST_ENTROPY:
            return False
        own = 0
        for x, y in covered[max(0, bisect_left(covered, (a, a)) - 1) :]:
            if x >= b:
                break
            own += max(0, min(b, y) - max(a, x))
        if b - a - own < 16 or marginal(c, t[max(0, a - CONTEXT) : a] + t[b : b + CONTEXT]) < 1:
            return False
        out.append((a, b))
        return True

    end, found, inner = -1, False, []  # of the last whole candidate; its parts, each with the start last judged
    for lo in sorted(starts):
        pos = lo
        while m := PART.search(t, pos, min(len(t), lo + NEAR + 16)):
            a = m.start()
            if a > lo + NEAR:
                break
            if a >= end:
                end = whole(t, a)
                found = novel(a, end)
                inner = [] if found else [[x, y, x, (x, y) != (a, end) and novel(x, y)] for x, y in (p.span() for p in PART.finditer(t, a, end))]
            elif not found:
                part = inner[bisect_right(inner, a, key=lambda p: p[0]) - 1]
                _, y, last, known = part
                if not known and last < a < y and (y - a <= 512 or y - a <= (y - last) * 7 // 8):
                    part[2:] = a, novel(a, y)
            pos = end
    return [("novel", a, b) for a, b in out]


def spans_of(t: str) -> list[tuple[str, int, int]]:
    base = base_spans(t)
    return sorted(base + novel_spans(t, base), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "spans array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, and its columns or those in ``keep``, with secret_spans: kind, start and end in code
    points, by start and kind.

    One pass over whole texts, long ones too, without a shuffle. Null and empty texts have no spans; rows that repeat
    give equal rows; nulls in other columns stay; an empty table gives an empty table; a column secret_spans of the
    input is replaced, other columns are kept whatever their names.
    """
    own = Carried(docs, docs.columns if keep is None else keep, ("secret_spans",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [[{"kind": k, "start": x, "end": y} for k, x, y in spans_of(t or "")] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, _SPAN)], names=[*own.inner, "secret_spans"])

    return docs.select(F.col("text").alias("_text"), *own.take).mapInArrow(run, f"{own.fields}secret_spans {SCHEMA.split(' ', 1)[1]}").select(*own.back, "secret_spans")


def mask(text: str | None, spans: list[tuple[int, int]], by: str = "[SECRET]") -> str | None:
    """The text with every union of overlapping spans replaced."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in unions(spans):
        out += [text[at:a], by]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` masked, and n_chars, where there is one, of the text as it is then.

    All rows and columns are kept, in one pass; null texts stay null; an empty table gives an empty table.
    """
    names, own = docs.columns, Carried(docs, docs.columns)
    at, n = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, at):
            cols, texts = list(b.columns), b.column(at).to_pylist()
            spans = [[(x, y) for _, x, y in spans_of(t or "")] for t in texts]
            new = [mask(t, s) for t, s in zip(texts, spans, strict=True)]
            cols[at] = pa.array(new, b.schema.types[at])
            if n >= 0:
                old = b.column(n).to_pylist()
                cols[n] = pa.array([len(t) if s else o for t, s, o in zip(new, spans, old, strict=True)], b.schema.types[n])
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    inner = docs.select(*own.take)
    return inner.mapInArrow(run, inner.schema).select(*own.back)
