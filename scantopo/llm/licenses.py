"""Licence scans: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard [operator 10]."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from scantopo.llm._text import WORD, encode, parts

#: The phrases every scan must find, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases that the method adds, as words: names of licences, and sentences that stand in their texts and notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "eclipse distribution license": "bsd",
    "common public license": "cpl",
    "ibm public license": "ipl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "european union public license": "eupl",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "python software foundation license": "psf",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd 4 clause": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "x11 license": "mit",
    "ncsa open source license": "ncsa",
    "postgresql license": "postgresql",
    "sil open font license": "ofl",
    "open data commons": "odc",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "boost software license": "bsl",
    "mulan permissive software license": "mulanpsl",
    "do what the fuck you want to public license": "wtfpl",
    "wtfpl": "wtfpl",
    "the unlicense": "unlicense",
    "blue oak model license": "blueoak",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain dedication": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "agplv3": "agpl",
    "agpl 3 0": "agpl",
    "mpl 2 0": "mpl",
    "epl 2 0": "epl",
    "apache 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "altered source versions must be plainly marked as such": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license": "gfdl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser": "lgpl",
    "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you": "apache",
    "the person who associated a work with this deed has dedicated the work to the public domain": "cc0",
}
#: Phrases that announce a licence expression, as words; the expression is read from the text itself.
TAGS = ("spdx license identifier",)
#: Families that permit reuse without conditions on derived works.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc-by", "bsl", "unlicense", "zlib", "ncsa", "postgresql", "psf", "wtfpl", "blueoak"})

_TABLE = bytes(int(WORD[i]) or 0x20 for i in range(256))
_TAG = re.compile(r"(?ai:spdx[^0-9A-Za-z\n\x80-\U0010ffff]+license[^0-9A-Za-z\n\x80-\U0010ffff]+identifier)[ \t]*[:=][ \t]*([^\n]*)")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


#: A version at the end of an identifier, read from its end, with what may follow it.
_VERSION = re.compile(r"(?:\+|ylno-|retal-ro-)?\d+(?:\.\d+)*v?-?")


def family(identifier: str) -> str:
    """The family of a licence identifier: lower case, without the version and what follows it; in linear time."""
    name = identifier.lower()
    cut = [len(name)]
    if m := _VERSION.match(name[::-1]):
        cut.append(len(name) - m.end())
    if m := re.search(r"-\d", name):
        cut.append(m.start())
    return name[: min(cut)].rstrip("+-") or name


def parse(expression: str) -> list[str]:
    """Reverse Polish form of the longest valid expression that ``expression`` begins with; [] if there is none.

    Shunting-yard with WITH above AND above OR, any letter case. A dangling operator or bracket ends the expression
    before it. The tokens are read once to find where the last valid expression ends, and up to there once more.
    """
    tokens: list[str] = []
    at = end = depth = 0
    operand = True  # what must come next
    while m := _TOKEN.match(expression, at):
        t, at = m[1], m.end()
        if operand != (t == "(" or t != ")" and t.lower() not in _RANK) or (t == ")" and not depth):
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        operand = t == "(" or t.lower() in _RANK
        if not (operand or depth):
            end = len(tokens)
    return _yard(tokens[:end])


def _yard(tokens: list[str]) -> list[str]:
    """Reverse Polish form of a valid expression."""
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        op = t.lower()
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif op in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
        else:
            out.append(t)
    return out + stack[::-1]


def evaluate(rpn: list[str], permitted: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """The families an expression names, and whether it can be met by permitted ones alone.

    OR needs one side, AND both; WITH keeps the licence before it (the exception after it is no licence). The smaller
    set of families is put into the larger, so a long expression takes no more than n log n steps.
    """
    stack: list[tuple[set[str], bool]] = []
    for t in rpn:
        if t not in _RANK:
            name = family(t)
            stack.append(({name}, name in permitted))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append(a)
            continue
        small, large = sorted((a[0], b[0]), key=len)
        large |= small
        stack.append((large, (a[1] or b[1]) if t == "or" else (a[1] and b[1])))
    return stack[0] if stack else (set(), False)


@functools.lru_cache(maxsize=4)
def _automaton(notices: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, (kind, label) in {**{p: ("notice", x) for p, x in notices}, **{t: ("tag", "") for t in TAGS}, **{p: ("base", x) for p, x in BASE.items()}}.items():
        a.add_word(f" {phrase} ", (kind, label, len(phrase) + 1, phrase.count(" ") + 1))
    a.make_automaton()
    return a


def scan_text(text: bytes, notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items())) -> dict:
    """Words, hits (kind, label, first word, words) and expressions of one text."""
    words = text.translate(_TABLE).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape")
    hits, expressions = [], []
    spaces: list[int] = []
    for end, (kind, label, back, n) in _automaton(notices).iter(joined):
        spaces = spaces or [i for i, c in enumerate(joined) if c == " "]
        hits.append((kind, label, bisect_left(spaces, end - back), n))
    if any(h[0] == "tag" for h in hits):
        for m in _TAG.finditer(text.decode("utf-8", "replace")):
            if rpn := parse(m[1]):
                names, free = evaluate(rpn)
                expressions.append((" ".join(rpn), sorted(names), free))
    return {"n_words": len(words), "hits": hits, "expressions": expressions}


def confidence(base: int, notices: int, expressions: int) -> float:
    """0 without evidence; each base phrase or notice halves the doubt, an expression leaves a twentieth of it."""
    return 1.0 - 0.5 ** (base + notices) * 0.05**expressions


SCHEMA = (
    "n_words long, hits array<struct<kind:string,label:string,first_word:long,n_words:long>>,"
    " expressions array<struct<rpn:string,families:array<string>,permissive:boolean>>, score double"
)


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id with n_words, hits, expressions and score for each row of ``docs`` (doc_id, text).

    One pass over whole texts, without a shuffle, in time and memory linear in a text's length. Null and empty texts
    have no words, hits or expressions and score 0; a null doc_id is kept; rows that repeat give equal rows; an empty
    table gives an empty table; further columns, of whatever name, are left aside.
    """
    pairs = tuple(notices.items())
    fields = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            found = []
            for t in encode(b.column(1)):
                x = scan_text(t, pairs)
                base, more = sum(h[0] == "base" for h in x["hits"]), sum(h[0] == "notice" for h in x["hits"])
                found.append(x | {"score": confidence(base, more, len(x["expressions"]))})
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(found)], names=["doc_id", "n_words", "hits", "expressions", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {fields}, {SCHEMA}")


def _columns(found: list[dict]) -> list[pa.Array]:
    hit = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    exp = pa.struct([("rpn", pa.string()), ("families", pa.list_(pa.string())), ("permissive", pa.bool_())])
    return [
        pa.array([x["n_words"] for x in found], pa.int64()),
        pa.array([[dict(zip(("kind", "label", "first_word", "n_words"), h, strict=True)) for h in x["hits"]] for x in found], pa.list_(hit)),
        pa.array([[dict(zip(("rpn", "families", "permissive"), e, strict=True)) for e in x["expressions"]] for x in found], pa.list_(exp)),
        pa.array([x["score"] for x in found], pa.float64()),
    ]
