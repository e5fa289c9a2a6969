"""Removal of long strings that occur twice, by a depth-limited radix sort of suffixes [operator 1].

The strings are ``LENGTH`` bytes. Sorting every suffix to that depth would shuffle each byte of the corpus many times;
but a string is met at its leading digit, and any digit will do that equal strings agree on. Here the first, wide digit
of the suffix at a position is the GRAM bytes of least hash within its first LENGTH bytes. Neighbouring suffixes have
that digit in common, so a *segment* of them, about one in 85 bytes, is one row of the passes that follow:

1. digit: the gram. Segments whose gram is unique in the corpus go; nothing in them occurs twice.
2. digit: the segment's whole context, from its first suffix to the end of its last. Where a context occurs twice, all
   its suffixes do; they are done.
3. of contexts that share a gram but differ, one of each meets the others, and their suffixes are sorted by eight bytes
   a pass, most significant first, until LENGTH; suffixes that stand alone drop out after each pass, and the equal
   groups that are left are the repeated strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantopo.llm._text import BYTE_BASE, HOT_ROWS, Carried, U, encode, materialise, mix64, powers, prefix, slices, span_hash, spread_join, text_key

LENGTH, GRAM = 200, 32
#: Longer texts are read in overlapping pieces of this many suffixes, so that memory is bounded.
PIECE = 1 << 19
#: Different contexts of one gram up to which one task sorts them; of more, each window goes by a wide digit of its own,
#: the digest of its bytes, so that no task reads them all.
HOT_CONTEXTS = 2_000
SORT_BYTES = 4 << 20


class Asked:
    """What a column of lists asks of the texts beside it: contexts, or structs with one, each found by text and context."""

    def __init__(self, lists: pa.ListArray):
        self.flat = lists.flatten()
        self.count = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        context = self["context"] if pa.types.is_struct(self.flat.type) else self.flat.to_numpy()
        self.names, rank = np.unique(context, return_inverse=True)
        key = np.repeat(np.arange(len(lists)), self.count) * len(self.names) + rank
        self.at = np.argsort(key, kind="stable")
        self.key = key[self.at]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.flat.field(name).to_numpy(zero_copy_only=False)

    def rows(self, text: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and context the first and the end of its rows in ``at``; -1, -1 if it has none."""
        if not len(self.key):
            return np.full(len(text), -1), np.full(len(text), -1)
        i = np.minimum(np.searchsorted(self.names, context), len(self.names) - 1)
        key = np.where(self.names[i] == context, text * len(self.names) + i, -1)
        lo, hi = (np.searchsorted(self.key, key, side) for side in ("left", "right"))
        return np.where(lo < hi, lo, -1), np.where(lo < hi, hi, -1)


@dataclass
class Segments:
    """Runs of suffixes that have their leading digit in common; positions are in ``buffer`` or in the text."""

    buffer: np.ndarray
    sums: np.ndarray
    text: np.ndarray  # index of the text
    at: np.ndarray  # position of the first suffix in the buffer
    lo: np.ndarray  # and in the text
    n: np.ndarray  # suffixes
    gram: np.ndarray
    context: np.ndarray
    offset: np.ndarray  # of the gram from the first suffix

    def __len__(self) -> int:
        return len(self.lo)


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, start, bytes) of up to about two pieces' size; no text shorter than ``length``."""
    out: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, PIECE):
            p = t[s : s + PIECE + length - 1]
            out.append((i, s, p))
            size += len(p)
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


def segments(parts: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> Segments:
    buffer = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sums = prefix(buffer.astype(np.uint16) + np.uint16(1), BYTE_BASE)
    count = len(buffer) - gram + 1
    g = sums[gram:] - sums[:count]
    g *= powers(BYTE_BASE, len(sums))[1][:count]
    g = mix64(g)
    span = length - gram + 1
    rank = (g >> U(32)).astype(np.uint32)  # half the digest is enough to choose by
    least, done = rank, 1
    while done < span:  # least of windows of 2, 4, 8, ... and at last of ``span``
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    sizes = np.array([len(p[2]) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # suffixes that have ``length`` bytes within their piece
    new = np.empty(len(least), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])  # another value,
    new[1:] |= rank[: len(least) - 1] == least[:-1]  # or its place has gone by
    new[starts] = True
    for edge in (starts[1:]).tolist():
        new[edge - length + 1 : edge] = False
    at = np.flatnonzero(new)
    piece = np.searchsorted(starts, at, "right") - 1
    n = np.minimum(np.append(at[1:], len(buffer)), (starts + sizes - length + 1)[piece]) - at
    offset = np.empty(len(at), np.int64)
    for i in range(0, len(at), 4096):
        a = at[i : i + 4096]
        offset[i : i + 4096] = np.argmax(rank[a[:, None] + np.arange(span)] == least[a][:, None], axis=1)
    context = span_hash(sums, at, at + n - 1 + length, BYTE_BASE)
    where = np.array([(p[0], p[1]) for p in parts])
    return Segments(buffer, sums, where[piece, 0], at, at - starts[piece] + where[piece, 1], n, g[at + offset].view(np.int64), context.view(np.int64), offset)


def repeated(raw: bytes, start: np.ndarray, n: np.ndarray, key: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix occurs twice, for ``n`` suffixes from each ``start`` in ``raw``: the radix passes.

    ``key`` is what suffixes of equal strings have in common beforehand, one for each. ``raw`` is under 2 GB.
    """
    total = int(n.sum())
    pos = np.repeat((start - np.concatenate([[0], np.cumsum(n)[:-1]])).astype(np.int32), n)
    pos += np.arange(total, dtype=np.int32)
    word = np.ndarray(len(raw) + 1, ">u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place, as they lie
    live = np.argsort(key, kind="stable").astype(np.int32)
    group = key[live]
    for depth in [None, *range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        digit = np.zeros(len(live), U) if depth is None else word[pos[live] + np.int32(depth)].astype(U)
        if depth is not None:
            same = digit == digit[np.flatnonzero(first)][group]
            if same.all():
                continue
            split = np.zeros(len(live), bool)
            split[group[~same]] = True
            at = np.flatnonzero(split[group])  # only groups whose digits differ need sorting
            order = at[np.lexsort((digit[at], group[at]))]
            live[at], digit[at] = live[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(live) else np.empty(0, bool)
        several = ~(new & np.r_[new[1:], True]) if len(live) else new
        live, first = live[several], new[several]
        group = np.cumsum(first, dtype=np.int32) - np.int32(1)
        if not len(live):
            break
    out = np.zeros(total, bool)
    out[live] = True
    return out


_FLAG = "gram long, context long, k1 long, k2 long"


def find(keyed: DataFrame, carry: list[str], copies: DataFrame, length: int = LENGTH, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(k1, k2, whole array<long>, part array<struct<context, lo, hi>>): for each text with repeats, by its key, the
    contexts all of whose suffixes occur twice, and the suffixes [lo, hi) of others that do.

    ``keyed`` has text, the columns ``carry``, k1 and k2; ``copies`` (k1, k2, n) are the texts of very many rows. The
    columns to carry are not used; but as they go along where texts are shuffled by key, Spark sees that whoever joins the
    result to the same rows needs the same shuffle, and makes it once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for first, _, texts in slices(b.column(0), PIECE):
                for parts in pieces(texts, length):
                    s = segments(parts, length)
                    yield pa.RecordBatch.from_arrays([pa.array(s.gram), pa.array(s.context), pa.array(k1[first + s.text]), pa.array(k2[first + s.text])], names=["gram", "context", "k1", "k2"])

    rows = keyed.select("text", "k1", "k2").mapInArrow(scan, _FLAG)
    twice = materialise(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = materialise(spread_join(rows, twice.select("gram"), ["gram"], twice))
    by_context = materialise(met.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2")).alias("rep")))
    several = materialise(by_context.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"))
    state = materialise(spread_join(by_context, several, ["gram"], several.withColumnRenamed("contexts", "n"), "left"))
    text_of = met.select("gram", "context", "k1", "k2").distinct()
    both = state.filter("n > 1").select("gram", "context", "n")
    whole = spread_join(materialise(text_of), both.drop("n"), ["gram", "context"], both).groupBy("k1", "k2").agg(F.collect_set("context").alias("whole"))
    asked = state.filter("contexts > 1").select("rep.k1", "rep.k2", F.struct("context", "contexts", (F.col("n") == 1).alias("single")).alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("want"))
    schema = "gram long, context long, k1 long, k2 long, contexts long, single boolean, off int, n int, raw binary"

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(b.num_columns - 3 + i).to_numpy() for i in range(2))
            for lo, hi, texts in slices(b.column(0), PIECE):
                want = Asked(b.column(b.num_columns - 1).slice(lo, hi - lo))
                for parts in pieces(texts, length):
                    s = segments(parts, length)
                    row, _ = want.rows(s.text, s.context)
                    j = np.flatnonzero(row >= 0)
                    j = j[np.sort(np.unique(row[j], return_index=True)[1])]  # a context once
                    if len(j):
                        own, w = lo + s.text[j], want.at[row[j]]
                        raw = [s.buffer[a:z].tobytes() for a, z in zip(s.at[j], s.at[j] + s.n[j] - 1 + length, strict=True)]
                        cols = [s.gram[j], s.context[j], k1[own], k2[own], want["contexts"][w], want["single"][w], s.offset[j].astype(np.int32), s.n[j].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(raw, pa.binary())], names=["gram", "context", "k1", "k2", "contexts", "single", "off", "n", "raw"])

    # copies of a text show the same; a context counts once
    shown = spread_join(keyed, materialise(asked), ["k1", "k2"], copies).select("text", *carry, "k1", "k2", "want").mapInArrow(show, schema)
    found = "gram long, context long, k1 long, k2 long, lo int, hi int"

    def ranges(keys: list[tuple], start: np.ndarray, n: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(n)), n)
        rel = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        first = hit & ~np.r_[False, hit[:-1] & (owner[1:] == owner[:-1])]
        last = hit & ~np.r_[hit[1:] & (owner[1:] == owner[:-1]), False]
        own = owner[first]
        cols = [np.array([keys[i][c] for i in own], np.int64) for c in range(4)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(rel[first].astype(np.int32)), pa.array((rel[last] + 1).astype(np.int32))], names=["gram", "context", "k1", "k2", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            n = np.array([r[6] for r in rows])
            start = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])[:-1]])
            gram = np.unique([r[0] for r in rows], return_inverse=True)[1]
            rel = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            key = np.repeat(gram, n) * length + (np.repeat([r[5] for r in rows], n) - rel)  # the gram and where it stands
            hit = repeated(b"".join(r[7] for r in rows), start, n, key, length)
            return ranges(rows, start, n, hit & np.repeat([r[4] for r in rows], n))

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:2] == last:
                    continue
                if size > SORT_BYTES and r[0] != last[0]:
                    yield flush(held)
                    held, size = [], 0
                last = r[:2]
                held.append(r)
                size += len(r[7])
        if held:
            yield flush(held)

    many = not state.filter(F.col("contexts") > hot).isEmpty()
    shown = materialise(shown) if many else shown  # read twice then
    cool = shown.filter(F.col("contexts") <= hot).drop("contexts")
    parts = cool.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(sort, found)
    if many:
        parts = parts.unionByName(_one_by_one(shown.filter(F.col("contexts") > hot), length, ranges, found))
    part = parts.groupBy("k1", "k2").agg(F.collect_set(F.struct("context", "lo", "hi")).alias("part"))
    return whole.join(part, ["k1", "k2"], "full")


def _one_by_one(shown: DataFrame, length: int, ranges, found: str) -> DataFrame:
    """Grams of very many contexts: their windows spread by a 128-bit digest of their own bytes, are counted with partial
    sums, and those that are met twice come back by a join that spreads hot ones."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, context, k1, k2, _, single, _, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.arange(n)
                bytes_ = np.frombuffer(raw, np.uint8)
                w = [span_hash(prefix(bytes_.astype(np.uint16) + np.uint16(1), base), at, at + length, base).view(np.int64) for base in (BYTE_BASE, BYTE_BASE ^ 0x5DEECE66C)]
                same = [pa.array(np.full(n, x, np.int64)) for x in (gram, context, k1, k2)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, w), *same, pa.array(at.astype(np.int32)), pa.array(np.full(n, single))], names=["w1", "w2", "gram", "context", "k1", "k2", "lo", "single"])

    rows = shown.dropDuplicates(["gram", "context"]).mapInArrow(spread, "w1 long, w2 long, gram long, context long, k1 long, k2 long, lo int, single boolean")
    # a window at two places of one context counts too
    twice = materialise(rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return spread_join(rows.filter("single"), twice, ["w1", "w2"], twice, turn=F.xxhash64("gram", "context", "lo")).select("gram", "context", "k1", "k2", "lo", (F.col("lo") + 1).alias("hi"))


def remove(docs: DataFrame, keep: list[str], length: int = LENGTH, hot: int = HOT_CONTEXTS) -> DataFrame:
    """``keep`` of every row of ``docs`` (text), with n_bytes, spans (start, end in bytes) and kept (binary).

    Every byte under a string of ``length`` bytes that starts anywhere else too, in another row or the same, is removed;
    strings overlap freely and are judged on the input. Rows of one text share their finding, which is joined by the
    text's 128-bit key, so equal rows remove each other wholly if they are long enough. Null is empty; empty and short
    texts lose nothing; very long ones are read piece by piece; nulls in ``keep`` stay, but its columns named n_bytes,
    spans or kept are replaced; an empty table gives an empty table.
    """
    own = Carried(docs, keep, ("n_bytes", "spans", "kept"))
    rows = docs.select("text", *own.take, *text_key(F.col("text")))
    copies = materialise(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS))
    hits = find(rows, own.inner, copies, length, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in slices(b.column(0), PIECE):
                whole, part = (Asked(b.column(b.num_columns - 2 + i).slice(lo, hi - lo)) for i in range(2))
                text, start, end = _merge(*_edges(texts, whole, part, length))
                first = np.searchsorted(text, np.arange(len(texts) + 1))
                kept = [_without(t, start[a:z].tolist(), end[a:z].tolist()) for t, a, z in zip(texts, first[:-1], first[1:], strict=True)]
                spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
                carried = [c.slice(lo, hi - lo) for c in b.columns[1 : 1 + len(own.inner)]]
                yield pa.RecordBatch.from_arrays([*carried, pa.array([len(t) for t in texts], pa.int64()), spans, pa.array(kept, pa.binary())], names=[*own.inner, "n_bytes", "spans", "kept"])

    joined = spread_join(rows, materialise(hits), ["k1", "k2"], copies, "left").select("text", *own.inner, "whole", "part")
    return joined.mapInArrow(cut, f"{own.fields}n_bytes long, spans array<struct<start:long,end:long>>, kept binary").select(*own.back, "n_bytes", "spans", "kept")


def _edges(texts: list[bytes], whole: Asked, part: Asked, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes under the texts' repeated suffixes, as (text, start, end); they may overlap."""
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
    rel = [part[x].astype(np.int64) for x in ("lo", "hi")]
    for group in pieces([t if whole.count[i] or part.count[i] else b"" for i, t in enumerate(texts)], length):
        s = segments(group, length)
        all_ = whole.rows(s.text, s.context)[0] >= 0
        out.append((s.text[all_], s.lo[all_], (s.lo + s.n - 1 + length)[all_]))
        first, end = (x[~all_] for x in part.rows(s.text, s.context))
        j = np.repeat(np.flatnonzero(~all_), end - first)
        at = part.at[np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange(len(j))]
        out.append((s.text[j], s.lo[j] + rel[0][at], s.lo[j] + rel[1][at] - 1 + length))
    text, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
    return text, start, end


def _merge(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's spans in order, those that overlap or touch as one."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    shift = text[order] * (int(end.max()) + 1)  # texts one after another
    a, z = start[order] + shift, np.maximum.accumulate(end[order] + shift)
    new = np.r_[True, a[1:] > z[:-1]]
    last = np.r_[new[1:], True]
    return text[order][new], (a - shift)[new], (z - shift)[last]


def _without(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(text[a:z] for a, z in zip([0, *ends], [*starts, len(text)], strict=True))
