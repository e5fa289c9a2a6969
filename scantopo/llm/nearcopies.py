"""Near-duplicate classes by BagMinHash signatures, bands and exact verification [operator 7]."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantopo.llm._text import Carried, U, Words, fresh, materialise, mix64, slices, spread_join, text_key
from scantopo.llm.decontaminate import bit_filter

#: Words of a shingle; similarity of multisets of shingles from which texts are linked.
SHINGLE, SIMILAR = 5, Fraction(4, 5)
#: Bands and components of each: at similarity 0.8 all bands differ once in 300,000 pairs.
BANDS, ROWS = 32, 5
#: Components of a signature that must agree for a pair to be verified: 5 standard deviations under 0.8.
AGREE = 0.64
#: Members of a bucket outside its largest component beyond which they meet by their rarest elements, if that is less
#: work. Either way all pairs that are similar enough meet.
MANY = 512
#: Bins in which elements are counted to tell the rarest, and how many of them are summed in one row.
BINS, CHUNK = 1 << 20, 1 << 12
#: Members of a bucket compared in one block; larger buckets are compared block by block.
BLOCK = 512
#: Members of a bucket beyond which blocks of signatures grow with the root of its size, so that a row isn't copied into
#: too many tiles. All members are compared in any case.
LARGE = 8_192


def bag(w: Words, n: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each of ``n`` texts; fewer words than a shingle are one."""
    at, h = w.grams(shingle)
    text = w.text[at]
    for size in range(1, shingle):
        short = np.flatnonzero(w.count == size)
        if len(short):
            at, g = w.grams(size)
            own = w.count[w.text[at]] == size
            text, h = np.concatenate([text, w.text[at[own]]]), np.concatenate([h, mix64(g[own] + U(size))])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if not len(h):
        return text, h, np.empty(0, np.int64)
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])])
    return text[new], h[new], np.diff(np.r_[new, len(h)])


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: ``m`` values for each of ``n`` multisets; two agree in one with the weighted Jaccard similarity.

    An element of weight w has the points of a Poisson process over time and weight up to w, for each component. Weights
    are whole, and cut into (0, 1], (1, 2], (2, 4], (4, 8], ...: each stretch has a process of its own, of a rate equal
    to its length for every component, so an element takes as many as its weight has binary digits. A point is drawn
    with its component and its level; one above w isn't the element's. Points come in order of time, for all elements
    side by side, and an element stops once its time exceeds the latest first point of its text. A component's value is
    the time of its first point: the same in two texts just if the point is in both and first in both.
    """
    own = np.arange(len(h))
    rows, base, size = [own], [np.zeros(len(h))], [np.ones(len(h))]
    b = 1
    while len(own := own[weight[own] > b]):
        rows.append(own)
        base.append(np.full(len(own), float(b)))
        size.append(np.full(len(own), float(b)))
        b *= 2
    row, base, size = np.concatenate(rows), np.concatenate(base), np.concatenate(size)
    seed = mix64(h[row] + base.astype(U) * U(0xA24BAED4963EE407))
    doc, w = text[row], weight[row].astype(np.float64)
    first = np.full(n * m, np.inf)
    time, step = np.zeros(len(row)), 0
    while len(row):
        r = mix64(seed + U(step * 0x9E3779B97F4A7C15 % 2**64))
        s = mix64(r ^ U(0xC2B2AE3D27D4EB4F))
        time = time - np.log(((r >> U(11)).astype(np.float64) + 1) * 2.0**-53) / (m * size)
        part = (((s >> U(32)) * U(m)) >> U(32)).astype(np.int64)
        level = base + np.floor((s & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size) + 1
        ok = level <= w
        np.minimum.at(first, doc[ok] * m + part[ok], time[ok])
        step += 1
        if len(row) > 4096 or step % 8 == 0:
            live = time < first.reshape(n, m).max(1)[doc]
            row, seed, doc, w, time, base, size = (x[live] for x in (row, seed, doc, w, time, base, size))
    return mix64(first.view(U)).reshape(n, m)


def multiset_keys(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of identity of each multiset, as two sums over its elements, and its size."""
    out = []
    for salt in (1, 2):
        k = np.zeros(n, U)
        np.add.at(k, text, mix64(h ^ mix64(weight.astype(U) * U(2) + U(salt))))
        out.append(k.view(np.int64))
    size = np.zeros(n, np.int64)
    np.add.at(size, text, weight)
    return out[0], out[1], size


def sketch(docs: DataFrame, keep: Carried) -> DataFrame:
    """``keep`` with the text's key k1, k2, the multiset's key m1, m2 and size, band keys and a 16-bit signature.

    A text without words has its own key as its multiset's, and no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in slices(b.column(0)):
                n = hi - lo
                w = Words(texts)
                text, h, weight = bag(w, n)
                m1, m2, size = multiset_keys(text, h, weight, n)
                k1, k2 = (b.column(i).slice(lo, n).to_numpy() for i in (1, 2))
                none = size == 0
                m1, m2 = np.where(none, k1, m1), np.where(none, k2, m2)
                sig = signatures(text, h, weight, n)
                keys = np.zeros((n, BANDS), U)
                for r in range(ROWS):
                    keys = mix64(keys + sig[:, r::ROWS] + U(r))
                keys = mix64(keys + np.arange(BANDS, dtype=U)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(ends, pa.array(keys[~none].ravel()))
                small = (sig & U(0xFFFF)).astype(np.uint16)
                cols = [pa.array(m1), pa.array(m2), pa.array(size), bands, pa.array([x.tobytes() for x in small], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, n) for c in b.columns[3:]], pa.array(k1), pa.array(k2), *cols], names=[*keep.inner, "k1", "k2", "m1", "m2", "size", "bands", "sig"])

    head = docs.select(F.col("text").alias("_text"), *[k.alias(f"_{n}") for n, k in zip(("k1", "k2"), text_key(F.col("text")), strict=True)], *keep.take)
    return head.mapInArrow(run, f"{keep.fields}k1 long, k2 long, m1 long, m2 long, size long, bands array<long>, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of the component of each node in ``edges`` (a, b).

    Alternating large and small stars: each step hangs a node's neighbours on the least of them. Least neighbours are
    grouped minima and come back by a join, so the neighbours of one node needn't meet in a task.
    """
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialise(small.select("x.u", "x.v").filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = now


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, bag): sorted hashes of the elements of the multisets of ``wanted`` (node, k1, k2), each element as often
    as it occurs under another hash. Only texts that pass a filter of fixed size are turned into bags and shuffled."""
    bits = bit_filter(wanted.select(F.col("k1").alias("h")), 1 << 23)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            ok = np.flatnonzero(own[b.column(1).to_numpy() % len(own)])
            b = b.take(pa.array(ok))
            for lo, hi, texts in slices(b.column(0)):
                text, h, weight = bag(Words(texts), hi - lo)
                turn = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                text, h = np.repeat(text, weight), mix64(np.repeat(h, weight) + turn.astype(U) * U(0x9E3779B97F4A7C15))
                order = np.lexsort((h, text))
                ends = np.searchsorted(text, np.arange(hi - lo + 1))
                h = h[order]
                cols = [b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "bag"])

    found = docs.select("text", *text_key(F.col("text"))).mapInArrow(run, "k1 long, k2 long, bag binary")
    return found.groupBy("k1", "k2").agg(F.first("bag").alias("bag")).join(wanted, ["k1", "k2"]).select("node", "bag")


def similar(a: np.ndarray, b: np.ndarray, least: Fraction = SIMILAR) -> bool:
    """Whether two bags, as sorted hashes, have a weighted Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) * least.denominator < max(len(a), len(b)) * least.numerator:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


def verify(pairs: DataFrame, has: DataFrame, least: Fraction = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose bags in ``has`` (node, bag) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), least) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(has.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(has.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def tiles(rows: DataFrame, block: int, *payload: str, large: int | None = None) -> DataFrame:
    """(key, i, j, mine, node, comp, payload): the rows of each bucket (key, n) dealt to pairs of its blocks, so that
    every two rows meet in a tile, and a large bucket is many tasks' work.

    Where rows have ``main`` and ``rest`` (see ``mains``), rows of the main component don't meet each other. Blocks of
    buckets of more than ``large`` rows are larger by the root of n / large."""
    wide = F.lit(float(block)) if large is None else block * F.sqrt(F.greatest(F.col("n") / large, F.lit(1.0)))
    main, rest = (F.col("main"), F.col("rest")) if "rest" in rows.columns else (F.lit(False), F.col("n"))
    cut, more = F.greatest(F.ceil(rest / wide), F.lit(1)).cast("int"), F.greatest(F.ceil((F.col("n") - rest) / wide), F.lit(0)).cast("int")
    turn = F.xxhash64("node")
    rows = rows.select("key", "node", "comp", *payload, main.alias("main"), cut.alias("cut"), more.alias("more"))
    rows = rows.withColumn("mine", F.when(F.col("main"), F.col("cut") + F.pmod(turn, F.greatest("more", F.lit(1)))).otherwise(F.pmod(turn, F.col("cut"))).cast("int"))
    last = F.col("cut") - 1 + F.when(F.col("main"), 0).otherwise(F.col("more"))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.least(i, F.col("mine")).alias("i"), F.greatest(i, F.col("mine")).alias("j")))
    dealt = rows.select("key", "node", "comp", *payload, "mine", F.explode(each).alias("t")).select("key", "t.i", "t.j", "mine", "node", "comp", *payload)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each tile: key, which of them are of its first and second block, nodes, components, payloads."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and r[:3] != held[0][:3]:
                yield _tile(held)
                held = []
            held.append(r)
    if held:
        yield _tile(held)


def _tile(rows: list[tuple]) -> tuple:
    key, i, j, mine, node, comp, load = (list(x) for x in zip(*rows, strict=True))
    mine = np.array(mine)
    return key[0], np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0]), np.array(node, np.int64), np.array(comp, np.int64), load


def promising(rows: DataFrame, agree: float = AGREE, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """(key, node) of members of (key, n, node, comp, sig) whose signature agrees enough, and in a whole band, with one of
    another component in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, left, right, node, comp, sig in _by_tile(batches):
            s, hit = np.frombuffer(b"".join(sig), np.uint16).reshape(len(node), -1), np.zeros(len(node), bool)
            for x in left:
                y = right[comp[right] != comp[x]]
                y = y[(s[y] == s[x]).mean(1) >= agree] if len(y) else y
                y = y[(s[y] == s[x]).reshape(len(y), BANDS, ROWS).all(2).any(1)] if len(y) else y
                hit[y] = True
                hit[x] |= len(y) > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), key, np.int64)), pa.array(node[hit])], names=["key", "node"])

    return tiles(rows, block, "sig", large=large).mapInArrow(run, "key long, node long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Elements in common of each bag of ``left`` with each of ``right``, as a product of incidence matrices."""
    lo, ro = (np.repeat(np.arange(len(x)), [len(b) for b in x]) for x in (left, right))
    lt, rt = (np.concatenate(x) if x else np.empty(0, U) for x in (left, right))
    both = np.intersect1d(lt, rt)
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(both), width):
        own = both[a : a + width]
        m = []
        for t, o, n in ((lt, lo, len(left)), (rt, ro, len(right))):
            at = np.minimum(np.searchsorted(own, t), len(own) - 1)
            ok = own[at] == t
            x = np.zeros((n, len(own)), np.float32)
            x[o[ok], at[ok]] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def across(rows: DataFrame, least: Fraction = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Links between components, from (key, n, node, comp, bag): in each tile every pair of different components is
    verified by the exact size of its overlap; of the pairs that are similar enough, those come out that join components
    not joined yet in the tile, fewer than it has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right, node, comp, load in _by_tile(batches):
            bag_of = [np.frombuffer(x, U) for x in load]
            size = np.array([len(x) for x in bag_of])
            both = overlaps([bag_of[x] for x in left], [bag_of[x] for x in right])
            near = both * least.denominator >= (size[left][:, None] + size[right] - both) * least.numerator
            x, y = np.nonzero(near & (comp[left][:, None] != comp[right]))
            root: dict[int, int] = {}

            def find(c: int, root: dict[int, int] = root) -> int:
                while (up := root.get(c, c)) != c:
                    c = up
                return c

            out = []
            for a, b in zip(left[x].tolist(), right[y].tolist(), strict=True):
                p, q = find(int(comp[a])), find(int(comp[b]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(node[a]), int(node[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return tiles(rows, block, "bag").mapInArrow(run, "a long, b long").distinct()


def paired(rows: DataFrame) -> DataFrame:
    """The rows (key, node, comp) of buckets of any size that hold several components, with n: all members of one, so that
    pairs meet that share one bucket alone. One of the buckets with the same members."""
    torn = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("set"), F.count(F.lit(1)).alias("n"))
    torn = materialise(torn.filter("x <> y").groupBy("set", "n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    return spread_join(rows.select("key", "node", "comp"), torn, ["key"], torn).select("key", "n", "node", "comp")


def levels(bags: DataFrame, bins: int = BINS) -> np.ndarray:
    """For each bin of hashes the binary digits of the number of elements of ``bags`` (bag) in it. Tasks send sums of
    whole bins, and a byte a bin reaches the driver, however many elements there are."""
    chunk = min(CHUNK, bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(n, (np.frombuffer(x.as_buffer(), U) & U(bins - 1)).view(np.int64), 1)
        own = np.flatnonzero(n.reshape(-1, chunk).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x.tobytes() for x in n.reshape(-1, chunk)[own]], pa.binary())], names=["at", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n[at] = n.get(at, 0) + np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([np.frexp(x.astype(float))[1].astype(np.uint8).tobytes() for x in n.values()], pa.binary())], names=["at", "n"])

    out = np.zeros((bins // chunk, chunk), np.uint8)
    for r in bags.mapInArrow(count, "at long, n binary").repartition("at").mapInArrow(total, "at long, n binary").collect():
        out[r["at"]] = np.frombuffer(r["n"], np.uint8)
    return out.ravel()


def rarest(bags: DataFrame, least: Fraction = SIMILAR, bins: int = BINS) -> DataFrame:
    """Buckets (key, n, node, comp) of the nodes of ``bags`` (node, comp, bag) by elements they share, in which any two
    of different components meet whose bags are similar enough.

    Such bags share ``least`` of the elements of each. With all elements in one order, both then hold one of those they
    share among their first, if these are one more than the others may be missing. Any order does; rare elements come
    first here by the counts of bins, so that what many texts have in common brings few of them together.
    """
    shared = bags.sparkSession.sparkContext.broadcast(levels(bags.select("bag"), bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            keys, of, held = [], [], 0
            for i, x in enumerate(b.column(2)):
                h = np.frombuffer(x.as_buffer(), U)
                first = len(h) + 1 + -len(h) * least.numerator // least.denominator
                keys.append(h[np.argsort(level[h & U(bins - 1)], kind="stable")[:first]])  # h is sorted
                of.append(np.full(len(keys[-1]), i))
                held += first
                if held > 1 << 20 or i + 1 == len(b):
                    at = pa.array(np.concatenate(of))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["key", "node", "comp"])
                    keys, of, held = [], [], 0

    return paired(materialise(bags.select("node", "comp", "bag").mapInArrow(run, "key long, node long, comp long")))


def pairs(rows: DataFrame) -> float:
    """Pairs of members that don't both belong to the main component, in all buckets (key, n, rest, ...) of ``mains``."""
    return rows.agg(F.sum(F.col("rest") * (F.col("n") - F.col("rest") / 2) / F.col("n"))).collect()[0][0] or 0.0


def mains(rows: DataFrame) -> DataFrame:
    """The rows (key, n, node, comp) of buckets with ``main``, whether a row is of the component with most rows in its
    bucket, and ``rest``, how many rows are of others."""
    size = materialise(rows.groupBy("key", "n", "comp").agg(F.count(F.lit(1)).alias("m")))
    most = materialise(size.groupBy("key", "n").agg(F.max(F.struct("m", F.col("comp").alias("top"))).alias("x")).select("key", "n", "x.top", (F.col("n") - F.col("x.m")).alias("rest")))
    told = spread_join(rows.drop("n"), most, ["key"], most.select("key", "n"))
    return told.select("key", "n", "node", "comp", (F.col("comp") == F.col("top")).alias("main"), "rest")


def classes(docs: DataFrame, keep: list[str], large: int = MANY) -> DataFrame:
    """``keep`` of every row of ``docs`` (text), with k1, k2 (the text's key) and near_class, a number that rows share
    just if their texts are linked by chains of pairs of similarity SIMILAR or more.

    Rows of one multiset are one node. Buckets of nodes that share a band are first spanned by a star: each member
    against the least node. Verified pairs make components. Buckets that then still hold several components are compared
    in full across these, block by block: first by signatures, to find the members with a likely partner, then those
    exactly, by matrix products of their bags. Buckets of any size are compared so, without the pairs within the largest
    component. Members of buckets with over ``large`` outside that one meet by their rarest elements instead, if that
    makes fewer pairs: all that are similar enough still meet. So no bucket's pairs are listed and none is cut off, and
    a link is missed only where all bands or far too many components differ by chance, whatever the size of the input.

    Texts without words are linked to equal texts alone. Null counts as empty; very long texts are read whole. Nulls in
    ``keep`` stay, but its columns named k1, k2 or near_class are replaced; rows that repeat are of one class; an empty
    table gives an empty table.
    """
    kept = Carried(docs, keep, ("k1", "k2", "near_class"))
    rows = materialise(sketch(docs, kept))
    nodes = rows.withColumn("_row", F.monotonically_increasing_id()).groupBy("m1", "m2")
    nodes = materialise(nodes.agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("n"), F.first(F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1"))
    members = materialise(spread_join(banded, buckets, ["key"], buckets))
    star = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    wanted = members.select("node").distinct().join(nodes.select("node", "k.k1", "k.k2"), "node")
    has = materialise(bags(docs, materialise(wanted)))
    links = materialise(verify(star, has))
    comp = components(links)
    where = materialise(members.select("key", "n", "node").join(comp, "node", "left").select("key", "n", "node", F.coalesce("comp", "node").alias("comp")))
    left = materialise(mains(materialise(paired(where))))
    many = left.filter(F.col("rest") > large)
    if not many.isEmpty():
        shared = materialise(mains(materialise(rarest(materialise(many.select("node", "comp").distinct().join(has, "node"))))))
        if pairs(shared) < pairs(many):
            left = left.filter(F.col("rest") <= large).unionByName(shared)
    some = materialise(promising(left.join(nodes.select("node", "sig"), "node").select("key", "n", "node", "comp", "main", "rest", "sig")))
    if not some.isEmpty():
        n = materialise(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        likely = materialise(left.drop("n").join(some, ["key", "node"]))
        rest = spread_join(likely, n, ["key"], n).join(has, "node")
        more = materialise(across(rest.select("key", "n", "node", "comp", "bag")))
        if not more.isEmpty():
            comp = components(links.unionAll(more))
    named = nodes.select("m1", "m2", "node", "n").join(comp, "node", "left").select("m1", "m2", "n", F.coalesce("comp", "node").alias("near_class"))
    told = spread_join(rows.select(*kept.inner, "k1", "k2", "m1", "m2"), materialise(named).drop("n"), ["m1", "m2"], nodes.select("m1", "m2", "n"))
    return told.select(*kept.back, "k1", "k2", "near_class")


def keep_first(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """``docs`` without all but one row of each class: that of the least ``by`` (null last), then of the least text key.

    All columns are kept, whatever their names; rows that repeat, with the same ``by`` and text, count as one, and any
    of them stays. Null texts count as empty; an empty table gives an empty table.
    """
    at = [fresh(f"_{n}", docs.columns) for n in ("by", "k1", "k2")]
    c = materialise(classes(docs.select(F.col(f"`{by}`").alias("by"), "text"), ["by"]))
    rank = F.struct(F.col("by").isNull().alias("z"), "by", "k1", "k2")
    first = materialise(c.groupBy("near_class").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")))
    ranked = spread_join(c, first.drop("n"), ["near_class"], first.select("near_class", "n"))
    gone = ranked.filter(rank != F.col("first")).select(*[F.col(n).alias(a) for n, a in zip(("by", "k1", "k2"), at, strict=True)]).distinct()
    keyed = docs.withColumns(dict(zip(at[1:], text_key(F.col("text")), strict=True)))
    same = F.col(f"`{by}`").eqNullSafe(gone[at[0]]) & (keyed[at[1]] == gone[at[1]]) & (keyed[at[2]] == gone[at[2]])
    kept = keyed.join(gone, same, "left_anti")
    if not c.groupBy("by", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # a row stands there twice
        kept = kept.dropDuplicates([by, *at[1:]])
    return kept.select(*[f"`{x}`" for x in docs.columns])
