"""Approximate nearest neighbours by multiprobe p-stable hashing [operator 9]."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantopo.llm._text import materialise

#: Tables, projections of each, cell width in units of the root mean square norm, buckets visited in each table.
TABLES, PROJECTIONS, WIDTH, PROBES = 4, 8, 2.0, 400
#: Vectors that one block of the index holds, about; hotter buckets are dealt to several blocks.
BLOCK = 12_000
QUERY_BATCH = 64
#: Hot blocks up to which their list is broadcast.
BROADCAST_PARTS = 50_000
#: Rounding of a component in a squared distance by products, as a share of the squared norms: 16 units of the last place.
ERROR = 16 * 2.0**-52
SEED = 20240229


def valid(v: Column) -> Column:
    """Whether a vector takes part: not null or zero, no null or non-finite component."""
    x = F.transform(v, lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda e: e != 0)


@functools.lru_cache(maxsize=4)
def projections(dim: int, tables: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal (2-stable) directions, offsets in [0, 1) cells, and odd multipliers that turn cells into keys."""
    r = np.random.default_rng(SEED)
    return r.standard_normal((tables, dim, k)), r.random((tables, k)), r.integers(0, 2**62, (tables, k)) * 2 + 1


def cells(x: np.ndarray, t: int, width: float, tables: int, k: int) -> np.ndarray:
    """Where vectors fall along the directions of table ``t``, in cells."""
    a, b, _ = projections(x.shape[1], tables, k)
    return x @ a[t] / width + b[t]


def keys(c: np.ndarray, dim: int, t: int, tables: int, k: int) -> np.ndarray:
    return (c * projections(dim, tables, k)[2][t]).sum(-1)


def probe_cells(at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells around ``at`` likeliest to hold a neighbour, likeliest first.

    A move to the next cell costs the squared distance to the border it crosses; sets of moves, of which no two are
    along one direction, come from a heap in order of their sums: a set's successors replace its last move by the next
    dearer one, or add that.
    """
    base, k = np.floor(at).astype(np.int64), len(at)
    inside = at - base
    moves = sorted([(float(inside[i]) ** 2, i, -1) for i in range(k)] + [(float(1 - inside[i]) ** 2, i, 1) for i in range(k)])
    out, heap = [base], [(moves[0][0], (0,))]
    while heap and len(out) < n:
        cost, chosen = heapq.heappop(heap)
        if len({moves[j][1] for j in chosen}) == len(chosen):
            cell = base.copy()
            for j in chosen:
                cell[moves[j][1]] += moves[j][2]
            out.append(cell)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return np.stack(out)


_ROW = "part int, salt int, kind int, id long, vec array<double>, keys array<long>"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
_NAMES = ["part", "salt", "kind", "id", "vec", "keys"]


def _dense(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, tables: int = TABLES, projections_: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean) of the ``k`` nearest rows found for each row where ``queries`` holds.

    ``vectors`` has vec_id and embedding. Each vector goes to one block for each table: the block of its bucket, or one
    of several where a bucket, or what shares its block, holds more than BLOCK vectors. A query goes to each block that
    holds a bucket it probes, with the keys of those; there its distances to the members of these buckets are taken by
    one matrix product, and the nearest again from the differences. A block returns at most ``k`` rows a query (more
    only at equal distance, before ties are cut), so nothing grows with the square of a bucket. Blocks stay in memory,
    queries stream past them. A query that finds fewer than ``k`` in its buckets is held against all blocks of one table.

    Vectors that are null, zero or of null or non-finite components take no part. Vectors of different lengths have no
    distance: those of each length are searched among themselves. Ties go to the smaller vec_id, null last. Rows that
    repeat are rows of their own: only a query's own row is no candidate of it. Further columns, of whatever name, are
    left aside. An empty table, or one vector, gives no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("vec"), queries.alias("q")).filter(valid(F.col("vec")))
    v = materialise(v.withColumn("size", F.size("vec"))).withColumn("id", F.monotonically_increasing_id())
    square = F.sum(F.aggregate("vec", F.lit(0.0), lambda a, e: a + e * e))
    sizes = v.groupBy("size").agg(F.count(F.lit(1)).alias("n"), square.alias("sq"), F.max(F.col("q").cast("int")).alias("q")).filter("q = 1 AND n > 1").orderBy("size").collect()
    out = v.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    for r in sizes:
        found = _nearest(v.filter(F.col("size") == r["size"]), r["size"], r["n"], width * float(np.sqrt(r["sq"] / r["n"])), k, tables, projections_, probes)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def preselect(near: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Indexes that may hold the ``k`` least of the exact distances, of which ``near`` differ by ``slack`` at most."""
    if len(near) <= k or not np.isfinite(near).all():
        return np.arange(len(near))
    return np.flatnonzero(near - slack <= np.partition(near + slack, k - 1)[k - 1])


def _nearest(v: DataFrame, dim: int, total: int, cell: float, k: int, tables: int, projections_: int, probes: int) -> DataFrame:
    """``nearest`` for the ``total`` rows of ``v`` (id, vec_id, vec, q), whose vectors have ``dim`` components."""
    parts = max(1, -(-total // BLOCK))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _dense(b.column(1)), b.num_rows
            for t in range(tables if n else 0):
                key = keys(np.floor(cells(x, t, cell, tables, projections_)).astype(np.int64), dim, t, tables, projections_)
                part = t * parts + (key >> 7) % parts
                one = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), pa.array(key))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), b.column(0), b.column(1), one], names=_NAMES)

    indexed = v.select("id", "vec").mapInArrow(index, _ROW)
    salted = materialise(indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * BLOCK).select("part", F.ceil(F.col("n") / (2 * BLOCK)).cast("int").alias("deal")))
    hot = salted.limit(BROADCAST_PARTS + 1).count()
    salted = F.broadcast(salted) if hot <= BROADCAST_PARTS else salted
    if hot:
        indexed = indexed.drop("salt").join(salted, "part", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("deal")), F.lit(0)).cast("int")).select(*_NAMES)

    def probe(everywhere: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ident, vec in zip(b.column(0).to_pylist(), _dense(b.column(1)) if b.num_rows else (), strict=True):
                    rows = []
                    for t in range(1 if everywhere else tables):
                        if everywhere:
                            by = dict.fromkeys(range(parts))
                        else:
                            key = keys(probe_cells(cells(vec[None], t, cell, tables, projections_)[0], probes), dim, t, tables, projections_)
                            part, by = t * parts + (key >> 7) % parts, {}
                            for p in set(part.tolist()):
                                by[p] = key[part == p].tolist()
                        rows += [(p, 0, 1, ident, vec.tolist(), ks) for p, ks in by.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, x, ids, which, uniq = None, [], None, None, None, None
        for b in batches:
            tag = np.stack([b.column(i).to_numpy() for i in range(3)], 1) if b.num_rows else np.empty((0, 3), int)
            cut = np.flatnonzero(np.any(tag[1:] != tag[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True) if b.num_rows else ():
                rows, (p, s, kind) = b.slice(lo, hi - lo), tag[lo]
                if (p, s) != block:
                    block, held, x = (p, s), [], None
                if kind == 0:
                    held.append((rows.column(3).to_numpy(), _dense(rows.column(4)), rows.column(5).flatten().to_numpy()))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x, key = (np.concatenate(c) for c in zip(*held, strict=True))
                    uniq, which = np.unique(key, return_inverse=True)
                    centre = x.mean(0)  # products of what is left of the centre lose the least
                    off = x - centre
                    norms = (off * off).sum(1)
                q, qid, want = _dense(rows.column(4)), rows.column(3).to_numpy(), rows.column(5).to_pylist()
                for a in range(0, len(q), QUERY_BATCH):
                    qo = q[a : a + QUERY_BATCH] - centre
                    own = (qo * qo).sum(1)
                    near = norms + own[:, None] - 2 * qo @ off.T
                    shift = np.abs(centre).max() ** 2  # what the subtraction rounds off, beside the products
                    out: list[tuple] = []
                    for i, d in enumerate(near, a):
                        ok = ids != qid[i]
                        if want[i] is not None:
                            ok &= np.isin(uniq, want[i])[which]
                        at = np.flatnonzero(ok)
                        at = at[preselect(d[at], k, ERROR * dim * (norms[at] + own[i - a] + shift))]
                        score = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                        if len(at) > k:
                            last = np.partition(score, k - 1)[k - 1]
                            at, score = at[score <= last], score[score <= last]
                        out.append((np.full(len(at), qid[i]), ids[at], score))
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "id", "score"])

    def found(q: DataFrame, everywhere: bool) -> DataFrame:
        side = indexed.filter(F.col("part") < parts) if everywhere else indexed
        asked = q.select("id", "vec").mapInArrow(probe(everywhere), _ROW)
        if hot:
            asked = asked.drop("salt").join(salted, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("deal", F.lit(1)) - 1))).select(*_NAMES)
        n = max(1, min(tables * parts + hot, 4 * v.sparkSession.sparkContext.defaultParallelism))
        dealt = side.unionByName(asked).repartition(n, "part", "salt").sortWithinPartitions("part", "salt", "kind")
        return dealt.mapInArrow(scan, "qid long, id long, score double").distinct()

    asked = v.filter("q")
    hits = materialise(found(asked, False))
    got = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(got, asked["id"] == got["qid"], "left").filter(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select("id", "vec")
    if not short.isEmpty():
        short = materialise(short)
        hits = hits.join(short.select(F.col("id").alias("qid")), "qid", "left_anti").unionByName(found(short, True))
    named = hits.join(v.select("id", "vec_id"), "id").join(v.select(F.col("id").alias("qid"), F.col("vec_id").alias("query_id")), "qid")
    w = Window.partitionBy("qid").orderBy("score", F.col("vec_id").asc_nulls_last(), "id")
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
