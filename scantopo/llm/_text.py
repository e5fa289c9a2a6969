"""Shared pieces: materialising, text identity, and vectorised word arithmetic over Arrow batches."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Multipliers of the polynomial hashes (odd, so that they have an inverse modulo 2**64).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a temporary one in local mode, as in tests; an error
    elsewhere, as executors wouldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark, "_scantopo_dir", None) or tempfile.mkdtemp(prefix="scantopo-")
        spark._scantopo_dir = named
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared checkpoint folder and cuts its lineage there.

    The shuffles behind it are not needed again; they leave the executors' disks once the driver has collected what
    refers to them, which it would do far too late by itself in a job of many steps.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Rows of one key that a task may read; hottest keys whose rows are spread, at most.
HOT_ROWS, HOT_KEYS = 2_000, 50_000


def fresh(name: str, taken: list[str]) -> str:
    """A column name that begins with ``name`` and isn't among ``taken``, in whatever letter case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


class Carried:
    """Columns that go through an operator under names of its own, ``_c0``, ``_c1``, ..., and come out under theirs.

    Those named like one of ``results`` are left out, as the result's column replaces them.
    """

    def __init__(self, docs: DataFrame, keep: list[str], results: tuple[str, ...] = ()):
        low = {r.lower() for r in results}
        own = [c for c in keep if c.lower() not in low]
        self.inner = [f"_c{i}" for i in range(len(own))]
        self.take = [F.col(f"`{c}`").alias(i) for c, i in zip(own, self.inner, strict=True)]
        self.back = [F.col(i).alias(c) for c, i in zip(own, self.inner, strict=True)]
        self.fields = "".join(f"{i} {f.dataType.simpleString()}, " for i, f in zip(self.inner, docs.select(*self.take).schema, strict=True))

    def __getstate__(self) -> dict:
        return {"inner": self.inner}  # what functions on the executors need


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], counts: DataFrame, how: str = "inner", hot: int = HOT_ROWS, turn: Column | None = None) -> DataFrame:
    """``rows`` joined with ``other``, which has a row a key at most, without a task that reads all rows of a hot key.

    ``counts`` (the key, n) names the rows of at least those keys of ``rows`` that have more than ``hot``. The rows of
    the HOT_KEYS most frequent ones are dealt to as many tasks as they need, and their row of ``other`` goes to each; a
    key beyond those has at most one in HOT_KEYS of all rows. Rows are dealt by ``turn``, a number, or by their order, which
    must then be the same when they are read again.
    """
    most = counts.filter(F.col("n") > hot).orderBy(F.desc("n")).limit(HOT_KEYS)
    most = materialise(most.select(*on, F.ceil(F.col("n") / hot).cast("int").alias("_deal")))
    if most.isEmpty():
        return rows.join(other, on, how)
    most = F.broadcast(most)
    n = F.coalesce("_deal", F.lit(1))
    dealt = rows.withColumn("_turn", F.monotonically_increasing_id() if turn is None else turn).join(most, on, "left").withColumn("_salt", F.pmod("_turn", n).cast("int")).drop("_deal", "_turn")
    each = other.join(most, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_deal")
    return dealt.join(each, [*on, "_salt"], how).drop("_salt")


def text_key(text: Column) -> list[Column]:
    """128 bits of identity of a text, as two longs ``k1`` and ``k2``; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def id_text(doc_id: Column) -> Column:
    """The doc_id as text, as the held-out rules hash it; null counts as empty."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed values), over uint64 with wrap-around."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    z = y >> U(27)
    y ^= z
    y *= U(0x94D049BB133111EB)
    np.right_shift(y, U(31), out=z)
    y ^= z
    return y


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; the longest so far are kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size, out = 1 << max(16, int(n - 1).bit_length()), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, U)
            p[0], k = 1, 1
            while k < size:
                p[k : 2 * k] = p[:k] * U(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums S with ``(S[e] - S[s]) * base**-s`` the polynomial hash of values[s:e]."""
    fwd, _ = powers(base, len(values) + 1)
    s = np.empty(len(values) + 1, U)
    s[0] = 0
    np.multiply(values, fwd[: len(values)], out=s[1:], dtype=U, casting="unsafe")
    np.cumsum(s[1:], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    _, inv = powers(base, len(s))
    return mix64((s[end] - s[start]) * inv[start])


#: Byte classes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: 0 where no word byte stands.
WORD = np.zeros(256, np.uint8)
WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD[0x80:] = np.arange(0x80, 0x100)


def encode(texts: pa.Array | Iterable[str | bytes | None]) -> list[bytes]:
    """Texts as UTF-8, null as empty; a column of Arrow strings is read as it lies, without decoding."""
    if isinstance(texts, pa.Array):
        return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in (b"" if t is None else t for t in texts)]


def ranges(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, so that memory is bounded beyond one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def slices(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """``ranges`` with their texts as UTF-8."""
    for lo, hi in ranges(col, limit):
        yield lo, hi, encode(col.slice(lo, hi - lo))


def parts(batches: Iterable[pa.RecordBatch], column: int = 0, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones of about ``limit`` bytes in a column of texts."""
    for b in batches:
        for lo, hi in ranges(b.column(column), limit):
            yield b.slice(lo, hi - lo)
        del b
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a list of texts: byte spans in one buffer, the text each is of, and 64-bit hashes."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        low = WORD[raw]
        inside = low != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        # self.first[i] is the index of the first word of text i; the last entry is the number of words
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.base, self.sums = BYTE_BASE, prefix(low, BYTE_BASE)
        self.hash = span_hash(self.sums, self.start, self.end, BYTE_BASE) if len(self.start) else np.empty(0, U)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first words of the n-word shingles inside one text, and their hashes."""
        total = len(self.hash)
        if total < n:
            return np.empty(0, np.int64), np.empty(0, U)
        at = np.arange(total - n + 1)
        at = at[self.text[at] == self.text[at + n - 1]]
        return at, span_hash(prefix(self.hash, WORD_BASE), at, at + n, WORD_BASE)

    def words_of(self, lo: int, hi: int) -> list[bytes]:
        return [self.buffer[self.start[i] : self.end[i]].lower() for i in range(lo, hi)]
