"""Benchmark decontamination by a prefix-filtered join of word windows [operator 2]."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantopo.llm._text import Carried, Words, encode, materialise, slices

#: Words of a window and of the shingles by which windows are found.
WINDOW, SHINGLE = 13, 5
#: A document with at least one word in RATIO hit is contaminated.
RATIO = 20
#: Bits of the filters sent to the executors: at least, at most (32 MB, a filter for 30 million shingles), and for each
#: shingle. Beyond that more shingles pass that the join then drops.
FILTER_BITS, MOST_BITS, BITS_EACH = 1 << 22, 1 << 28, 8


def windows(bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id string, words, len, shingles of (h, off, n)) for each window of the items of ``bench`` (item_id, text).

    An item of fewer words than ``window`` is one window, one of fewer than ``shingle`` has itself as its shingle.
    Items without words have none; a null item_id counts as the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(encode(b.column(1)))
            grams = {n: dict(zip(*(x.tolist() for x in w.grams(n)), strict=True)) for n in range(1, shingle + 1)}
            out: list[dict] = []
            for i, item in enumerate(b.column(0).to_pylist()):
                lo, n = int(w.first[i]), int(w.count[i])
                k, s = min(n, window), min(n, shingle)
                for at in range(lo, lo + n - k + 1) if n else ():
                    words = b" ".join(w.words_of(at, at + k)).decode("utf-8", "replace")
                    out.append({"item_id": item, "words": words, "len": k, "shingles": [{"h": _signed(grams[s][at + o]), "off": o, "n": s} for o in range(k - s + 1)]})
            yield pa.RecordBatch.from_pylist(out, _WINDOW)

    return bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").mapInArrow(run, "item_id string, words string, len int, shingles array<struct<h:long,off:int,n:int>>")


_WINDOW = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("len", pa.int32()), ("shingles", pa.list_(pa.struct([("h", pa.int64()), ("off", pa.int32()), ("n", pa.int32())])))])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hash modulo ``bits``: at most bits / 64 numbers reach the driver, however many hashes there are."""
    at = F.pmod(F.col("h"), F.lit(bits))
    rows = hashes.groupBy((at / 64).cast("int").alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(pmod(h, {bits}L), 64L) as int)))").alias("v")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["i"]] = r["v"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def filter_bits(n: int) -> int:
    """Bits of a filter for ``n`` hashes: a power of two."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_EACH * n - 1).bit_length() if n else 0))


def _passing(w: Words, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, h = w.grams(n)
    h = h.view(np.int64)
    ok = bits[h % len(bits)]
    return at[ok], h[ok]


def rarity(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, n): occurrences in all texts of the shingles that pass the filter, summed in each batch first."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for _, _, texts in slices(b.column(0)):
                w = Words(texts)
                h, n = np.unique(np.concatenate([_passing(w, s, own)[1] for s in sizes]), return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, keep: Carried, bits: np.ndarray, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """``keep`` with n_words and occ: where a shingle passes the filter, with the words that a window over it may have."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    occ = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            counts, found = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for lo, hi, texts in slices(b.column(0)):
                w = Words(texts)
                counts[lo:hi] = w.count
                for s in sizes:
                    for at, h in zip(*(x.tolist() for x in _passing(w, s, own)), strict=True):
                        i = int(w.text[at])
                        first, end = int(w.first[i]), int(w.first[i + 1])
                        a, z = max(first, at - window + s), min(end, at + window)
                        found[lo + i].append({"h": h, "pos": at - first, "lo": a - first, "words": b" ".join(w.words_of(a, z)).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts), pa.array(found, occ)], names=[*keep.inner, "n_words", "occ"])

    return docs.select(F.col("text").alias("_text"), *keep.take).mapInArrow(run, f"{keep.fields}n_words long, occ array<struct<h:long,pos:int,lo:int,words:string>>")


def covered(spans: Column) -> Column:
    """Words under the union of spans of (start, len)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"].cast("long"))


def find(docs: DataFrame, bench: DataFrame, keep: list[str], window: int = WINDOW, shingle: int = SHINGLE, ratio: int = RATIO) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text), with n_words, n_hit, items and contaminated.

    A window occurs only where all of its shingles do, so one is enough to find it (the necessary prefix at full
    containment): the rarest, by its count in all of ``docs``; windows whose rarest shingle is nowhere are dropped. Two
    passes over the texts, each keeping only shingles that pass a filter of fixed size: the first counts, the second
    keeps places with the words around them, materialised with the narrow columns. These meet the windows in a join by
    shingle; a pair stays if the window lies within the document by position and length and its words are the same.
    No text is shuffled, and a row's hits are grouped by a row number, so that copies don't meet.

    Null and empty texts have no words and aren't contaminated; very long ones are read whole; nulls in ``keep`` stay,
    but its columns named like one of the result's are replaced; rows that repeat are judged each; an empty benchmark
    hits nothing; an empty ``docs`` gives an empty table.
    """
    own = Carried(docs, keep, ("n_words", "n_hit", "items", "contaminated"))
    wins = materialise(windows(bench, window, shingle))
    each = wins.select("*", F.explode("shingles").alias("s")).select("item_id", "words", "len", "s.h", "s.off", "s.n")
    sizes = sorted(r["n"] for r in each.select("n").distinct().collect())  # of 1 to ``shingle`` words
    if sizes:
        counts = rarity(docs, bit_filter(each, filter_bits(each.count())), sizes)
        best = F.min_by(F.struct("h", "off"), F.struct("c", "h", "off"))
        index = each.join(counts.withColumnRenamed("n", "c"), "h").groupBy("item_id", "words", "len").agg(best.alias("b"), F.count_distinct("off").alias("m"), F.max(F.col("len") - F.col("n") + 1).alias("all"))
        index = materialise(index.filter("m = all").select("item_id", "words", "len", "b.h", "b.off"))
        bits = bit_filter(index, filter_bits(index.count()))
    else:
        bits = np.zeros(FILTER_BITS, bool)
    rows = materialise(occurrences(docs, own, bits, sizes, window)).withColumn("_row", F.monotonically_increasing_id())
    none = F.lit(0).cast("long")
    if not sizes:
        return rows.select(*own.back, "n_words", none.alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    occ = rows.select("_row", "n_words", F.explode("occ").alias("o")).select("_row", "n_words", "o.*")
    start = F.col("pos") - F.col("off")
    pairs = occ.join(index.withColumnRenamed("words", "w"), "h").filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("words", " "), start - F.col("lo") + 1, F.col("len")), " ") == F.col("w")
    hits = pairs.filter(same).groupBy("_row").agg(F.collect_set(F.struct(start.alias("start"), F.col("len").alias("len"))).alias("spans"), F.collect_set("item_id").alias("items"))
    hits = hits.select("_row", covered(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items"))
    n = F.coalesce("n_hit", none)
    return rows.drop("occ").join(hits, "_row", "left").select(
        *own.back, "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n > 0) & (ratio * n >= F.col("n_words"))).alias("contaminated")
    )


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)
), h AS (
  SELECT r, i, g.k AS k, item FROM g JOIN v ON g.s = v.s AND g.k = v.k
), n AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
