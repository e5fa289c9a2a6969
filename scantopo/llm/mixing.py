"""Mixing sources to target weights by systematic sampling [operator 5]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantopo.llm._text import Carried

#: Share of a source by its place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
CAP = 3
SEED = "mix-1"
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key of a source that orders by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(skey, source_size) -> with target: the water level at which capped shares add up to the total size.

    One row a source, so its windows over all rows see an aggregate, never documents. Level i supposes that the i
    sources that fill first are full; the first level that does not overfill the next source is the right one.
    """
    every = Window.orderBy("skey")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("full") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(total).cast("double") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    fits = F.col("level") * F.col("w") <= F.col("full")
    s = s.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct(F.col("full") / F.col("w"), F.col("skey")))).over(total))
    return s.select("skey", "source_size", F.least(F.col("full"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, size: Column, order: Column, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """All rows of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    A source's rows stand in order of size, then of the digest of ``order``; each expects target/source_size copies.
    The prefix sum of these, plus one offset of the source in [0, 1), is copied once for each integer it crosses, so a
    row has the floor or the ceiling of its expectation (never over ``cap``), and rows of like size are thinned evenly:
    taken words stay near the target. Ranks come from counts of (source, size, first digest byte) cells: a source that
    holds a third of all rows, or one size or id that does, is spread over 256 cells, and no window sees more than one cell.

    Rows with null source form the last source. Null or empty texts have size 0 and take 0 words. Rows that repeat are
    rows of their own; ``order`` should tell texts apart, so that ties are between equal rows. An empty table gives an
    empty table. Columns of ``docs`` are kept as they are, whatever their names, but for those named like the four of
    the result, which are replaced.
    """
    own = Carried(docs, docs.columns, RESULTS)
    b = docs.select(*own.take, size.alias("mix_size"), source_key(F.col("source")).alias("mix_s"), F.md5(order).alias("mix_k")).withColumn("mix_b", F.substring("mix_k", 1, 2))
    cell = b.groupBy("mix_s", "mix_size", "mix_b").agg(F.count(F.lit(1)).alias("n"))
    by_size = cell.groupBy("mix_s", "mix_size").agg(F.sum("n").alias("n"))
    earlier = lambda *p: Window.partitionBy(*p[:-1]).orderBy(p[-1]).rowsBetween(Window.unboundedPreceding, -1)
    base = by_size.select("mix_s", "mix_size", F.coalesce(F.sum("n").over(earlier("mix_s", "mix_size")), F.lit(0)).alias("mix_base"))
    cell = cell.withColumn("at", F.coalesce(F.sum("n").over(earlier("mix_s", "mix_size", "mix_b")), F.lit(0))).join(base, ["mix_s", "mix_size"])
    sums = by_size.groupBy(F.col("mix_s").alias("skey")).agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size"))
    goal = targets(sums, weights, cap).select(F.col("skey").alias("mix_s"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    cell = cell.join(goal, "mix_s").select("mix_s", "mix_size", "mix_b", (F.col("at") + F.col("mix_base")).alias("mix_before"), "mix_source_size", "mix_target")
    rank = F.row_number().over(Window.partitionBy("mix_s", "mix_size", "mix_b").orderBy("mix_k"))
    out = b.withColumn("mix_rank", rank).join(cell, ["mix_s", "mix_size", "mix_b"])
    each = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit(seed), F.col("mix_s")))
    k = (F.col("mix_before") + F.col("mix_rank")).cast("double")
    copies = F.floor(offset + each * k) - F.floor(offset + each * (k - 1))
    return out.withColumn("mix_copies", copies.cast("long")).select(*own.back, *RESULTS)


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 1 in column ``copy``, which replaces one of that name; rows without a copy
    go, and the columns that ``mix`` added."""
    own = Carried(mixed, mixed.columns, (*RESULTS, "copy"))
    out = mixed.filter("mix_copies > 0").select(*own.take, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("_copy"))
    return out.select(*own.back, F.col("_copy").alias("copy"))


def tie_broken(doc_id: Column, text: Column) -> Column:
    """What rows of one size are ordered by, as a digest: the doc_id, then the text; nulls count as empty."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {table}
), a AS (
  SELECT s, sum(size) AS z, CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY s
), f AS (
  SELECT s, z, w, z * 3.0::DOUBLE AS c, (z * 3.0::DOUBLE) / w AS r FROM a
), g AS (
  SELECT *, (CAST(sum(z) OVER () AS DOUBLE) - coalesce(sum(c) OVER b, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS l
  FROM f WINDOW b AS (ORDER BY r, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT arg_min(l, struct_pack(r := r, s := s)) AS l FROM g WHERE l * w <= c
), t AS (
  SELECT g.s, CAST(g.z AS BIGINT) AS source_size, least(g.c, h.l * g.w) AS target,
         CAST(CAST('0x' || substr(md5('mix-1' || g.s), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM g, h
), n AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
         CAST(row_number() OVER (PARTITION BY s ORDER BY size, k) AS DOUBLE) AS i FROM d JOIN t USING (s)
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(u + e * i) - floor(u + e * (i - 1))) AS BIGINT) AS taken FROM n
"""
