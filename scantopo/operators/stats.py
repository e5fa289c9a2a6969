"""Information, purity and binning of features by class; flags, reasons, null models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_frequency(df: DataFrame, by: list[str], value: str, bins: int = 16) -> DataFrame:
    """``df`` with bin: the rank of the value among distinct ones, if there are at most ``bins``; else how many of the
    percentiles i / bins lie strictly below it."""
    q = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    a = df.groupBy(*by).agg(F.count_distinct(value).alias("_n"), F.percentile(value, q).alias("_q"))
    with_a = lambda x: x.join(a, by) if by else x.crossJoin(F.broadcast(a))
    few = with_a(df).filter(F.col("_n") <= bins).select(*by, value).distinct()  # at most ``bins`` values of a group are ranked
    d = few.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy(value)) - 1)
    j = with_a(df).join(d, [*by, value], "left")
    below = F.size(F.filter("_q", lambda e: e < F.col(value)))
    return j.withColumn("bin", F.when(F.col("_n") <= bins, F.col("_r")).otherwise(below)).drop("_n", "_q", "_r")


def entropy_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, h): entropy in bits of counts n."""
    w = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return w.select(*by, (F.log2("t") - F.col("s") / F.col("t")).alias("h"))


def information(df: DataFrame, by: list[str], label: str, *bins: str) -> DataFrame:
    """(by, mi, ceiling): mutual information of the joint of ``bins`` with the label, as a share of the label's entropy
    (0 if that is 0), and the joint's entropy as such a share."""
    n = F.count(F.lit(1)).alias("n")
    joint = entropy_of(df.groupBy(*by, label, *bins).agg(n), by).withColumnRenamed("h", "hxy")
    x, y = entropy_of(df.groupBy(*by, *bins).agg(n), by).withColumnRenamed("h", "hx"), entropy_of(df.groupBy(*by, label).agg(n), by).withColumnRenamed("h", "hy")
    j = joint.join(x, by).join(y, by) if by else joint.crossJoin(x).crossJoin(y)
    share = lambda v: F.when(F.col("hy") > 0, v / F.col("hy")).otherwise(0.0)
    return j.select(*by, share(F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy"))).alias("mi"), share(F.col("hx")).alias("ceiling"))


def at_index(df: DataFrame, by: list[str], value: str, **index: Column) -> DataFrame:
    """(by, n, and a column for each of ``index``): the sorted value at that place, from 0, an expression on the column n of
    their number. Distinct values are counted first, so a window sees each once and no group is collected."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    c = c.withColumns({"_to": F.sum("_k").over(Window.partitionBy(*by).orderBy(value)), "n": F.sum("_k").over(Window.partitionBy(*by))})
    return c.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("_to") > at, F.col(value))).alias(name) for name, at in index.items()])


def convexity(df: DataFrame, value: str, label: str, low: float = 0.1, high: float = 0.9, least: int = 2) -> DataFrame:
    """(label, purity): of all samples between a class's order statistics at floor((n - 1) p), the share that are its own."""
    at = lambda p: F.floor((F.col("n") - 1) * p)
    bound = at_index(df, [label], value, lo=at(low), hi=at(high)).filter(F.col("n") >= least).select(F.col(label).alias("class"), "lo", "hi")
    counts = df.groupBy(label, value).agg(F.count(F.lit(1)).alias("_k"))  # equal samples meet the classes once
    hit = counts.join(bound, (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))  # Spark broadcasts the classes if they are few
    own = F.sum(F.when(F.col(label) == F.col("class"), F.col("_k")).otherwise(0))
    return hit.groupBy("class").agg((own / F.sum("_k")).alias("purity"))


def flag(distance: Column, delta: Column, stable: Column, noise: float = 7, noise_delta: float = 2) -> Column:
    """Findings in order of precedence."""
    return F.when(distance == 0, "clean").when(delta > noise_delta, "component").when(distance <= noise, "noise").when(stable, "stable").otherwise("weak")


def order_statistic(df: DataFrame, by: list[str], value: str, index: Column) -> DataFrame:
    """The sorted value at ``index`` (from 0, on the column n of their number; 0 at least) of each group."""
    return at_index(df, by, value, _v=F.greatest(F.lit(0), index)).select(*by, F.col("_v").alias(value))


def quarantine(df: DataFrame, doc: str, overlap: str, limit: float) -> DataFrame:
    """(status, reason, docs, rows): whole documents dropped for their greatest overlap, beside those measured."""
    d = df.groupBy(doc).agg(F.max(overlap).alias("m"), F.count(F.lit(1)).alias("rows"))
    why = F.when(F.col("m").isNull(), "nothing to measure").when(F.col("m") > limit, "overlap").otherwise("")
    d = d.withColumns({"reason": why, "status": F.when(why == "", "measured").otherwise("dropped")})
    return d.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows"))


def enrichment(df: DataFrame, by: str, hit: Column, null: Column) -> DataFrame:
    """(by, rate, null_rate, lift): the pooled rate of ``hit`` against that of the null model."""
    a = df.groupBy(by).agg(F.avg(hit.cast("double")).alias("rate"), F.avg(null.cast("double")).alias("null_rate"))
    return a.withColumn("lift", F.try_divide("rate", "null_rate"))


def grid_tally(df: DataFrame, grid: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """Counts of each condition for each row of a parameter grid, which is small by nature and is broadcast."""
    names = grid.columns
    return df.crossJoin(F.broadcast(grid)).groupBy(*names).agg(*[F.count_if(c).alias(k) for k, c in hits.items()])


def share_of_classes(df: DataFrame, family: str, kind: str, weight: Column) -> DataFrame:
    """Instance-weighted counts by class and by family and class, in one pass over grouping sets."""
    return df.groupingSets([[kind], [family, kind]], family, kind).agg(F.sum(weight).alias("n"), F.grouping(family).cast("int").alias("all_families"))
