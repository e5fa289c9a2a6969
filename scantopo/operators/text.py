"""Words of marked-up text, alignment of words, names and numbers in paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is removed from TeX, in order: comments, formulas, commands with their options, braces, space.
TEX = ((r"%[^\n]*", ""), (r"\$[^$]*\$", " "), (r"\\[A-Za-z]+\*?(\[[^\]]*\])?", " "), (r"[{}~\\]", " "), (r"\s+", " "))


def tex_words(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, by in TEX:
        out = F.regexp_replace(out, pattern, by)
    return F.filter(F.split(F.trim(out), " "), lambda w: w != "")


def substitutions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(old, new, n): the letter that differs in pairs of words of one length that differ in one letter."""
    at = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(F.col(a), i, F.lit(1)) != F.substring(F.col(b), i, F.lit(1)))
    d = pairs.filter((F.length(a) == F.length(b)) & (F.length(a) > 0)).withColumn("at", at).filter(F.size("at") == 1)
    ch = lambda c: F.substring(F.col(c), F.col("at")[0], F.lit(1))
    return d.groupBy(ch(a).alias("old"), ch(b).alias("new")).agg(F.count(F.lit(1)).alias("n"))


def align(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, equal, substituted, dropped): words in blocks that are equal, words of one length in replaced blocks of one
    size that differ in a letter, and what else there is of ``a``."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, x, y in f.itertuples(index=False):
                u, v = re.findall(r"\S+", x or ""), re.findall(r"\S+", y or "")
                equal = sub = 0
                for tag, i, j, p, q in SequenceMatcher(None, u, v, autojunk=False).get_opcodes():
                    if tag == "equal":
                        equal += j - i
                    elif tag == "replace" and j - i == q - p:
                        sub += sum(len(m) == len(n) and sum(c != d for c, d in zip(m, n, strict=True)) == 1 for m, n in zip(u[i:j], v[p:q], strict=True))
                rows.append((k, equal, sub, len(u) - equal - sub))
            yield pd.DataFrame(rows, columns=[key, "equal", "substituted", "dropped"])

    return df.select(key, a, b).mapInPandas(run, f"{key} {kind}, equal long, substituted long, dropped long")


def trailing_number(path: Column) -> Column:
    """The number that ends the last part of a path, after letters and zeros; null if none does."""
    return F.nullif(F.regexp_extract(path, r"/[a-z]*0*([0-9]+)(#.*)?$", 1), F.lit("")).cast("long")


def longest_suffix(name: Column, kinds: list[str]) -> Column:
    out = F
    for k in sorted(kinds, key=lambda k: (-len(k), k)):
        out = out.when(name.endswith(k), k)
    return out
