"""A corpus pipeline of five stages over ``documents``: each takes and returns documents, the last returns the mix."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantopo.llm import decontaminate, langid, mixing, nearcopies, secrets
from scantopo.llm._text import Carried, checkpoint_dir, fresh, text_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that language ID rejects go: null, empty and letterless texts, narrow
    margins, and all where no row has a language to learn from. Rows that repeat are judged each."""
    dicts = langid.dictionaries(docs.filter(~langid.held_out(F.col("doc_id"))))
    own = Carried(docs, docs.columns)
    told = langid.identify(docs.select(*own.take, "text"), dicts).filter(~F.col("lang_rejected"))
    return told.select(*own.back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least doc_id, null last. Null texts count as empty; of
    rows that repeat one stays."""
    return nearcopies.keep_first(docs, "doc_id")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; equal texts are judged alike, and null and empty ones stay, as
    does all where the benchmark is empty."""
    k1, k2 = (fresh(n, docs.columns) for n in ("_k1", "_k2"))
    keyed = docs.withColumns(dict(zip((k1, k2), text_key(F.col("text")), strict=True)))
    judged = decontaminate.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[k1, k2])
    dirty = judged.filter("contaminated").select(k1, k2).distinct()
    return keyed.join(dirty, [k1, k2], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted anew; null texts stay null."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, numbered by ``copy``. Documents without words
    take none; rows of one source, size, doc_id and text are alike to it; a column ``copy`` of the input is replaced."""
    own = Carried(docs, docs.columns, ("copy",))
    narrow = docs.select(*own.take, "source", mixing.word_count(F.col("text")).alias("size"), mixing.tie_broken(F.col("doc_id"), F.col("text")).alias("key"))
    return mixing.emit(mixing.mix(narrow, F.col("size"), F.col("key"))).select(*own.back, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_copies", near_copies),
    ("decontaminate", benchmark),
    ("secrets", secret_masks),
    ("mixture", mixture),
]

#: Language ID by compression, near copies and secrets by novelty have no SQL; tests/llm compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
