"""The queries of this subpackage, with fixed result columns, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scantopo.llm import decontaminate, langid, licenses, mixing, nearcopies, neighbours, repeats, secrets, toxicity, warc
from scantopo.llm._text import materialise, spread_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = warc.write(pages, warc.scratch(spark))
    captures = materialise(warc.assemble(warc.read(spark, path, payloads=False)))
    r = F.col("response")
    return warc.resolve(captures, pages.schema["page_id"].dataType.simpleString()).select("page_id", r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["type"].alias("record_type"), "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out)
    r = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, keep=["doc_id"])
    return r.select("doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_evidence").alias("evidence"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = materialise(d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.tie_broken(F.col("doc_id"), F.col("text")).alias("key")))
    m = mixing.mix(d, F.col("size"), F.col("key"))
    return m.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    dicts = langid.dictionaries(d.filter(~out))
    r = langid.identify(d, dicts, keep=["doc_id"])
    return r.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def op7_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = materialise(nearcopies.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))
    sizes = materialise(c.groupBy("near_class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return spread_join(c, sizes, ["near_class"], sizes.select("near_class", F.col("class_size").alias("n"))).select("doc_id", "class_id", "class_size")


def _spans(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != "novel")
    return r.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("secret_spans")).alias("spans"), n("novel").alias("n_novel"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["kind"] == "base")
    named = F.transform(F.filter("hits", lambda h: h["kind"] != "tag"), lambda h: h["label"])
    starts = F.transform(base, lambda h: h["first_word"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return r.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda h: h["label"])).alias("base_labels"), joined(F.concat(named, F.flatten(F.transform("expressions", lambda e: e["families"])))).alias("labels"), "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_nearcopies": op7_nearcopies,
    "op8_secrets": op8_secrets,
    "op9_neighbours": op9_neighbours,
    "op10_licenses": op10_licenses,
}
ORACLES: dict[str, str] = {"op2_decontaminate": decontaminate.ORACLE, "op3_warc": warc.ORACLE, "op5_mixing": mixing.ORACLE.format(table="documents")}
