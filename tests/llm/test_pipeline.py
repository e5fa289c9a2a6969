"""The pipeline's stages, each against the plain version on its own input."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_queries import awkward


def docs_of(spark, sf, which):
    if which == "sf":
        return spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], "en", r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(1000 + i, t, x, s) for i, (_, t, x, s) in enumerate(awkward())]
    rows += [(None, "a null id with words of its own", "en", None), (None, "a null id with words of its own", "en", None), (9000, "abc " * 50_000, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in CLASHING}).repartition(3)
    return docs.checkpoint() if docs.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else docs.persist()


#: Names that operators use within.
CLASHING = ("_k1", "_k2", "_by", "_c0", "_text", "copy", "mix_copies", "lang_pred", "secret_spans", "n_words", "near_class", "k1", "_salt")


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_rows(spark, sf, which):
    docs = docs_of(spark, sf, "odd")
    if which == "empty":
        docs = docs.limit(0).persist()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).persist()
        assert out.columns == docs.columns if i < 4 else sorted(out.columns) == sorted(docs.columns), name
        old, new = docs.collect(), out.collect()
        assert all(r[c] == c for r in new for c in CLASHING if c != "copy" or i < 4)
        if which == "empty":
            assert not new
        elif name == "language_id":
            assert sum((r["doc_id"] or 1000) < 1000 for r in new) >= 55 and not {r["doc_id"] for r in new} & {1000, 1001, 1002}
            out = docs.filter("length(text) > 0")  # the rest of the stages see the odd ones too
            new = out.collect()
        elif name == "near_copies":
            classes = brute.near_classes([r["text"] for r in old])
            assert len(new) == len(set(classes))
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert len(new) == sum(not x[4] for x in brute.decontaminate([r["text"] for r in old], items))
        elif name == "secrets":
            assert len(new) == len(old) and not any(brute.secrets(r["text"]) for r in new)
        else:
            assert {r["copy"] for r in new} <= {1, 2, 3} and {r["doc_id"] for r in new} <= {r["doc_id"] for r in old}
        docs = out


def test_stages(spark, sf):
    docs = docs_of(spark, sf, "sf")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).persist())
    before = [{r["doc_id"]: r for r in d.collect()} for d in seen[:-1]]
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert len(before[1]) >= 0.97 * len(before[0])
    ids = sorted(before[1])
    classes = brute.near_classes([before[1][i]["text"] for i in ids])
    assert set(before[2]) == {ids[c] for c in classes}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = sorted(before[2])
    judged = brute.decontaminate([before[2][i]["text"] for i in ids], items)
    assert set(before[3]) == {i for i, x in zip(ids, judged, strict=True) if not x[4]}
    assert set(before[4]) == set(before[3])
    assert not any(brute.secrets(r["text"]) for r in before[4].values())
    assert all(r["text"] == before[3][i]["text"] for i, r in before[4].items() if not brute.secrets(before[3][i]["text"]))
    last = seen[-1].collect()
    assert {r["doc_id"] for r in last} <= set(before[4]) and max(r["copy"] for r in last) <= 3
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, last))
