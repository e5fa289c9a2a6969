"""Toxicity by the nearest labelled examples, TF-IDF cosine over a block-max inverted index [operator 4].

The vocabulary of the vectors is chosen from the labelled sample: with all words in it, the words that two texts share by
their subject outweigh the few that make one toxic, and the nearest examples tell little (README has the figures).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scantopo.llm._text import Carried, U, Words, id_text, materialise, mix64, slices, span_hash

#: Labelled documents of each class that are examples, at most: the bounded sample of labelled rows.
EXAMPLES = 3000
#: Example texts that must hold a term of the vocabulary, and terms expected to pass by chance alone.
LEAST_TEXTS, BY_CHANCE = 5, 0.05
#: Least shingle hashes by which near copies among examples are told, and the share that must agree: one of each family
#: and class votes. Similarity is estimated to about 0.05.
SKETCH, ALIKE = 64, 0.8
#: Beginnings of words, in bytes, that are terms beside whole words: inflected and compounded words share them.
BEGINNINGS = (4, 5, 6)
#: A term that a text has twice, or three times, is another term beside; its hash is the term's under these masks.
AGAIN = {2: 0x5851F42D4C957F2D, 3: 0x14057B7EF767814F}
NEIGHBOURS, BLOCK = 24, 64


def term_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every term occurrence: words, and beginnings of longer words."""
    texts, hashes = [w.text], [w.hash]
    for n in BEGINNINGS:
        at = np.flatnonzero(w.end - w.start > n)
        texts.append(w.text[at])
        hashes.append(mix64(span_hash(w.sums, w.start[at], w.start[at] + n, w.base) + U(n)) if len(at) else np.empty(0, U))
    return np.concatenate(texts), np.concatenate(hashes).view(np.int64)


def sketches(w: Words, n: int) -> pa.Array:
    """SKETCH least hashes of the word shingles of each of ``n`` texts; of its words, if it has fewer than five."""
    at, h = w.grams(5)
    few = w.count[w.text] < 5
    text, h = np.concatenate([w.text[at], w.text[few]]), np.concatenate([h, w.hash[few]])
    out = np.full((n, SKETCH), 2**63 - 1, np.int64)
    for i in range(SKETCH):
        np.minimum.at(out[:, i], text, (mix64(h + U(i + 1)) >> U(1)).view(np.int64))
    return pa.ListArray.from_arrays(np.arange(0, n * SKETCH + 1, SKETCH, dtype=np.int32), pa.array(out.ravel()))


def one_of_each_family(rows: list[tuple[int, int, list[int], int]]) -> list[int]:
    """The last fields of those of (doc_id, toxic, sketch, tag) that are no near copies of one before of their class, by doc_id."""
    out = []
    for c in (0, 1):
        own = sorted(r for r in rows if r[1] == c)
        kept, n = np.empty((len(own), SKETCH), np.int64), 0
        for _, _, sketch, tag in own:
            s = np.array(sketch, np.int64)
            if n and (kept[:n] == s).sum(1).max() >= ALIKE * SKETCH:
                continue
            kept[n], n = s, n + 1
            out.append(tag)
    return out


def term_counts(docs: DataFrame, keep: Carried, terms: np.ndarray | None) -> DataFrame:
    """``keep`` with terms and counts (arrays): those in the sorted ``terms``, or all, and then the sketch."""
    bits = base = None
    if terms is not None:
        base = np.unique(np.concatenate([terms, *[terms ^ m for m in AGAIN.values()]]))
        bits = np.zeros(1 << 16, bool)
        bits[base & 0xFFFF] = True

    def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, h)
        return known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in slices(b.column(0)):
                w = Words(texts)
                text, h = term_hashes(w)
                if terms is not None:
                    ok = bits[h & 0xFFFF]
                    text, h = text[ok], h[ok]
                    ok = among(h, base)
                    text, h = text[ok], h[ok]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, int)
                count, text, h = np.diff(np.r_[new, len(h)]).astype(np.int32), text[new], h[new]
                many = [np.flatnonzero(count >= k) for k in AGAIN]
                h = np.concatenate([h, *[h[x] ^ m for x, m in zip(many, AGAIN.values(), strict=True)]])
                text, count = (np.concatenate([v, *[v[x] for x in many]]) for v in (text, count))
                ok = among(h, terms) if terms is not None else slice(None)
                text, h, count = text[ok], h[ok], count[ok]
                order = np.lexsort((h, text))
                text, h, count = text[order], h[order], count[order]
                ends = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
                cols = [pa.ListArray.from_arrays(ends, pa.array(h)), pa.ListArray.from_arrays(ends, pa.array(count))]
                if terms is None:
                    cols.append(sketches(w, hi - lo))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[1:]], *cols], names=[*keep.inner, "terms", "counts", *more])

    more = ["sketch"] if terms is None else []
    return docs.select(F.col("text").alias("_text"), *keep.take).mapInArrow(run, f"{keep.fields}terms array<long>, counts array<int>" + "".join(f", {m} array<long>" for m in more))


def examples(docs: DataFrame, labels: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, terms, counts): up to ``n`` documents of each class of ``labels`` (doc_id, toxic).

    The least digests of doc_id are taken, and of each family of near copies one of each class: the least doc_id. Ids
    labelled twice are toxic if either says so; null labels and ids are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ranked = known.withColumn("h", F.xxhash64(F.lit("toxicity"), id_text(F.col("doc_id"))))
    chosen = [ranked.filter(F.col("toxic") == c).orderBy("h").limit(n).select("doc_id", "toxic") for c in (0, 1)]
    chosen = materialise(chosen[0].unionByName(chosen[1]))  # of 2 n rows, so it may be broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    own = Carried(picked, ["doc_id", "toxic"])
    rows = term_counts(picked, own, None).select(*own.back, "terms", "counts", "sketch")
    rows = materialise(rows.withColumn("_tag", F.monotonically_increasing_id()))
    tags = one_of_each_family([tuple(r) for r in rows.select("doc_id", "toxic", "sketch", "_tag").collect()])
    kept = docs.sparkSession.createDataFrame([(t,) for t in tags], "_tag long")
    return rows.join(F.broadcast(kept), "_tag").drop("_tag", "sketch")


def select_terms(found: DataFrame) -> np.ndarray:
    """Hashes of the terms most telling of class 1 among examples, sorted: by log-likelihood ratio (G squared)."""
    sizes = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return np.empty(0, np.int64)
    p, n = float(sizes[1]), float(sizes[0])
    t = found.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)
    g = 2 * (part(a, both * p / (p + n)) + part(b, both * n / (p + n)) + part(p - a, (p + n - both) * p / (p + n)) + part(n - b, (p + n - both) * n / (p + n)))
    t = materialise(t)
    least = 2 * math.log(max(2, t.count()) / BY_CHANCE)  # the ratio's tail is about exp(-g / 2)
    best = t.withColumn("g", g).filter((both >= LEAST_TEXTS) & (F.col("g") >= least) & (a / p > b / n)).select("t")
    return np.sort(np.array([r["t"] for r in best.collect()], np.int64))


@dataclass
class Index:
    """Distinct example vectors, as postings of each term by vector, with the greatest weight in each block of vectors."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    first: np.ndarray  # of each term, in the next three: blocks that hold it
    block: np.ndarray
    most: np.ndarray  # greatest weight there
    posting: np.ndarray  # and where its postings begin, with one entry more
    vector_of: np.ndarray  # postings: vectors, in order
    weight: np.ndarray
    votes: np.ndarray  # vectors x 2: weighed documents of class 0 and 1
    ids: list  # an example's doc_id for each vector
    rank: np.ndarray  # the order of these
    prior: float
    bare: float = 0.0  # score of a text without terms
    steps: tuple[np.ndarray, np.ndarray] = (np.empty(0), np.empty(0))  # calibration: raw scores and what they mean

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return weighed(np.searchsorted(self.terms, terms), counts, self.idf)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` vectors of greatest cosine above 0, exactly: blocks are scored in order of the most they can hold,
        until none that is left can better the ``k``-th. Cosines that are equal to 12 digits go by the examples' ids."""
        blocks = -(-len(self.ids) // BLOCK)
        bound, entry = np.zeros(blocks), np.full((len(at), blocks), -1)
        for i, (t, x) in enumerate(zip(at.tolist(), w.tolist(), strict=True)):
            own = slice(self.first[t], self.first[t + 1])
            bound[self.block[own]] += x * self.most[own]
            entry[i, self.block[own]] = np.arange(own.start, own.stop)
        best_at, best = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-9):
                break
            s = np.zeros(BLOCK)
            for i in np.flatnonzero(entry[:, b] >= 0).tolist():
                own = slice(self.posting[entry[i, b]], self.posting[entry[i, b] + 1])
                s[self.vector_of[own] - b * BLOCK] += w[i] * self.weight[own]
            own = np.flatnonzero(s > 0)
            own = own[own + b * BLOCK != skip]
            best_at, best = np.concatenate([best_at, own + b * BLOCK]), np.concatenate([best, np.round(s[own], 12)])
            order = np.lexsort((self.rank[best_at], -best))[:k]
            best_at, best = best_at[order], best[order]
        return best_at, best

    def raw(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of class 1 among the neighbours, each weighed by 1 / (distance + 0.05), with one vote for the prior."""
        v = self.votes[near] * (1 / (1.05 - np.minimum(cosine, 1)))[:, None]
        return float((v[:, 1].sum() + self.prior) / (v.sum() + 1))

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, *self.steps)) if len(self.steps[0]) else raw


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of terms ``at`` in a vector of length 1."""
    w = (1 + np.log(counts)) * idf[at]
    return at, w / np.sqrt((w * w).sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit of y to x: pools of adjacent violators, as (mean x, mean y)."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i] * x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def build(rows: list[tuple], terms: np.ndarray, idf: np.ndarray, share: float) -> Index:
    """An index of examples (doc_id, toxic, terms, counts). ``share`` is that of class 1 among all labelled rows: as the
    sample takes both classes alike, a vote is weighed so that the votes of the classes are in that proportion."""
    n1 = sum(r[1] for r in rows)
    weigh = (max(1 - share, 1e-9) / max(1, len(rows) - n1), max(share, 1e-9) / max(1, n1))
    scale = 1 / min(weigh)
    distinct: dict[tuple, list] = {}
    bare = [0.0, 0.0]
    for doc, toxic, t, c in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if t:
            distinct.setdefault((tuple(t), tuple(c)), [doc, [0.0, 0.0]])[1][toxic] += weigh[toxic] * scale
        else:
            bare[toxic] += weigh[toxic] * scale
    # like vectors stand together, so that the bounds of blocks are tight
    order = sorted(distinct, key=lambda k: (sorted(terms.searchsorted(k[0]).tolist(), key=lambda i: -idf[i]), k[1], distinct[k][0]))
    vectors = [weighed(terms.searchsorted(np.array(k[0])), np.array(k[1]), idf) for k in order]
    t, v, w = (np.concatenate(x) if vectors else np.empty(0, int) for x in ([a for a, _ in vectors], [np.full(len(a), j) for j, (a, _) in enumerate(vectors)], [x for _, x in vectors]))
    by = np.lexsort((v, t))
    t, v, w = t[by], v[by], w[by]
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (v[1:] // BLOCK != v[:-1] // BLOCK)]) if len(t) else np.empty(0, int)
    ids = [distinct[k][0] for k in order]
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=lambda j: ids[j])] = np.arange(len(ids))
    votes = np.array([distinct[k][1] for k in order]).reshape(-1, 2)
    most = np.maximum.reduceat(w, new) if len(new) else np.empty(0)
    ix = Index(terms, idf, np.searchsorted(t[new], np.arange(len(terms) + 1)), v[new] // BLOCK, most, np.append(new, len(t)), v, w, votes, ids, rank, share)
    ix.bare = (bare[1] + share) / (sum(bare) + 1)
    if vectors:
        near = [ix.nearest(*x, skip=j) for j, x in enumerate(vectors)]  # each left out once
        total = votes.sum(1)
        ix.steps = isotonic(np.array([ix.raw(*x) for x in near]), votes[:, 1] / total, total)
    return ix


def learn(labels: DataFrame, counts: DataFrame, terms: np.ndarray, found: DataFrame, n_docs: int) -> Index:
    """An index from examples ``found``, with document frequencies over all rows of ``counts``."""
    freq = {r["t"]: r["n"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # of the vocabulary
    idf = np.array([np.log((n_docs + 1) / (freq.get(int(t), 0) + 1)) + 1 for t in terms])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, c = (np.array(b.column(x)[i].as_py(), np.int64) for x in (2, 3))
                ok = np.isin(t, terms)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *[pa.array([x[ok].tolist()], pa.list_(kind)) for x, kind in ((t, pa.int64()), (c, pa.int32()))]], names=b.schema.names)

    found = found.select("doc_id", "toxic", "terms", "counts")
    rows = [tuple(r) for r in found.mapInArrow(own, found.schema).collect()]
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").agg(F.avg(F.col("toxic").cast("double")).alias("m")).collect()[0]["m"]
    return build(rows, terms, idf, known or 0.0)


def score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of every row of ``docs`` (doc_id, text), with toxic_score and toxic_evidence (doc_id and cosine of up to
    five examples), learned from ``labels`` (doc_id, toxic) of which the caller leaves out what is held out.

    A first pass over the examples' texts picks the vocabulary; one pass over all texts, long ones whole, counts its
    terms, materialised without the texts; document frequencies are of all documents; each document then meets the
    index, of at most 2 * EXAMPLES vectors, and its score is the calibrated, distance-weighted vote. Texts without
    terms (null and empty ones too) score what such examples are. With no labels, or of one class, all scores are that
    class's share (0 without any). Nulls in ``keep`` stay, rows that repeat are scored each, an empty table gives an
    empty table; only ``keep`` of further columns is carried, whatever their names, but for those of the result.
    """
    own = Carried(docs, keep, ("toxic_score", "toxic_evidence"))
    found = materialise(examples(docs, labels))
    terms = select_terms(found)
    counts = materialise(term_counts(docs, own, terms))
    index = docs.sparkSession.sparkContext.broadcast(learn(labels, counts, terms, found, counts.count()))
    kind = docs.schema["doc_id"].dataType
    ev = pa.list_(pa.struct([("doc_id", to_arrow_type(kind)), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, seen = index.value, {}
        for b in batches:
            scores, evidence = [], []
            for t, c in zip(b.column(len(own.inner)).to_pylist(), b.column(len(own.inner) + 1).to_pylist(), strict=True):
                key = (tuple(t), tuple(c))
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    near, cosine = ix.nearest(*ix.vector(np.array(t), np.array(c))) if t else (np.empty(0, int), np.empty(0))
                    s = ix.calibrated(ix.raw(near, cosine)) if len(near) else ix.bare
                    seen[key] = s, [{"doc_id": ix.ids[n], "cosine": float(x)} for n, x in zip(near[:5], cosine[:5], strict=True)]
                s, e = seen[key]
                scores.append(min(1.0, max(0.0, s)))
                evidence.append(e)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own.inner)], pa.array(scores, pa.float64()), pa.array(evidence, ev)], names=[*own.inner, "toxic_score", "toxic_evidence"])

    told = counts.mapInArrow(run, f"{own.fields}toxic_score double, toxic_evidence array<struct<doc_id:{kind.simpleString()},cosine:double>>")
    return told.select(*own.back, "toxic_score", "toxic_evidence")
