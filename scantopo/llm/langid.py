"""Language identification by compression with per-language dictionaries [operator 6]."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantopo.llm._text import Carried, id_text, parts

#: Documents (about, by a digest) that a language's dictionary is made of, and characters of each: the bounded sample of
#: labelled rows, 120 KiB a language in the alphabets at hand.
SAMPLE, SHARE = 240, 512
#: Texts are compressed in pieces, so that a long text is judged by the dictionary and not by its own beginning.
PIECE = 768
LEVEL, MIN_MATCH = 3, 4
#: Relative gap between the best and the second best size under which a language is not told.
MARGIN = 0.002
UNKNOWN = "und"
#: Characters whose words are held as a list at once.
BLOCK = 1 << 16
_LETTERS = regex.compile(r"\p{L}+")


def normal(text: str) -> bytes:
    """The runs of letters (Unicode category L) of a whole text, in lower case and in order, with single spaces between.

    Block by block, as the words of a long text as a list take ten times its memory; a run that goes on in the next
    block stays one.
    """
    low, out, inside = text.lower(), [], False
    for i in range(0, len(low), BLOCK):
        block = low[i : i + BLOCK]
        if words := _LETTERS.findall(block):
            if out and not (inside and _LETTERS.match(block)):
                out.append(b" ")
            out.append(" ".join(words).encode("utf-8", "replace"))
        inside = bool(_LETTERS.match(block[-1]))
    return b"".join(out)


def held_out(doc_id: Column, mod: int = 3, rest: int = 1) -> Column:
    return F.pmod(F.crc32(id_text(doc_id)), F.lit(mod)) == rest


def dictionaries(docs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Raw-content dictionaries of the languages in ``docs`` (doc_id, text, lang), from rows with text and lang.

    The sample is the rows whose digest of doc_id and text, as a number in [0, 1), is under ``sample`` by the rows of
    their language: about ``sample`` rows, chosen without ranking; rows that repeat count once. Of each, SHARE
    characters of its middle, so that no long document fills a dictionary. One short row a language goes to the
    executors, and the sample to the driver.
    """
    named = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rate = named.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("_rate"))
    h = F.xxhash64(F.lit("langid"), id_text(F.col("doc_id")), "text")
    part = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    mid = F.greatest(F.lit(1), F.floor(F.length("text") / 2 - SHARE / 2).cast("int"))
    rows = named.withColumn("_h", h).withColumn("_part", part).join(F.broadcast(rate), "lang").filter("_part < _rate").select("lang", "_h", F.substring("text", mid, F.lit(SHARE)).alias("t")).distinct()
    out: dict[str, bytes] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["_h"], r["t"])):
        out[r["lang"]] = out.get(r["lang"], b"") + normal(r["t"]) + b" "
    return out


@functools.lru_cache(maxsize=2)
def _compressors(dicts: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
    for lang, raw in dicts:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=how)))
    return out


def pieces(raw: bytes) -> Iterator[bytes]:
    n = max(1, round(len(raw) / PIECE))
    step = -(-len(raw) // n)
    return (raw[i : i + step] for i in range(0, len(raw), step))


def judge(text: str | None, dicts: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """Language, score and margin of one text.

    The margin is how much smaller the best size is than the second best, as a share of the second; the score rises
    with it from 0 towards 1. Of equal sizes the first language by code point is told. No dictionary, no text or no
    letter: unknown, 0, 0.
    """
    raw = normal(text or "")
    if not raw or not dicts:
        return UNKNOWN, 0.0, 0.0
    sizes = sorted((sum(len(c.compress(p)) for p in pieces(raw)), lang) for lang, c in _compressors(dicts))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    margin = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], margin / (margin + 0.02), margin


def identify(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, and its columns or those in ``keep``, with lang_pred, lang_score, lang_margin and lang_rejected.

    One pass over whole texts, long ones too, piece by piece; the dictionaries, bounded by the sample of each language,
    go with the code. Rejected are unknown languages and margins under ``margin``. Null, empty and letterless texts are
    unknown. Nulls in other columns, repeated rows and further columns are kept, whatever their names; columns of these
    four names are replaced; an empty table gives an empty table.
    """
    names = ["lang_pred", "lang_score", "lang_margin", "lang_rejected"]
    own = Carried(docs, docs.columns if keep is None else keep, tuple(names))
    pairs = tuple(sorted(dicts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [judge(t, pairs) for t in b.column(0).to_pylist()]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            cols.append(pa.array([f[0] == UNKNOWN or f[2] < margin for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*own.inner, *names])

    told = docs.select(F.col("text").alias("_text"), *own.take).mapInArrow(run, f"{own.fields}lang_pred string, lang_score double, lang_margin double, lang_rejected boolean")
    return told.select(*own.back, *names)
