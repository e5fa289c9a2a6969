"""WARC archives: writing captures, reading records, assembling transactions [operator 3]."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scantopo.llm._text import checkpoint_dir, materialise, spread_join

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are stored once.
LEAST = 0
#: Groups of equal payloads up to which their list is broadcast; beyond it is joined.
BROADCAST_GROUPS = 50_000
CAPTURES_A_FILE = 1_000
BATCH_BYTES = 4 << 20
_END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1 digest: each five hexadecimal digits are four characters of the alphabet."""
    digest, out = F.sha1(data), []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def quoted(field: Column) -> Column:
    """A value as text that fits a header line: percent signs, line ends and outer spaces are escaped."""
    out = F.regexp_replace(field.cast("string"), "%", "%25")
    for plain, code in (("\r", "%0D"), ("\n", "%0A"), ("^ | $", "%20"), ("^\t|\t$", "%09")):
        out = F.regexp_replace(out, plain, code)
    return out


def _record(kind: str | Column, ident: Column, target: Column, media: str, extra: list[tuple[str, Column]], block: Column, body: Column | None = None, body_bytes: Column | None = None) -> Column:
    """A record without the two line ends that close it; headers whose value is null are left out. The block is
    ``block``, then ``body``, whose length is given so that a long text is put together once."""
    fields = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", target)]
    fields += [*extra, ("Content-Type", F.lit(media)), ("Content-Length", (F.octet_length(block) + (F.lit(0) if body_bytes is None else body_bytes)).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_END)), F.lit("")) for k, v in fields]
    return F.concat(F.lit(f"WARC/1.1{_END}"), *lines, F.lit(_END), block, *([] if body is None else [body]))


def records(pages: DataFrame, least: int = LEAST, broadcast: int = BROADCAST_GROUPS) -> DataFrame:
    """One row (warc string) for each row of ``pages``: its request, response or revisit, and metadata records, with
    the two line ends between them that close a record, and none after the last.

    Of equal payloads of at least ``least`` bytes, the row with the largest page_id is the response (all of them, where
    that page_id repeats; a null page_id counts as least), the others revisit it. Groups of one are never listed, so
    the list of groups is short as a rule and then broadcast; where it isn't, the rows meet it in a join that spreads
    the rows of a hot group. A null html is an empty payload, a null url about:blank; very long payloads are put
    together once; an empty table gives no rows; further columns, of whatever name, are left aside.
    """
    spark = pages.sparkSession
    target = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", "")
    p = pages.select(F.col("page_id"), target.alias("uri"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    groups = p.filter(F.col("n") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.max("page_id").alias("first")).filter("m > 1").select("digest", "first", F.col("m").alias("n"))
    groups = materialise(groups)
    few = groups.limit(broadcast + 1).count() <= broadcast
    p = p.join(F.broadcast(groups.select("digest", "first")), "digest", "left") if few else spread_join(p, groups.select("digest", "first"), ["digest"], groups.select("digest", "n"), "left")
    p = p.withColumn("cap", F.monotonically_increasing_id())
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    first = F.coalesce(F.col("first").cast("string"), F.lit("-"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    request = record_id(F.lit("request"), F.col("cap").cast("string"))
    response = F.when(again, record_id(F.lit("revisit"), F.col("cap").cast("string"))).otherwise(record_id(F.lit("response"), page, F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("n").cast("string"), F.lit(_END * 2))
    path = F.regexp_replace(F.col("uri"), r"^[a-z]+://[^/]*", "")
    ask = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{_END}Host: "), F.regexp_extract("uri", r"^[a-z]+://([^/]*)", 1), F.lit(_END * 2))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), quoted(F.col("page_id")), F.lit(_END)), F.lit("")), F.lit("via: table"), F.lit(_END))
    revisit = lambda c: F.when(again, c)
    uri = F.col("uri")
    warc = F.concat_ws(
        _END * 2,
        _record("request", request, uri, "application/http;msgtype=request", [], ask),
        _record(
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")), response, uri, "application/http;msgtype=response",
            [
                ("WARC-Concurrent-To", request), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Profile", revisit(F.lit(PROFILE))), ("WARC-Refers-To", revisit(record_id(F.lit("response"), first, F.col("digest")))),
            ], http, F.when(again, F.lit("")).otherwise(F.col("html")), F.when(again, F.lit(0)).otherwise(F.col("n")),
        ),
        _record("metadata", record_id(F.lit("metadata"), F.col("cap").cast("string")), uri, "application/warc-fields", [("WARC-Concurrent-To", request)], about),
    )
    return p.select(warc.alias("warc"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> str:
    """Writes ``pages`` as gzipped WARC files under ``path`` and returns it.

    Spark's writer puts them there, so that any store it knows will do, a lost task is run again, and only whole files
    of finished tasks show. The line end of its text format is the two line ends that close the last record of a row.
    """
    how = records(pages, least).write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_A_FILE)
    how.mode("overwrite").text(path)
    return path


def parse(raw: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and blocks of the records of an archive, by their lengths alone.

    The archive may come in pieces; no more of it is held than a record and a piece.
    """
    source = iter([raw] if isinstance(raw, bytes) else raw)
    held = bytearray()
    while True:
        head, seen = held.find(b"\r\n\r\n"), 0
        while head < 0:
            seen = max(0, len(held) - 3)
            if (piece := next(source, None)) is None:
                if held:
                    raise ValueError(f"the archive ends within a record: {bytes(held[:40])!r}")
                return
            held += piece
            head = held.find(b"\r\n\r\n", seen)
        lines = held[:head].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record: {lines[0][:40]!r}")
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            k, _, v = line.partition(":")
            fields.setdefault(k.strip().lower(), []).append(v.strip())
        end = head + 4 + int(fields["content-length"][0])
        while len(held) < end + 4 and (piece := next(source, None)) is not None:
            held += piece
        if len(held) < end:
            raise ValueError(f"the archive ends within a record: {lines[0][:40]!r}")
        block = bytes(held[head + 4 : end])
        del held[: end + 4]
        yield fields, block


def inflate(raw: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """The members of a gzip file, one or many, in pieces of up to ``piece`` bytes."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(raw):
            fed = bytes(view[at : at + piece])
            at += len(fed)
            while fed and not d.eof:
                if out := d.decompress(fed, piece):
                    yield out
                fed = d.unconsumed_tail
        if not d.eof and (out := d.flush()):  # what was held back as the input ended
            yield out
        if not d.eof:
            raise ValueError("the gzip file is cut off")
        at -= len(d.unused_data)


SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest_named string,"
    " payload_bytes long, payload_digest string, page_id string, payload binary"
)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``; payload is null where ``payloads`` is false.

    payload_bytes and payload_digest of a response are measured on its payload; those of a revisit, which stores none,
    are what its headers say. A file is held as it is stored, and one of its records at a time; records go on in
    batches of about BATCH_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                out, size = [], 0
                for fields, block in parse(inflate(raw.as_py())):
                    out.append(_row(fields, block, payloads))
                    size += len(block) if payloads else 500
                    if size >= BATCH_BYTES:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _row(f: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    get = lambda k: f.get(k, [None])[0]
    kind, n, digest, page, payload = get("warc-type"), None, None, None, None
    named = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            said = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            n, digest, payload = int(said[0]) if said else None, named, None
    elif kind == "metadata":
        page = next((unquote(x.partition(":")[2].strip(" ")) for x in block.decode("utf-8", "replace").split("\r\n") if x.startswith("page-id:")), None)
    return kind, get("warc-record-id"), get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), named, n, digest, page, payload if payloads else None


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: its request, response (or revisit) and metadata records.

    Each record names the request of its transaction, or is it; records of one name meet in a single shuffle, two to
    three of them to a name. A capture lacking a record has null there.
    """
    key = F.coalesce("concurrent_to", "record_id")
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct("*")), ignorenulls=True)
    return found.groupBy(key.alias("transaction")).agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))


def resolve(captures: DataFrame, page_type: str = "long") -> DataFrame:
    """``captures`` with page_id, and refers_to: the page_id of the response that a revisit names, else null."""
    c = captures.withColumn("page_id", F.col("metadata.page_id").cast(page_type))
    named = c.filter(F.col("response.type") == "response").groupBy(F.col("response.record_id").alias("_id")).agg(F.max("page_id").alias("refers_to"))
    return c.withColumn("_to", F.when(F.col("response.type") == "revisit", F.col("response.refers_to"))).join(named, F.col("_to") == F.col("_id"), "left").drop("_id", "_to")


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
d AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // k) % 32 AS INTEGER) + 1, 1), '' ORDER BY i, k DESC) AS digest
  FROM (SELECT h, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) AS v FROM g, range(8) r(i)) x, (VALUES (32768), (1024), (32), (1)) y(k) GROUP BY h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM p JOIN g USING (h) JOIN d USING (h)
"""
