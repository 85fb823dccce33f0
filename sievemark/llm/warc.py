"""WARC archives with revisit resolution.

Headers (ids, lengths, digests) are shuffled by payload digest: of equal payloads the record with the smallest id is
the response, the others revisit it.  Archives are written by Spark's own writer, so that they land in any store and a
lost task leaves nothing behind: a record is text in UTF-8 that ends with CR LF CR LF, which is the writer's line
separator, and a file is compressed as a whole.  Reading streams each archive through the record lengths; revisits are
then joined to the original responses.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, remove, shared_dir

#: Equal payloads below this are written in full.
MIN_BYTES = 100
#: Bytes of payload that an archive should hold.
ARCHIVE_BYTES = 24 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _record_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header_safe(value: Column) -> Column:
    """No character that could end or fold a header line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``key_, url_, digest, response_, refers_to, refers_url`` for each different (id, address, digest) of ``headers``.

    The original of a digest, with the smallest id (null last) and address, is aggregated before the shuffle; headers
    carry no payload.
    """
    at = F.struct(F.col("key_").isNull().alias("n"), F.col("key_").alias("k"), F.col("url_").isNull().alias("m"), F.col("url_").alias("u"))
    originals = headers.where(F.col("bytes_") >= min_bytes).groupBy(F.col("digest").alias("d_")).agg(F.min(at).alias("original"))
    rows = headers.select("key_", "url_", "digest").distinct()
    j = rows.join(originals, rows["digest"] == originals["d_"], "left")
    response = F.col("d_").isNull() | F.col("original").eqNullSafe(at)
    return j.select("key_", "url_", "digest", response.alias("response_"), F.col("original.k").alias("refers_to"), F.col("original.u").alias("refers_url"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write one record for every row of ``pages`` to gzip archives in the folder ``path``.

    Null payloads are empty.  Of rows that repeat an id and a payload the first is the response and the others revisit
    it.  A null id is larger than all others; its records have no id header.
    """
    rows = pages.select(pages[id_col].cast("long").alias("key_"), pages[url_col].cast("string").alias("url_"), F.coalesce(pages[payload_col], F.lit("")).alias("body_"))
    digest = F.sha2("body_", 256)
    headers = cut(rows.select("key_", "url_", digest.alias("digest"), F.octet_length("body_").cast("long").alias("bytes_")))
    verdict = resolve_revisits(headers, min_bytes)
    total = headers.agg(F.sum("bytes_"), F.count(F.lit(1))).first()
    files = max(1, -(-int(total[0] or 0) // ARCHIVE_BYTES))
    # Rows of one id and address go together; so null ids, whose addresses differ, are spread as well.  The two are one
    # key without null: a join that compares them one by one would exchange the payloads again.
    salt = F.concat(F.coalesce(F.col("key_").cast("string"), F.lit("none")), F.lit("\n"), F.coalesce(F.concat(F.lit("at "), F.col("url_")), F.lit("none")))
    # Payloads move once, to the archive they are written to; the join adds no exchange of its own.
    body = rows.withColumn("digest", digest).withColumn("salt", salt).repartition(files, "salt", "digest")
    verdict = verdict.withColumn("salt", salt).repartition(files, "salt", "digest").drop("key_", "url_")
    j = body.join(verdict.hint("merge"), ["salt", "digest"])
    nth = F.row_number().over(Window.partitionBy("salt", "digest").orderBy("key_", "url_"))
    j = j.withColumn("nth", nth)
    big = F.octet_length("body_") >= min_bytes
    revisit = big & (~F.col("response_") | (F.col("nth") > 1))
    http = F.concat(F.lit(_HTTP), F.octet_length("body_").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body_")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.lit("record"), F.col("key_"), F.col("url_"), F.col("digest"), F.col("nth"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_safe(F.col("url_"))),
        F.when(F.col("key_").isNotNull(), line("WARC-Page-ID", F.col("key_").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.lit("record"), F.col("refers_to"), F.col("refers_url"), F.col("digest"), F.lit(1))),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )
    j.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").mode("overwrite").text(path)
    release(headers)


def _plain(chunk_source):
    """Decompressed pieces of a gzip stream of one or more members."""
    d = zlib.decompressobj(31)
    for raw in chunk_source:
        while raw:
            yield d.decompress(raw)
            raw = d.unused_data
            if d.eof and raw:
                d = zlib.decompressobj(31)
    yield d.flush()


def records(data: bytes):
    """(headers, block) of each record of a gzip archive."""
    view = memoryview(data)
    pieces = _plain(bytes(view[i : i + (1 << 20)]) for i in range(0, len(view), 1 << 20))
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(held).strip():
                    raise ValueError("a WARC record is cut off")
                return
        head = bytes(held[:end]).decode()
        first, *lines = head.split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        need = end + 4 + int(fields["Content-Length"])
        while len(held) < need + 4:
            if not more():
                break
        block = bytes(held[end + 4 : need])
        if len(block) < need - end - 4:
            raise ValueError("a WARC record is cut off")
        del held[: need + 4]
        yield fields, block


_READ = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string"


def _read(batches):
    names = ["page_id", "url", "record_type", "record_id", "refers_to_id", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for k in range(len(batch)):
            rows = []
            for f, block in records(batch.column(0)[k].as_py()):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {f['WARC-Record-ID']} does not have its digest")
                rows.append((int(f["WARC-Page-ID"]) if "WARC-Page-ID" in f else None, f["WARC-Target-URI"], kind, f["WARC-Record-ID"], f.get("WARC-Refers-To"), len(payload) if kind == "response" else None, digest))
                if len(rows) == 5000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` of all records below ``path``.

    Digests of responses are checked against their payloads.  Length and id of what a revisit refers to come from the
    original response.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = cut(files.mapInArrow(_read, _READ))
    # Responses need no partner; only revisits are joined, so nothing meets under a null key.
    responses = found.where("record_type = 'response'")
    originals = responses.select(F.col("record_id").alias("o_"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_"))
    revisits = found.where("record_type <> 'response'").join(originals, F.col("refers_to_id") == F.col("o_"), "left")
    alone = responses.select("page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    return alone.unionByName(revisits.select("page_id", "url", "record_type", "refers_to", F.col("full_").alias("payload_bytes"), "payload_digest"))


def archive_round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as deduplicated archives below ``path``, and read them.

    Without a path the archives stand in a new folder of the shared one, until they are read.
    """
    spark = pages.sparkSession
    folder = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **columns)
    found = read_archives(spark, folder)
    if path is None:
        remove(spark, folder)
    return found
