"""WARC archives: write, read, resolve revisits, write deduplicated archives.

Records are complete WARC/1.1 records (header block, HTTP block, payload, two line ends), many to a gzip file.
Spark's text writer writes them, its record separator being the two line ends that close a WARC record; Spark's
binaryFile reader reads them back, so both work on any store that Spark reaches. Records go to files by size class, so that a
file holds about ``FILE_BYTES`` at most, or one record that is larger: a reader holds one file at a time.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import drop_path, new_path, short_shuffles, small_batches, stored

CRLF = "\r\n"
#: Payloads below this many bytes are always stored in full.
LEAST_PAYLOAD = 100
#: Payload bytes that one archive file may hold, unless a single record has more, and records it may hold at most.
FILE_BYTES, FILE_RECORDS = 8 << 20, 2_000
#: Payload sizes up to which records share files, ``FILE_BYTES`` divided by that size to a file; larger ones have a file each.
SIZE_CLASSES = (4 << 10, 64 << 10, 1 << 20)
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = (
    "record_id string, page_id long, url string, record_type string, payload_digest string, actual_digest string, "
    "payload_bytes long, refers_to_id string"
)


def record_id(page_id: Column, digest: Column) -> Column:
    """The record id of a row: a UUID made of a hash of its page id, its payload digest and its place in the table, so that repeated rows differ."""
    h = F.md5(F.concat_ws(":", F.lit("page"), page_id.cast("string"), digest, F.monotonically_increasing_id().cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _clean_header(value: Column) -> Column:
    """Header values hold no control characters; those of a URL are percent-encoded."""
    out = value
    for raw, code in (("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def response_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``record, size_class``: a response record for each row. Null html: empty; null url: urn:page:<id>."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = F.octet_length(payload)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2)
    )
    url = F.coalesce(_clean_header(F.col("url")), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")))
    digest = F.sha2(payload.cast("binary"), 256)
    head = _head("response", record_id(F.col("page_id"), digest), url, F.col("page_id"), digest, size)
    length = F.octet_length(http) + size
    return pages.select(
        F.concat(head, F.lit("Content-Type: application/http;msgtype=response" + CRLF + "Content-Length: "), length.cast("string"),
                 F.lit(CRLF * 2), http, payload).alias("record"), size_class(size).alias("size_class")
    )


def _head(kind: str, rid: Column, url: Column, page_id: Column, digest: Column, size: Column) -> Column:
    fields = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), rid),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(page_id.cast("string"), F.lit(""))),
    ]
    return F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF))


def write_archives(records: DataFrame, path: str, classes: list[int] | None = None) -> None:
    """Write ``records(record, size_class)`` as gzipped WARC files below ``path``, each size class with as many records to a file as fit.

    Gzip works at its fastest level: it takes most of the time, and archives are read back soon. ``classes``: those that occur; None: all.
    """
    for c in range(len(SIZE_CLASSES) + 1) if classes is None else classes:
        each = min(FILE_RECORDS, FILE_BYTES // SIZE_CLASSES[c]) if c < len(SIZE_CLASSES) else 1
        (records.where(F.col("size_class") == c).select(F.col("record").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
         .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", each).text(f"{path}/class-{c}"))


def size_class(size: Column) -> Column:
    """Number of the first of ``SIZE_CLASSES`` that a payload of that many bytes fits, or of the class beyond."""
    out = None
    for c, most in enumerate(SIZE_CLASSES):
        out = F.when(size <= most, c) if out is None else out.when(size <= most, c)
    return out.otherwise(len(SIZE_CLASSES))


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The records of an uncompressed archive: header fields (names in lower case), HTTP head, payload."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        block = memoryview(content)[start:stop]
        if bytes(content[stop : stop + 4]) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end as it should")
        if "application/http" in fields.get("content-type", ""):
            cut = content.find(b"\r\n\r\n", start, stop)
            cut = cut + 4 if cut >= 0 else stop
            yield fields, bytes(content[start:cut]), bytes(content[cut:stop])
        else:
            yield fields, b"", bytes(block)
        at = stop + 4


def _row(fields: dict[str, str], payload: bytes) -> tuple:
    page = fields.get("x-page-id", "")
    revisit = fields["warc-type"] == "revisit"
    size = int(fields["x-payload-length"]) if revisit else len(payload)
    digest = fields["warc-payload-digest"].rpartition(":")[2]
    return (
        fields["warc-record-id"], int(page) if page else None, fields["warc-target-uri"], fields["warc-type"], digest,
        digest if revisit else hashlib.sha256(payload).hexdigest(), size, fields.get("warc-refers-to"),
    )


def _read_batches(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    for batch in batches:
        for item in batch.column("content"):
            rows, held = [], 0
            for fields, _, payload in parse(gzip.decompress(item.as_py())):
                rows.append(_row(fields, payload) + ((payload,) if with_payload else ()))
                held += len(payload) if with_payload else 0
                if held > FILE_BYTES or len(rows) >= FILE_RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record: ids, type, stated and recomputed payload digest, payload length; the payload only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    small_batches(spark)
    return files.mapInArrow(lambda b: _read_batches(b, with_payload), READ + (", payload binary" if with_payload else ""))


def resolve(headers: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``headers(record_id, page_id, actual_digest, payload_bytes, url)`` -> adds ``original_id``, ``original_url`` (null: stored in full).

    Headers alone are dealt by payload digest. Of equal payloads of at least ``least`` bytes the record with the smallest page_id is
    the original (null ids last); the minimum is combined before the shuffle, and the join back to a common digest can be split.
    """
    large = headers.where(F.col("payload_bytes") >= least)
    firsts = large.groupBy(F.col("actual_digest").alias("_d")).agg(
        F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_id", "url")).alias("_f")
    )
    joined = headers.join(
        firsts.select("_d", F.col("_f.record_id").alias("_o"), F.col("_f.url").alias("_u")),
        (F.col("actual_digest") == F.col("_d")) & (F.col("payload_bytes") >= least), "left",
    )
    other = F.col("_o").isNotNull() & (F.col("_o") != F.col("record_id"))
    return joined.withColumn("original_id", F.when(other, F.col("_o"))).withColumn("original_url", F.when(other, F.col("_u"))).drop("_d", "_o", "_u")


def deduplicated_records(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """``records`` with payload, ``decisions(record_id, original_id, original_url)`` -> ``record, size_class`` with fresh headers.

    Revisits keep the HTTP head, name the original record and drop the payload.
    """
    slim = decisions.select(F.col("record_id").alias("_r"), "original_id", "original_url")
    both = records.join(slim.hint("shuffle_hash"), F.col("record_id") == F.col("_r"))
    payload = F.col("payload").cast("string")
    size = F.col("payload_bytes")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2)
    )
    ends = F.lit(CRLF + "Content-Length: ")
    full = F.concat(
        _head("response", F.col("record_id"), F.col("url"), F.col("page_id"), F.col("actual_digest"), size),
        F.lit("Content-Type: application/http;msgtype=response"), ends, (F.octet_length(http) + size).cast("string"), F.lit(CRLF * 2), http, payload,
    )
    revisit = F.concat(
        _head("revisit", F.col("record_id"), F.col("url"), F.col("page_id"), F.col("actual_digest"), size),
        F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), F.col("original_id"), F.lit(CRLF + "WARC-Refers-To-Target-URI: "),
        F.col("original_url"), F.lit(CRLF + "Content-Type: application/http;msgtype=response"), ends, F.octet_length(http).cast("string"),
        F.lit(CRLF * 2), http,
    )
    # a revisit has no payload, but a class by its record alone would ask for more files
    return both.select(F.when(F.col("original_id").isNull(), full).otherwise(revisit).alias("record"), size_class(size).alias("size_class"))


def deduplicate(pages: DataFrame, out: str | None = None, least: int = LEAST_PAYLOAD) -> tuple[DataFrame, str]:
    """``pages(page_id, url, html)`` -> the records read back from deduplicated archives, and the archives' folder.

    Every row gets a record of its own, repeated rows too: of rows equal in page_id and html one is the response, the others revisit it.
    A null page_id comes last in the choice of the original. Payloads travel twice: into the first archives and, with their
    decisions, into the second. An empty table gives empty archives.
    """
    spark = pages.sparkSession
    unique = pages.select("page_id", "url", "html")
    raw, final = new_path(spark, "warc-raw"), out or new_path(spark, "warc")
    found = unique.agg(F.collect_set(size_class(F.coalesce(F.octet_length("html"), F.lit(0))))).first()[0]  # four numbers at most
    classes = sorted(found) or [0]
    with short_shuffles(spark):
        write_archives(response_records(unique), raw, classes)
        decisions, decided = stored(resolve(read_archives(spark, raw), least).select("record_id", "original_id", "original_url"), "decisions")
        for c in classes:
            write_archives(deduplicated_records(read_archives(spark, f"{raw}/class-{c}", True), decisions), final, [c])
    drop_path(spark, raw)
    drop_path(spark, decided)
    return read_archives(spark, final), final


def page_report(records: DataFrame) -> DataFrame:
    """Records of deduplicated archives -> page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), record_id."""
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("_t"), F.col("page_id").alias("refers_to"))
    return records.join(targets, F.col("refers_to_id") == F.col("_t"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"
    )
