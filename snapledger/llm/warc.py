"""Legacy archive converter: pages to ARC files, ARC files to WARC files, WARC files to a table.

All files are written by Spark's text writer (a row is a record, the line feed that ends it belongs to the format) and
read as whole binary files of bounded size, so any file system that Spark knows will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.arc import FIELDS, http_parts, opened, read_arc, read_warc, record_id, warc_date
from snapledger.llm.common import discard, full_text, remove, scratch_path, stored, table

#: Bytes of payload that go to an archive file, on average: from 80 GB of pages on they grow, so that their number stays near FILES.
FILE_BYTES = 4 << 20
MOST_FILE_BYTES = 64 << 20
FILES = 20_000
#: Payloads below this are stored in full, however often they occur.
REVISIT_BYTES = 100
DATE = "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_arc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE,
    file_bytes: int | None = None,
) -> None:
    """Write every page as an HTTP response to gzipped ARC files under path; files of even number have version 1, others 2.

    Null pages count as empty, null URLs as `-`; spaces and line ends in URLs are escaped. The id goes to the HTTP head.
    """
    spark = pages.sparkSession
    url = F.when(F.col(url_col).isNull() | (F.col(url_col) == ""), "-").otherwise(F.col(url_col))
    for sign in (" ", "\n", "\r"):
        url = F.replace(url, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), full_text(html_col).alias("html"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-size // (file_bytes or min(MOST_FILE_BYTES, max(FILE_BYTES, size // FILES)))))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"),
    )
    doc = F.concat(head, F.col("html"))
    length = F.octet_length(doc).cast("string")
    first = F.concat_ws(" ", F.col("url"), F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), length)
    second = F.concat_ws(
        " ", F.col("url"), F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.md5("html"), F.lit("-"), F.lit("0"), F.lit("-"), length
    )
    number = F.pmod(F.xxhash64("id", F.lit("arc")), F.lit(files))
    records = rows.withColumn("file", number).select(
        "file", F.lit(1).alias("rank"), "id", F.concat(F.when(F.col("file") % 2 == 0, first).otherwise(second), F.lit("\n"), doc).alias("value")
    )
    blocks = [f"{v} 0 snapledger\n{FIELDS[v]}\n" for v in (1, 2)]
    described = [f" 0.0.0.0 {date} text/plain {len(b)}\n{b}" for b in blocks]
    versions = spark.range(files).select(
        F.col("id").alias("file"),
        F.lit(0).alias("rank"),
        F.lit(None).cast(pages.schema[id_col].dataType).alias("id"),
        F.concat(F.lit("filedesc://pages-"), F.col("id").cast("string"), F.lit(".arc"), F.when(F.col("id") % 2 == 0, described[0]).otherwise(described[1])).alias("value"),
    )
    order = ["file", "rank", "id"]
    (
        records.unionByName(versions)
        .repartition(files, "file")
        .sortWithinPartitions(*order)
        .select("file", "value")
        .write.partitionBy("file")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")  # they are read twice and then deleted
        .text(path)
    )


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    return reader.load(path).select("path", "content")


def _records(content: bytes) -> Iterator[tuple]:
    """(ARC record, HTTP head, payload, page, digest, record id) of a file, in order."""
    for r in read_arc(opened(content)):
        head, fields, payload = http_parts(r.block)
        digest, page = hashlib.sha256(payload).hexdigest(), fields.get("x-page-id", "")
        yield r, head, payload, page, digest, record_id(r.url, r.date, page, digest)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where every record is, and what decides whether it repeats another one."""
    names = ["path", "pos", "page_id", "record_id", "digest", "bytes"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            rows = [(path.as_py(), i, page, rid, digest, len(payload)) for i, (_, _, payload, page, digest, rid) in enumerate(_records(content.as_py()))]
            if rows:
                yield _batch(rows, names, types)


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with the positions of their repeated records (and the records these repeat) to the bytes of WARC records."""
    for b in batches:
        for content, repeats in zip(b.column(0), b.column(1), strict=True):
            first_of = {x["pos"]: x["first_id"] for x in repeats.as_py() or ()}
            out, size = [], 0
            for i, (r, head, payload, _, digest, rid) in enumerate(_records(content.as_py())):
                first = first_of.get(i)
                block = head + payload if first is None else head
                fields = [
                    ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", warc_date(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip),
                    ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
                    *([] if first is None else [("WARC-Refers-To", f"<{first}>"), ("WARC-Profile", PROFILE)]), ("Content-Length", str(len(block))),
                ]
                lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
                # the writer's line feed completes the two empty lines that end a record
                out.append(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r")
                size += len(out[-1])
                if size > FILE_BYTES:
                    yield _batch([(x,) for x in out], ["value"], [pa.binary()])
                    out, size = [], 0
            if out:
                yield _batch([(x,) for x in out], ["value"], [pa.binary()])


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))[: len(names)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert ARC files to gzipped WARC files.

    Identifiers follow from URL, date, page and digest. Of equal payloads of REVISIT_BYTES or more, the record of the
    smallest page becomes a response, the others become revisits that name it. That is decided on keys; the decisions
    then meet their archive file, so that no payload is shuffled by its digest.
    """
    files = archive_files(spark, arc_path)
    page = F.expr("try_cast(page_id AS bigint)")
    keys = files.mapInArrow(_known, "path string, pos bigint, page_id string, record_id string, digest string, bytes bigint")
    keys = stored(keys.where(F.col("bytes") >= REVISIT_BYTES), "warc-keys")
    firsts = (
        keys.groupBy("digest", "bytes")
        .agg(F.min(page).alias("first_page"), F.min_by("record_id", page).alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_page IS NOT NULL")
        .drop("n")
    )
    again = keys.join(firsts, ["digest", "bytes"]).where(~F.coalesce(page == F.col("first_page"), F.lit(False)))
    # a file has about FILE_BYTES, so its list is bounded
    repeats = stored(again.groupBy("path").agg(F.collect_list(F.struct("pos", "first_id")).alias("repeats")), "warc-repeats")
    records = files.join(repeats, "path", "left").select("content", "repeats").mapInArrow(_warc_records, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").text(warc_path)
    discard(keys)
    discard(repeats)


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "record_id", "refers_id", "record_type", "payload_bytes", "payload_digest"]
    types = [pa.string()] * 4 + [pa.int64(), pa.string()]
    for b in batches:
        for content in b.column(1):
            rows = []
            for fields, block in read_warc(opened(content.as_py())):
                _, http, payload = http_parts(block)
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                kind, size = fields["warc-type"], len(payload)
                if kind == "revisit":
                    size = int(http["content-length"])
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                rows.append((http.get("x-page-id", ""), fields["warc-record-id"].strip("<>"), fields.get("warc-refers-to", "").strip("<>") or None, kind, size, digest))
            if rows:
                yield _batch(rows, names, types)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page of the response) of every record."""
    rows = stored(
        archive_files(spark, path).mapInArrow(
            _warc_rows, "page string, record_id string, refers_id string, record_type string, payload_bytes bigint, payload_digest string"
        ),
        "warc-rows",
    ).withColumn("page_id", F.expr("try_cast(page AS bigint)"))
    responses = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("page_id").alias("refers_to"))
    cited = responses.join(rows.where("refers_id IS NOT NULL").select("refers_id").distinct(), "refers_id", "left_semi")
    return rows.join(cited, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as ARC, convert them to WARC, and read what the WARC files hold of every page.

    The id must be an integer column. Null pages count as empty; payloads under REVISIT_BYTES are always responses. Rows
    that repeat id and page are all responses if theirs is the smallest id; rows without an id cite the smallest one. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert_arc(spark, arc, warc)
    remove(spark, arc)
    found = read_warc_files(spark, warc)
    remove(spark, warc)
    return found.withColumnRenamed("page_id", id_col)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


SQL = {
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_page THEN first_page END AS refers_to
        FROM f"""
}
