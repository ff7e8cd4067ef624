"""Content-addressed archive of web records.

Payload bytes are stored once, under the SHA-256 of the bytes, in a table bucketed by the row that
brought them; the exact header block of every record is kept apart. Type, ids, digest and length of
a record are read from its header block. Original records come back through joins: each header meets
the facts of its payload (the digest of the bytes read, their length, the bytes themselves where they
are few), and each response with a larger payload meets the one row that holds it, where that row
lies. Every payload read is hashed again and held against the digest in the header.

Of records with equal payloads of at least `min_bytes` bytes the one with the smallest page_id is
a `response`, the others are `revisit`s that name it; smaller ones are all responses. Null html is
an empty payload. Null page ids never stand for a payload; where all ids of a payload are null,
all its records are responses. Repeated rows of one page stay as many records, which share a record id.
Very long payloads are moved as whole values, one at a time. Empty tables give empty archives.
Further columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.llm.common import stage

CRLF = "\r\n"
#: Payloads up to this size travel with their facts, so that a small one which many records share is met by all of them.
INLINE_BYTES = 1_024


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def header_field(name: str) -> Column:
    """The value of a field of the column `header`; an empty text if the block has none."""
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)


def _page_of(name: str, page_id_type: str) -> Column:
    return F.nullif(F.regexp_extract(header_field(name), "^<urn:page:(.*)>$", 1), F.lit("")).cast(page_id_type)


def _header_block(date: str) -> Column:
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate("url", "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def _row_key(page_id: str) -> Column:
    return F.concat_ws("|", "payload_digest", F.coalesce(F.col(page_id).cast("string"), F.lit("")))


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes `pages` (page_id, url, html) to `path`/headers and `path`/payloads; returns the name of the payloads' table in the catalog."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    narrow = stage(whole.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest"), "warc-digests")
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    joined = narrow.join(first, "payload_digest")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", _row_key("first_id").alias("row_key"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )
    records.select("row_key", _header_block(date).alias("header")).write.parquet(f"{path}/headers")
    # The row that brings the bytes is found by digest and id together, so no popular payload gathers in one task.
    chosen = first.select(_row_key("first_id").alias("row_key"))
    keyed = whole.select(_row_key("page_id").alias("row_key"), "payload_digest", "payload")
    store = keyed.join(chosen, "row_key", "left_semi").dropDuplicates(["row_key"])
    name = f"warc_payloads_{uuid.uuid4().hex}"
    # As many buckets as the join has partitions: each task writes the buckets that it holds.
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 50_000)
    store.write.format("parquet").option("path", f"{path}/payloads").bucketBy(buckets, "row_key").saveAsTable(name)
    return name


def payloads(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The stored payloads with the digest under which each is kept, the digest of the bytes read, and their length."""
    schema = "row_key string, payload_digest string, payload binary"
    stored = spark.table(table) if table else spark.read.schema(schema).parquet(f"{path}/payloads")
    return stored.select(
        "row_key",
        F.col("payload_digest").alias("stored_digest"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
    )


def read_archive(spark: SparkSession, path: str, *, table: str | None = None, page_id_type: str = "bigint") -> DataFrame:
    """One row a record: page_id, record_type, refers_to, payload_bytes, payload_digest, verified, record (its exact bytes).

    `verified`: the bytes read have the digest that the header names, and the record's body has the length that it names.
    `table` is the name that write_archive returned; without it the payloads are read as files and shuffled.
    """
    headers = spark.read.schema("row_key string, header string").parquet(f"{path}/headers").select(
        "row_key", "header", _page_of("WARC-Record-ID", page_id_type).alias("page_id"), header_field("WARC-Type").alias("record_type"),
        _page_of("WARC-Refers-To", page_id_type).alias("refers_to"), header_field("Content-Length").cast("long").alias("body_bytes"),
        F.regexp_extract(header_field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("stored_digest"),
    )
    kept = payloads(spark, path, table)
    small = F.when(F.col("payload_bytes") <= INLINE_BYTES, F.col("payload"))
    out = headers.join(kept.select("stored_digest", "payload_digest", "payload_bytes", small.alias("small")), "stored_digest")
    bodies = (spark.table(table) if table else kept).select(F.col("row_key").alias("body_key"), F.col("payload").alias("large"))
    # Only responses with large payloads ask for a row, and no two for the same one unless min_bytes is above INLINE_BYTES; others ask for none, under keys of their own.
    asks = (F.col("record_type") == "response") & (F.col("payload_bytes") > INLINE_BYTES)
    none = F.concat(F.lit("none|"), F.xxhash64("header").cast("string"))
    out = out.withColumn("asked", F.when(asks, F.col("row_key")).otherwise(none)).join(bodies, F.col("asked") == F.col("body_key"), "left")
    ends = F.lit((CRLF * 2).encode())
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.coalesce("small", "large"))
    return out.select(
        "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest",
        ((F.col("payload_digest") == F.col("stored_digest")) & (F.octet_length(body) == F.col("body_bytes"))).alias("verified"),
        F.concat(F.col("header").cast("binary"), ends, body, ends).alias("record"),
    )


def export_warc(spark: SparkSession, path: str, out: str, *, compression: str = "gzip") -> None:
    """Writes the archive at `path` as plain WARC files: records end in two line ends, which is the text writer's separator here."""
    records = read_archive(spark, path).select(F.expr(f"substring(record, 1, octet_length(record) - {len(CRLF) * 2})").cast("string").alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", compression).text(out)


def parse_warc(blob: bytes) -> Iterator[tuple[str, bytes]]:
    """(header block, payload) of each record of a WARC file, by Content-Length."""
    at = 0
    while (end := blob.find(b"\r\n\r\n", at)) >= 0:
        header = blob[at:end].decode("utf-8", "replace")
        length = next((int(x.partition(":")[2]) for x in header.split("\r\n") if x.lower().startswith("content-length:")), 0)
        yield header, blob[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (gzip or plain), each file read whole by one task: header, payload."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for blob in batch["content"]:
                blob = bytes(blob)
                rows = list(parse_warc(gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob))
                yield pd.DataFrame(rows, columns=["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "header string, payload binary")
