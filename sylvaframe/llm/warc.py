"""Content-addressed WARC archive.

An archive is a folder with two tables. ``payloads`` holds the bytes of every distinct payload once, under their
SHA-256. ``headers`` holds, for each page, the exact bytes of its record's WARC header, the digest and length
of its payload and the type of the record. ``read_records`` joins the tables on the digest and gives back the
original records, byte by byte, after hashing each stored payload again.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes, those with the smallest page id are
responses and all others are revisits that name it; smaller payloads are always responses. A revisit record ends after its
header; the payload that it stands for is joined back for reading.

Two payloads count as equal if length, SHA-256 and SHA-512 are; a digest that meets two of them stops the
write. A null payload is the empty one. Null urls are written as an empty target. A page id that repeats with the same payload gives as many
responses; a null page id comes after all others and is named by no revisit. No pages give two empty tables.
Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

LEAST_BYTES = 100
CRLF = "\r\n"
#: Time stamp of the records: fixed, so that equal pages make equal archives.
DATE = "1970-01-01T00:00:00Z"


def _header(kind: Column, page: Column, url: Column, digest: Column, length: Column, refers: Column) -> Column:
    def line(name, *value):
        return F.concat(F.lit(name + ": "), *value, F.lit(CRLF))

    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.lit("<urn:page:"), F.coalesce(page, F.lit("")), F.lit(">")),
        line("WARC-Date", F.lit(DATE)),
        # a line break in an address would end the header
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "")),
        line("WARC-Payload-Digest", F.lit("sha256:"), digest),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.lit("<urn:page:"), refers, F.lit(">")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write the archive of ``pages`` (payload: binary, or a string in UTF-8) to a new folder ``path``.

    The payloads move once, to meet their copies; everything else runs on ids, digests and lengths.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    hashed = src.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})

    # one copy of the bytes for each digest; the stronger digest tells whether all copies are the same
    (
        hashed.select("digest", "payload_bytes", F.sha2("payload", 512).alias("second"), "payload")
        .groupBy("digest")
        .agg(F.first("payload").alias("payload"), F.min("second").alias("a"), F.max("second").alias("b"), F.min("payload_bytes").alias("m"), F.max("payload_bytes").alias("n"))
        .select("digest", F.when((F.col("a") == F.col("b")) & (F.col("m") == F.col("n")), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads under one digest"))).alias("payload"))
        .write.parquet(f"{path}/payloads")
    )

    records = hashed.select("page_id", "url", "digest", "payload_bytes")
    first = records.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, F.col("first_id"))
    (
        records.join(first, "digest", "left")
        .select(
            "page_id",
            "digest",
            "payload_bytes",
            kind.alias("record_type"),
            _header(kind, F.col("page_id").cast("string"), F.col("url"), F.col("digest"), F.col("payload_bytes"), refers.cast("string")).cast("binary").alias("header"),
        )
        .write.parquet(f"{path}/headers")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: ``page_id``, ``header`` (its exact bytes), ``payload`` (of a revisit that of the record it
    refers to) and ``record``, the bytes of the whole WARC record. A payload that no longer has its digest raises an error."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    checked = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload has changed"))).alias("payload"))
    end = F.lit((CRLF * 2).encode())
    return headers.join(checked, "digest").select(
        "page_id",
        "header",
        "payload",
        F.concat("header", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")), end).alias("record"),
    )


def parsed(records: DataFrame) -> DataFrame:
    """What the records themselves say: type, target, digest and reference out of the header bytes, and the
    length and digest of the payload that was read."""
    text = F.decode("header", "UTF-8")

    def field(name):
        return F.nullif(F.regexp_extract(text, f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1), F.lit(""))

    return records.select(
        "page_id",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("header_digest"),
        F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1).alias("refers_to"),
    )


def facts(records: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``, out of the bytes of ``record`` alone.

    A record is split into header and block by its Content-Length; a revisit has the length and digest of the block of the
    response that it refers to. A record of another length, or whose payload hasn't the digest in its header, raises an error.
    """
    end = CRLF * 2
    text = F.decode("record", "ISO-8859-1")  # one character a byte
    cut = records.select("page_id", "record", (F.locate(end, text) + 3).alias("_cut"))
    cut = cut.select("page_id", "record", "_cut", F.decode(F.substring("record", F.lit(1), F.col("_cut")), "UTF-8").alias("_head"))

    def field(name):
        return F.regexp_extract("_head", f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)

    size = field("Content-Length").cast("bigint")
    whole = F.octet_length("record") == F.col("_cut") + size + len(end)
    block = F.when(whole, F.substring("record", F.col("_cut") + 1, size.cast("int"))).otherwise(F.raise_error(F.lit("a record has not the length in its header")))
    read = stored(
        cut.select(
            "page_id",
            size.alias("_size"),
            F.sha2(block, 256).alias("_own"),
            field("WARC-Type").alias("record_type"),
            F.regexp_extract(field("WARC-Record-ID"), "^<urn:page:(.*)>$", 1).alias("_id"),
            F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("_told"),
            F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1).alias("refers_to"),
        ),
        "warc-facts",
    )
    revisit = F.col("record_type") == "revisit"
    named = read.where(~revisit).groupBy(F.col("_id").alias("refers_to"), F.col("_own").alias("_told")).agg(F.max("_size").alias("_bytes")).withColumn("_digest", F.col("_told"))
    digest, length = F.when(revisit, F.col("_digest")).otherwise(F.col("_own")), F.when(revisit, F.col("_bytes")).otherwise(F.col("_size"))
    told = F.when(digest == F.col("_told"), digest).otherwise(F.raise_error(F.lit("a record has not the payload that its header names")))
    return read.join(named, ["refers_to", "_told"], "left").select("page_id", length.alias("payload_bytes"), told.alias("payload_digest"), "record_type", "refers_to")


def write_warc_files(records: DataFrame, path: str) -> None:
    """The records as plain ``.warc`` text files, for payloads that are UTF-8: each ends with the two line
    breaks that end a WARC record."""
    records.select(F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8").alias("value")).write.option("lineSep", CRLF * 2).text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """``header`` and ``block`` (bytes) of every record in plain WARC files, by the lengths that the headers tell; a record without one raises an error."""
    import re

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                at, headers, blocks = 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    told = re.search(rb"\r\nContent-Length: *(\d+) *\r\n", data[at:end], re.IGNORECASE)
                    if told is None:
                        raise ValueError("a WARC record does not tell its Content-Length")
                    size = int(told[1])
                    headers.append(data[at:end])
                    blocks.append(data[end : end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.binary()), pa.array(blocks, pa.binary())], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, block binary")
