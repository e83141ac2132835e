"""Content-addressed WARC archive.

Two parquet tables in one folder: `payloads` holds each distinct payload once
under its SHA-256, `headers` the exact header block of every record and the
digest of its payload. A record's bytes come back by joining the two; reading
recomputes the digest of the stored bytes and fails on a mismatch.

A target with control characters or line separators is written percent-encoded, and a
header field of its own says so; reading gives the url as it was.

Defined results: null content is empty; null url is written as an empty target;
of equal payloads of at least `min_bytes` the largest page_id is the response
and the others are revisits of it (rows repeated under that id are responses,
too: one record id, one payload); a null page_id is written as an empty id and
comes back null; an empty table gives an empty archive. Extra columns are not archived.
"""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
# Digit alphabets of base 32 as conv() writes it and as RFC 4648 has it
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# what some reader might take for the end of a header line
BREAKS = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"
ENCODED = "X-Target-URI-Encoding"
FILE_BYTES = 1 << 28


def base32_sha1(data) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, RFC_DIGITS)


def _urn(page_id) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _target(url: Column) -> Column:
    """The fields of a url; where it has breaks, those and what percent-decoding would change are encoded."""
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(
        c.rlike(BREAKS) | c.isin("%", "+"), F.url_encode(c)).otherwise(c)), "")
    return F.when(url.rlike(BREAKS), F.concat(encoded, F.lit(f"{CRLF}{ENCODED}: percent"))).otherwise(url)


def _header_block(record_type, page_id, url, digest, length, refers_to, date: str) -> Column:
    content_length = F.when(record_type == "response", length).otherwise(F.lit(0)).cast("string")
    revisit = F.when(record_type == "revisit", F.concat(
        F.lit("WARC-Refers-To: "), _urn(refers_to), F.lit(CRLF),
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")))
    return F.encode(F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), record_type, F.lit(CRLF),
        F.lit("WARC-Record-ID: "), _urn(page_id), F.lit(CRLF),
        F.lit(f"WARC-Date: {date}{CRLF}WARC-Target-URI: "), _target(F.coalesce(url, F.lit(""))), F.lit(CRLF),
        F.lit("WARC-Payload-Digest: sha1:"), digest, F.lit(CRLF),
        F.coalesce(revisit, F.lit("")),
        F.lit("Content-Type: text/html"), F.lit(CRLF),
        F.lit("Content-Length: "), content_length, F.lit(CRLF + CRLF)), "UTF-8")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: datetime.datetime | None = None):
    """Archive pages (page_id, url, html) below path, under one date (now, if none is given).

    Payloads are reduced to one per digest and task before the shuffle, so
    copies of one page never travel. Headers move digests only."""
    date = (date or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    (rows.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.max("page_id").alias("response_id"))
     .withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
     .withColumn("payload_digest", base32_sha1("payload"))
     .write.parquet(f"{path}/payloads"))

    stored_payloads = pages.sparkSession.read.parquet(f"{path}/payloads").drop("payload")
    page_id, response = F.col("page_id"), F.col("response_id")
    is_revisit = (F.col("payload_bytes") >= min_bytes) & ~page_id.eqNullSafe(response)
    record_type = F.when(is_revisit, "revisit").otherwise("response")
    (rows.select("page_id", "url", "sha256").join(stored_payloads, "sha256")
     .select("sha256", _header_block(
         record_type, page_id, F.col("url"), F.col("payload_digest"), F.col("payload_bytes"),
         response, date.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("header"))
     .write.parquet(f"{path}/headers"))


def _field(text: Column, name: str) -> Column:
    # only \r\n ends a line, not the other line ends that Java knows
    return F.regexp_extract(text, rf"(?md)^{name}: ([^\r\n]*)\r$", 1)


def _url(text: Column) -> Column:
    url = _field(text, "WARC-Target-URI")
    return F.when(_field(text, ENCODED) == "percent", F.url_decode(url)).otherwise(url)


def _id_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, record_type, refers_to, url, header (exact bytes),
    payload (a revisit gets that of its response), payload_bytes,
    payload_digest. Fails if stored bytes do not have their digest."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    headers = spark.read.parquet(f"{path}/headers")
    rows = headers.join(payloads, "sha256", "left")
    text = F.decode("header", "UTF-8")
    found = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), base32_sha1("payload"))
    fields = rows.select(
        F.nullif(_id_of(_field(text, "WARC-Record-ID")), F.lit("")).cast("bigint").alias("page_id"),
        _field(text, "WARC-Type").alias("record_type"),
        F.nullif(_id_of(_field(text, "WARC-Refers-To")), F.lit("")).cast("bigint").alias("refers_to"),
        _url(text).alias("url"), "header", "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        found.alias("found"), _field(text, "WARC-Payload-Digest").alias("stated"))
    checked = F.when(F.concat(F.lit("sha1:"), "found") == F.col("stated"), F.col("found")).otherwise(
        F.raise_error(F.concat(F.lit("payload is missing or damaged: "), "stated")))
    return fields.withColumn("payload_digest", checked).drop("found", "stated")


def record_bytes() -> Column:
    """The original record over the rows of read_archive: header block, the
    payload of a response, and the closing blank lines."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), body, F.lit((CRLF + CRLF).encode()))


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record without the bytes, read back and verified."""
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export_warc(spark: SparkSession, path: str, out: str, file_bytes: int = FILE_BYTES, gzip: bool = True):
    """The archive's records as .warc files (UTF-8 payloads) below out/file=*, each of at most
    file_bytes before compression, or of one record.

    The closing blank lines are the writer's line separator, so a file is the
    exact concatenation of its records; a gzip file is one member."""
    def numbered(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        number, size = 0, 0
        for batch in batches:
            files = []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if size and size + n + 4 > file_bytes:
                    number, size = number + 1, 0
                size += n + 4
                files.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), batch.column(0)], names=["file", "record"])

    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    records = read_archive(spark, path).select(F.decode(F.concat(F.col("header"), body), "UTF-8").alias("record"))
    (records.mapInArrow(numbered, "file int, record string").write.partitionBy("file")
     .option("lineSep", CRLF + CRLF).option("compression", "gzip" if gzip else "none").text(out))


def import_warc(spark: SparkSession, files: str) -> DataFrame:
    """Records of .warc files (gzip or plain): header (exact bytes), record_type,
    url and payload. A file is one task's work, so files should be of bounded
    size, as export_warc makes them."""
    def run(batches):
        import zlib

        import pyarrow as pa
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":  # one gzip member or one per record
                    plain, rest = [], data
                    while rest:
                        member = zlib.decompressobj(31)
                        plain.append(member.decompress(rest))
                        rest = member.unused_data
                    data = b"".join(plain)
                headers, payloads, at = [], [], 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    head = data[at:end + 4]
                    length = next(int(line.split(b":", 1)[1]) for line in head.split(b"\r\n")
                                  if line.lower().startswith(b"content-length:"))
                    headers.append(head)
                    payloads.append(data[end + 4:end + 4 + length])
                    at = end + 4 + length + 4
                    if len(headers) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(headers, pa.binary()), pa.array(payloads, pa.binary())],
                                                         names=["header", "payload"])
                        headers, payloads = [], []
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.binary()), pa.array(payloads, pa.binary())],
                                                 names=["header", "payload"])
    content = spark.read.format("binaryFile").load(files).select("content")
    text = F.decode("header", "UTF-8")
    return content.mapInArrow(run, "header binary, payload binary").select(
        "header", _field(text, "WARC-Type").alias("record_type"), _url(text).alias("url"), "payload")
