"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; record headers are kept exactly as
written in a table of their own; original records are headers joined to payloads again.

An archive is a folder with two tables:
  payloads: digest (SHA-256, hex), payload_digest (SHA-1, bare upper-case base32), length, body
  headers:  record_id, page_id, digest, header (exact bytes up to and including the blank line)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_cleanup, stored

#: Fixed by RFC 4648: the base32 alphabet, and the digits that conv() writes in base 32.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(body: Column) -> Column:
    """SHA-1 of binary as 32 base32 letters: 40 hash bits at a time are eight letters."""
    digest = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _uri(page_id: Column, row: Column) -> Column:
    """A record's id: its page_id and, as page_ids can repeat or be null, the number of its row."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _header(kind: str, date: Column) -> Column:
    """The header block of a response or of a revisit. A null url writes an empty target."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))
    lines = [
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.lit(kind)), field("WARC-Record-ID", F.col("record_id")), field("WARC-Date", date),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
    ]
    if kind == "revisit":
        lines += [field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", _uri(F.col("first.page_id"), F.col("first.row")))]
    lines += [field("Content-Type", F.lit("text/html")), field("Content-Length", F.col("length") if kind == "response" else F.lit(0)), F.lit("\r\n")]
    return F.concat(*lines)


def write_archive(pages: DataFrame, path: str | None = None, min_revisit: int = 0, date: str | None = None) -> str:
    """Write one record per row of pages (page_id, url, html) and return the archive's path.

    A null html is an empty payload. Of equal payloads of at least min_revisit bytes the one
    with the smallest page_id (null last) is the response and the others revisit it; repeated
    rows of that very page_id stay responses. date is the records' WARC-Date (ISO 8601 in
    UTC; the time of writing where none is given). Other columns of pages are ignored. An
    empty table gives an empty archive. Copies meet only as digests: the bodies of a group
    are reduced to one before the shuffle.
    """
    spark, path = pages.sparkSession, path or shared_dir(pages.sparkSession)
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    rows = stored(keyed.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "digest"))
    with shuffle_cleanup(spark):
        (keyed.groupBy("digest").agg(F.first("body").alias("body"))
            .select("digest", sha1_base32(F.col("body")).alias("payload_digest"), F.octet_length("body").cast("long").alias("length"), "body")
            .write.parquet(f"{path}/payloads"))
        first = rows.groupBy("digest").agg(F.min_by(F.struct("page_id", "row"), F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("first"))
        store = spark.read.parquet(f"{path}/payloads").drop("body").join(first, "digest")
        linked = rows.join(store, "digest").withColumn("record_id", _uri(F.col("page_id"), F.col("row"))).withColumn(
            "revisit", (F.col("length") >= min_revisit) & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        (linked.select("record_id", "page_id", "digest", F.when(F.col("revisit"), _header("revisit", when)).otherwise(_header("response", when)).cast("binary").alias("header"))
            .write.parquet(f"{path}/headers"))
    return path


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The archive's payloads with both digests taken again from the stored bytes; a damaged body raises."""
    held = spark.read.parquet(f"{path}/payloads")
    damaged = (F.sha2("body", 256) != F.col("digest")) | (sha1_base32(F.col("body")) != F.col("payload_digest")) | (F.octet_length("body") != F.col("length"))
    stop = F.raise_error(F.concat(F.lit("damaged payload "), "digest"))
    return held.withColumns({"length": F.when(damaged, stop.cast("long")).otherwise(F.col("length")), "body": F.when(damaged, stop.cast("binary")).otherwise(F.col("body"))})


def field(header: Column, name: str) -> Column:
    """A header field's value; null where the record has none."""
    value = F.regexp_extract(header, rf"(?m)^{name}: ?([^\r\n]*)", 1)
    return F.when(value != "", value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: exact header bytes, their block (empty for a revisit), and the full payload by join."""
    heads = spark.read.parquet(f"{path}/headers")
    joined = heads.join(verified_payloads(spark, path).select("digest", F.col("body").alias("payload")), "digest")
    kind = field(F.decode("header", "UTF-8"), "WARC-Type")
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("record_id", "page_id", kind.alias("record_type"), "header", block.alias("block"), "payload",
                         F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def archive_report(pages: DataFrame, path: str | None = None, min_revisit: int = 0) -> DataFrame:
    """Write pages to an archive, read its records back, and report per page what they hold.

    Every record is put together from header and payload; lengths and digests are taken from
    the full payload so found, and a header that names another digest, or another length of
    its block, raises.
    """
    spark = pages.sparkSession
    records = read_records(spark, write_archive(pages, path, min_revisit)).withColumns({"text": F.decode("header", "UTF-8"), "payload_digest": sha1_base32(F.col("payload"))})
    refers = F.regexp_extract(F.coalesce(field(F.col("text"), "WARC-Refers-To"), F.lit("")), r"^<urn:page:(.*):\d+>$", 1)
    agrees = (field(F.col("text"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")) & (field(F.col("text"), "Content-Length").cast("long") == F.octet_length("block"))
    digest = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    kind = dict(pages.dtypes)["page_id"]
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type",
        F.when(refers != "", refers).cast(kind).alias("refers_to"), field(F.col("text"), "WARC-Target-URI").alias("url"), F.octet_length("record").cast("long").alias("record_bytes"))
