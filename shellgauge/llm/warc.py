"""A content-addressed WARC archive.

Three Parquet tables make an archive: ``payloads`` holds every distinct payload
once, under its SHA-256 and SHA-1; ``headers`` holds the exact header block of
every record, with the digest of the payload it speaks of; a record is the join
of both. Reading hashes the stored bytes again and fails on any difference.

Of the records whose payloads are equal and of at least ``least_bytes`` bytes,
the one with the largest key is the response and stores the payload; the others
are revisits that refer to it. Smaller payloads are responses each, but their
bytes too are stored once.

Only keys and digests are shuffled to find the stored copies, combined before
they move, so a payload shared by a third of all rows is one counter per task.
Payload bytes move once, by key, and never by digest.

Headers are exact: a URI that a header line cannot hold is percent-encoded and read
back as it was, as are keys, so no value can end its line or start another field.

Null payloads read as empty. A null URI gives no field. A row without a key refers to the largest key of
its group and is a response where there is none. Rows that repeat the largest
key are responses all. Empty tables make empty archives. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellgauge.llm.common import text_or_empty

#: The base32 alphabet, and the line end of header blocks.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
WARC_DATE = "1970-01-01T00:00:00Z"
#: Controls, and what some readers take for the end of a line: the inside of a character class.
NOT_IN_A_LINE = r"\x00-\x1F\x7F-\x9F\u2028\u2029"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 characters."""
    digest, alphabet = F.sha1(payload), F.lit(BASE32)

    def four(group: Column) -> Column:
        bits = F.conv(group, 16, 10).cast("int")
        return F.concat(*[F.substring(alphabet, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[four(F.substring(digest, 5 * k + 1, 5)) for k in range(8)])


def header_block(fields: list[tuple[str, Column]]) -> Column:
    """A WARC header block; fields whose value is NULL are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(CRLF))


def header_value(block: Column, name: str) -> Column:
    """The value of a header field; NULL where the block has none, or an empty one. Only CRLF ends a line."""
    return F.nullif(F.regexp_extract(block, rf"(?md)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))


def record_uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.url_encode(key.cast("string")), F.lit(">"))


def record_key(uri: Column) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(uri, r"<urn:record:(.*)>", 1), F.lit("")))


def uri_fields(uri: Column) -> list[tuple[str, Column]]:
    """The fields of a target URI. One that a header line cannot hold is written in percent-encoding, and a field says so."""
    held = uri.rlike(rf"\A[^{NOT_IN_A_LINE}]+\z")
    return [
        ("WARC-Target-URI", F.when(held, uri).otherwise(F.url_encode(uri))),
        ("X-Target-URI-Encoding", F.when(~held, F.lit("percent"))),
    ]


def target_uri(block: Column) -> Column:
    """The target URI as it was before writing; NULL where the record has none."""
    value = header_value(block, "WARC-Target-URI")
    encoded = header_value(block, "X-Target-URI-Encoding").isNotNull()
    return F.when(encoded, F.url_decode(F.coalesce(value, F.lit("")))).otherwise(value)


def write_archive(df: DataFrame, at: str, key: str = "page_id", payload: str = "html", uri: str = "url", least_bytes: int = 0) -> None:
    """Write one record for every row into an archive at ``at``."""
    spark = df.sparkSession
    body = text_or_empty(payload).cast("binary")
    rows = df.select(F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("body"))
    rows.select(
        "key", "uri", F.sha2("body", 256).alias("sha256"), base32_sha1(F.col("body")).alias("sha1"),
        F.length("body").cast("long").alias("bytes"),
    ).write.parquet(f"{at}/index")
    index = spark.read.parquet(f"{at}/index")
    # the stored copy of each digest: its largest key, or a row without a key where it has no other
    largest = index.groupBy("sha256").agg(F.max("key").alias("largest"))
    placed = index.join(largest, "sha256")
    response = (F.col("bytes") < least_bytes) | F.col("largest").isNull() | F.col("key").eqNullSafe(F.col("largest"))
    kind = F.when(response, "response").otherwise("revisit")
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    block = header_block([
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_uri(F.col("key"))),
        ("WARC-Date", F.lit(WARC_DATE)),
        *uri_fields(F.col("uri")),
        ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", F.when(~response, record_uri(F.col("largest")))),
        ("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0))),
    ])
    placed.select("key", block.alias("header"), "sha256").write.parquet(f"{at}/headers")
    stored = largest.select("sha256", F.col("largest").alias("key")).filter(F.col("key").isNotNull())
    keyed = rows.filter(F.col("key").isNotNull()).withColumn("sha256", F.sha2("body", 256)).select("key", "sha256", "body")
    once = keyed.join(stored, ["key", "sha256"], "left_semi").dropDuplicates(["key", "sha256"])
    orphans = largest.filter(F.col("largest").isNull()).select("sha256")
    unkeyed = rows.filter(F.col("key").isNull()).withColumn("sha256", F.sha2("body", 256))
    unkeyed = unkeyed.join(orphans, "sha256", "left_semi").select("key", "sha256", "body").dropDuplicates(["sha256"])
    once.unionByName(unkeyed).select(
        "sha256", base32_sha1(F.col("body")).alias("sha1"), F.length("body").cast("long").alias("bytes"), "body"
    ).write.parquet(f"{at}/payloads")


def _checked_payloads(spark: SparkSession, at: str) -> DataFrame:
    """The stored payloads, each hashed again; a wrong digest ends the job."""
    stored = spark.read.parquet(f"{at}/payloads")
    same = (F.sha2("body", 256) == F.col("sha256")) & (base32_sha1(F.col("body")) == F.col("sha1")) & (F.length("body") == F.col("bytes"))
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("sha256")))
    return stored.withColumn("sha256", F.when(same, F.col("sha256")).otherwise(wrong))


def read_headers(spark: SparkSession, at: str, key_type: str = "long") -> DataFrame:
    """Every record's fields, read from its header block, with what the stored payload measures."""
    block = F.col("header")
    number = lambda name: record_key(header_value(block, name))
    fields = spark.read.parquet(f"{at}/headers").select(
        number("WARC-Record-ID").cast(key_type).alias("key"),
        target_uri(block).alias("uri"),
        header_value(block, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").cast(key_type).alias("refers_to"),
        F.regexp_extract(header_value(block, "WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"),
        "sha256",
    )
    payloads = _checked_payloads(spark, at).select("sha256", F.col("sha1").alias("stored_digest"), F.col("bytes").alias("payload_bytes"))
    differs = F.raise_error(F.concat(F.lit("no stored payload for the record's digest: "), F.col("payload_digest")))
    return fields.join(payloads, "sha256", "left").withColumn(
        "payload_digest",
        F.when(F.col("payload_digest") == F.col("stored_digest"), F.col("payload_digest")).otherwise(differs),
    ).drop("stored_digest")


def read_records(spark: SparkSession, at: str) -> DataFrame:
    """Every record as bytes: header block, payload (none in a revisit), two line ends; and the full ``payload``."""
    payloads = _checked_payloads(spark, at).select("sha256", "body")
    joined = spark.read.parquet(f"{at}/headers").join(payloads, "sha256")
    own = F.when(header_value(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("body"))
    record = F.concat(F.col("header").cast("binary"), own, F.lit((CRLF * 2).encode()))
    return joined.select("key", record.alias("record"), F.col("body").alias("payload"))
