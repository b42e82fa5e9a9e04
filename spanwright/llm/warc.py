"""Content-addressed archive of WARC records (operator 5).

A record is header block, CRLF CRLF, block, CRLF CRLF. Its payload is the block, but for records of type request
or response with an HTTP content type: there the block begins with HTTP's own headers, up to the first blank line, and
the payload is what follows them. Archiving keeps two tables: one row per record with its exact header bytes,
HTTP's among them, and its payload's key, and one row per distinct payload. The key is the SHA-256 digest with the
length and a second, independent hash, so that a payload is shared only where all three agree.

WARC-Payload-Digest is verified where its algorithm is sha256, sha1 or md5, in hexadecimal or (sha1, sha256) base 32:
`digest_ok` is true where it agrees, false where it doesn't or where the value can't be read, null where the record
names none or another algorithm. A record whose header names another digest than its payload has is kept under
the digest that its payload has. Joining the tables on the key gives the original bytes; the joined payload is hashed
again, and `verified` says whether it still has its key.

Defined results: a record without the blank line, or with fewer block bytes than its
Content-Length says, can't be split; all of it is then its header, `parsed` is false, and the empty
payload belongs to it. An HTTP block without a blank line is all payload. Bytes after the block are kept as
the trailer. Null records are dropped. Null ids stay; repeated rows stay, each its own record, with one payload. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.common import ident, table

BLANK = "\r\n\r\n"
KEY = ["digest", "payload_bytes", "check"]


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, empty where there is none; names in any case."""
    return F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


#: Base 32 digits by value, as RFC 4648 has them and as conv() reads them.
_BASE32, _CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_to_hex(value: Column, n_bytes: int) -> Column:
    """Lower-case hexadecimal digits of a base 32 value of n_bytes; null where it has other digits or another length.

    Eight digits are five bytes; padding is dropped, and the last group filled up with zero bits.
    """
    digits = -(-n_bytes * 8 // 5)
    plain = F.rpad(F.translate(F.upper(F.rtrim(value, F.lit("="))), _BASE32, _CONV32), -(-digits // 8) * 8, "0")
    groups = [F.lpad(F.conv(F.substring(plain, i + 1, 8), 32, 16), 10, "0") for i in range(0, -(-digits // 8) * 8, 8)]
    good = F.upper(value).rlike(f"^[A-Z2-7]{{{digits}}}=*$")
    return F.when(good, F.lower(F.substring(F.concat(*groups), 1, 2 * n_bytes)))


def digest_agrees(named: Column, payload: Column) -> Column:
    """Whether a WARC digest header's value is that of the payload; null for none and for other algorithms."""
    algorithm, value = F.lower(F.substring_index(named, ":", 1)), F.trim(F.substring_index(named, ":", -1))

    def either(own: Column, n_bytes: int) -> Column:
        read = F.when(F.lower(value).rlike(f"^[0-9a-f]{{{2 * n_bytes}}}$"), F.lower(value)).otherwise(base32_to_hex(value, n_bytes))
        return F.coalesce(read == own, F.lit(False))

    known = F.when(algorithm == "sha256", either(F.sha2(payload, 256), 32)).when(algorithm == "sha1", either(F.sha1(payload), 20)).when(algorithm == "md5", either(F.md5(payload), 16))
    return F.when(named.contains(":"), known)


def split_records(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """record_id, header, payload, trailer (binary), parsed, digest, payload_bytes, check, digest_ok."""
    record = ident(record_col).cast("binary")
    rows = records.select(ident(id_col).alias("record_id"), record.alias("record")).where("record is not null")
    # latin-1 reads any bytes, one character each, so that places in the text are places in the bytes
    text = F.decode("record", "ISO-8859-1")
    head = F.substring_index(text, BLANK, 1)
    rows = rows.withColumn("head", head).withColumn("at", F.length("head") + 4)
    length = header_field(F.col("head"), "Content-Length")
    rows = rows.withColumn("size", length.try_cast("int"))
    rows = rows.withColumn("parsed", F.coalesce((F.col("size") >= 0) & (F.col("at") + F.col("size").cast("long") <= F.octet_length("record")), F.lit(False)))
    part = lambda start, size: F.substring(F.col("record"), start, size)
    is_http = F.lower(header_field(F.col("head"), "WARC-Type")).isin("request", "response") & F.lower(header_field(F.col("head"), "Content-Type")).startswith("application/http")
    block = part(F.col("at") + 1, F.col("size"))
    own = F.length(F.substring_index(F.decode(block, "ISO-8859-1"), BLANK, 1)) + 4  # HTTP's headers with their blank line
    rows = rows.withColumn("http", F.when(F.col("parsed") & is_http & (own <= F.col("size")), own).otherwise(0))
    whole, most = F.octet_length("record"), F.lit(2147483647)
    rows = rows.select(
        "record_id",
        F.when(F.col("parsed"), part(F.lit(1), F.col("at") + F.col("http"))).otherwise(F.col("record")).alias("header"),
        F.when(F.col("parsed"), part(F.col("at") + F.col("http") + 1, F.col("size") - F.col("http"))).otherwise(F.lit(b"")).alias("payload"),
        F.when(F.col("parsed") & (F.col("at") + F.col("size") < whole), part(F.col("at") + F.col("size") + 1, most)).otherwise(F.lit(b"")).alias("trailer"),
        "parsed",
        header_field(F.col("head"), "WARC-Payload-Digest").alias("named"),
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload"), "check": F.xxhash64("payload")})
    return rows.withColumn("digest_ok", digest_agrees(F.col("named"), F.col("payload"))).drop("named")


def archive(records: DataFrame, id_col: str = "record_id", record_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): the records' headers with their payloads' keys; each distinct payload once, with its number of records."""
    rows = split_records(records, id_col, record_col)
    headers = rows.drop("payload")
    payloads = rows.groupBy(*KEY).agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n_records"))
    return headers, payloads


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The headers with n_records, `record`, the original bytes, and `verified`: whether the stored payload has its key's hashes and length."""
    stored = payloads.select(*(F.col(k).alias(f"p_{k}") for k in KEY), "payload", "n_records")
    same = [F.col(k) == F.col(f"p_{k}") for k in KEY]
    joined = headers.join(stored, same).drop(*(f"p_{k}" for k in KEY))
    verified = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes")) & (F.xxhash64("payload") == F.col("check"))
    return joined.withColumns({"record": F.concat("header", "payload", "trailer"), "verified": verified}).drop("payload")


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: "


def page_records(pages: DataFrame) -> DataFrame:
    """record_id, record: the pages as WARC records, null columns as empty: with even ids and without one as resources, with odd ids as
    responses, their HTTP headers before the page."""
    html, url, page = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    response = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    http = F.when(response, F.concat(F.lit(_HTTP), page, F.lit(BLANK))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(response, "response").otherwise("resource"), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page,
        F.lit(">\r\nWARC-Payload-Digest: sha256:"), F.sha2(html.cast("binary"), 256),
        F.lit("\r\nContent-Type: "), F.when(response, "application/http; msgtype=response").otherwise("text/html"),
        F.lit("\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(html)).cast("string"), F.lit(BLANK), http,
    )
    return pages.select(F.col("page_id").alias("record_id"), F.concat(head, html, F.lit(BLANK)).cast("binary").alias("record"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages archived and reconstructed: a row per record, with digests of payload and of the reconstructed record."""
    back = reconstruct(*archive(page_records(table(spark, sf_dir, "pages"))))
    return back.select(
        F.col("record_id").alias("page_id"),
        "digest",
        F.octet_length("header").cast("long").alias("header_bytes"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "n_records",
        "digest_ok",
        "verified",
        F.sha2("record", 256).alias("record_sha256"),
    )


OP5_SQL = """
WITH b AS (SELECT chr(13) || chr(10) AS nl),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(CAST(page_id AS VARCHAR), '') AS page, coalesce(page_id % 2 <> 0, false) AS response, nl FROM pages, b),
t AS (SELECT *, CASE WHEN response THEN 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html' || nl || 'Server: ' || page || nl || nl ELSE '' END AS http FROM p),
h AS (
  SELECT page_id, html, nl, sha256(html) AS digest,
    'WARC/1.0' || nl || 'WARC-Type: ' || CASE WHEN response THEN 'response' ELSE 'resource' END || nl || 'WARC-Target-URI: ' || url
    || nl || 'WARC-Record-ID: <urn:page:' || page || '>' || nl || 'WARC-Payload-Digest: sha256:' || sha256(html)
    || nl || 'Content-Type: ' || CASE WHEN response THEN 'application/http; msgtype=response' ELSE 'text/html' END
    || nl || 'Content-Length: ' || CAST(strlen(http) + strlen(html) AS VARCHAR) || nl || nl || http AS header
  FROM t)
SELECT page_id, digest, CAST(strlen(header) AS BIGINT) AS header_bytes, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  count(*) OVER (PARTITION BY digest) AS n_records, true AS digest_ok, true AS verified,
  sha256(header || html || nl || nl) AS record_sha256
FROM h
"""
