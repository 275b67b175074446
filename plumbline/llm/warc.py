"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by joins.

An archive is a folder of two Parquet tables.  ``headers`` has one row per
record with the exact bytes of its WARC and HTTP headers and the SHA-256 of its
payload; ``payloads`` has every distinct payload once under that digest, which
is computed again from the stored bytes whenever the archive is read.  Records
are put together by a join of the two on the digest; a digest of very many
records is dealt over several tasks, each with its own copy of the payload.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialize

DATE = "2024-01-01T00:00:00Z"
_CONTROL = r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"
#: Records of one payload that one task puts together.
GROUP = 1024
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits as four numbers of eight digits."""
    digest = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0"), _HEX32, _BASE32) for i in range(4)))


def _record_id(page: Column, sha256: Column) -> Column:
    h = F.sha1(F.concat(F.coalesce(page.cast("string"), F.lit("-")), F.lit(" "), sha256))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _clean(text: Column) -> Column:
    """Control characters and line separators, which no header can hold, percent-encoded."""
    encoded = lambda c: F.when(c.rlike(_CONTROL), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(_CONTROL), F.array_join(F.transform(F.split(text, ""), encoded), "")).otherwise(text)


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    clean = _clean(value.cast("string"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))).otherwise("")


def header_bytes(date: str = DATE) -> Column:
    """The exact headers of a record, from page_id, url, payload_bytes, sha1, sha256, record_type and refers_to."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha256"))),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("sha256")))),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length),
        F.lit("\r\n"),
        http,
    ]
    return F.concat(*lines).cast("binary")


def write_archive(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Archives ``pages`` (page_id, url, payload) below ``path``.

    Of equal payloads of at least ``min_bytes`` the record with the largest
    page_id is the response, the others revisit it.  A null payload is empty; a
    null url has no target line; a null page_id is smaller than any other.
    Rows that repeat page_id and payload of a response are responses too.
    Payloads of any length are stored whole.  Other columns are not read.

    Texts are read twice and shuffled only where they repeat: distinct payloads
    go straight to the store, and the groups of equal ones are a lookup table.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    digests = materialize(rows.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")), "digests")
    groups = digests.groupBy("sha256").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("sha256", "keeper", F.lit(True).alias("shared"))
    groups = materialize(groups, "groups")

    found = lookup(digests, groups, ["sha256"], F.col("page_id"))
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("payload_bytes") >= min_bytes)
    found = found.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("keeper")))
    found.select("page_id", "sha256", "record_type", header_bytes(date).alias("header")).write.parquet(f"{path}/headers")

    stored = lookup(rows.select("page_id", "sha256", "payload"), groups, ["sha256"], F.col("page_id"))
    once = stored.filter("shared is null").select("sha256", "payload")
    again = stored.filter(F.col("shared") & F.col("page_id").eqNullSafe(F.col("keeper"))).select("sha256", "payload").dropDuplicates(["sha256"])
    once.unionByName(again).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _assembled(spark: SparkSession, path: str) -> DataFrame:
    """Every record's header with the stored bytes of its payload: header, sha256, payload."""
    heads = spark.read.parquet(f"{path}/headers").select("sha256", "header")
    store = spark.read.parquet(f"{path}/payloads")
    hot = heads.groupBy("sha256").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("sha256", F.ceil(F.col("n") / GROUP).cast("long").alias("ways"))
    hot = materialize(hot, "hot")
    ways = F.coalesce("ways", F.lit(1).cast("long"))
    heads = lookup(heads.withColumn("at", F.monotonically_increasing_id()), hot, ["sha256"], F.col("at")).select("sha256", "header", F.pmod("at", ways).alias("way"))
    store = lookup(store, hot, ["sha256"], F.col("sha256")).select("sha256", "payload", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"))
    return heads.join(store, ["sha256", "way"], "left").drop("way")


def field(header: Column, name: str) -> Column:
    """A field of header bytes, by the first line that states it; null where none does."""
    lines = F.split(header.cast("string"), "\r\n", -1)
    return F.substring(F.get(F.filter(lines, lambda x: x.startswith(f"{name}: ")), F.lit(0)), F.lit(len(name) + 3), F.octet_length(header))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, record_type, exact ``header`` and ``record`` bytes, the ``payload`` they stand for, ``sha256`` as archived.

    A response is its headers, its payload and the end of a record; a revisit
    has no payload of its own, and ``payload`` is that of the record it refers
    to.  A payload that the archive has lost is null, and so is its response.
    """
    end = F.lit(b"\r\n\r\n")
    rows = _assembled(spark, path).withColumn("record_type", field(F.col("header"), "WARC-Type")).withColumn("page_id", field(F.col("header"), "WARC-Page-ID").cast("long"))
    record = F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end))
    return rows.select("page_id", "record_type", "header", record.alias("record"), "payload", "sha256")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """What the reconstructed records say, checked against the bytes they hold.

    page_id, payload_bytes, payload_digest, record_type, refers_to, verified.
    Fields come from the record's own headers, payload length and digest from
    its payload.  ``verified`` holds where the payload has the SHA-256 it is
    stored under and the SHA-1 and length that the headers state.
    """
    rows = records(spark, path).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    stated = F.regexp_extract(F.col("header").cast("string"), r"Content-Length: (\d+)\r\n\r\n\z", 1).cast("long")
    whole = F.col("record").isNotNull() & (F.sha2("payload", 256) == F.col("sha256")) & (stated == F.col("payload_bytes"))
    sound = whole & (field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest"))
    refers = field(F.col("header"), "WARC-Refers-To-Page-ID").cast("long")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"), F.coalesce(sound, F.lit(False)).alias("verified"))


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file (plain, or gzip by record or as a whole): header fields and block."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = end + 4
        at = block + int(fields["Content-Length"])
        yield fields, data[block:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record does not end at byte {at}")
        at += 4
