"""A content-addressed WARC archive.

An archive is two tables: payload bytes, each stored once under its SHA-256, and the exact
header bytes of every record. Original records come back by joining the two. Payloads that
meet under one digest are verified to agree in length and SHA-1 before one is kept.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simjoin.llm.common import frequent, own_columns, shared_dir, stored, uneven_join

#: Payloads below this many bytes are always stored as responses.
REVISIT_FROM = 1000
URN = "urn:simjoin:page:"
#: Bytes of a payload that may be broadcast.
SMALL = 4_096
# Fixed values of the WARC and HTTP formats.
VERSION, CRLF, PROFILE = "WARC/1.1", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


@dataclass(frozen=True)
class Archive:
    """The folders of an archive's two tables, below one shared folder."""

    path: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/payloads")


def _described(pages: DataFrame) -> DataFrame:
    """Digests and sizes, in the JVM, without the payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), "url", F.sha2(body, 256).alias("digest"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n_bytes"))


def _packed(pages: DataFrame) -> DataFrame:
    """(digest, sha1, n_bytes, body): the payload is compressed before it moves anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                bodies = [b.as_py() for b in batch.column(0).slice(at, 512)]
                rows = {"digest": [hashlib.sha256(b).hexdigest() for b in bodies], "sha1": [hashlib.sha1(b).hexdigest() for b in bodies], "n_bytes": [len(b) for b in bodies], "body": pa.array([zlib.compress(b, 6) for b in bodies], pa.binary())}
                yield pa.RecordBatch.from_pydict(rows)

    return pages.select(F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body")).mapInArrow(run, "digest string, sha1 string, n_bytes long, body binary")


def _lines(*lines: Column) -> Column:
    return F.concat(*[F.concat(x, F.lit(CRLF)) for x in lines], F.lit(CRLF))


def _headers(records: DataFrame) -> DataFrame:
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    first = F.col("record_type") == "response"
    length = F.octet_length(http) + F.when(first, F.col("n_bytes")).otherwise(0)
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), "\r", "%0D"), "\n", "%0A")
    common = [F.lit(VERSION), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", urn(F.col("page_id"))), field("WARC-Target-URI", url), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), F.lit("Content-Type: application/http; msgtype=response"), field("Content-Length", length.cast("string"))]
    header = F.when(first, _lines(*common)).otherwise(_lines(*common, F.lit(f"WARC-Profile: {PROFILE}"), field("WARC-Refers-To", urn(F.col("holder")))))
    return records.select(header.cast("binary").alias("header"), http.cast("binary").alias("http"), "digest", first.alias("has_payload"))


def write(pages: DataFrame, path: str | None = None, revisit_from: int = REVISIT_FROM) -> Archive:
    """Archives the pages (page_id, url, html) and returns where.

    Of the records with equal payloads of at least ``revisit_from`` bytes, that with the
    largest page_id is a response and the others revisit it; smaller payloads are always
    responses, though their bytes too are stored once. ``path`` defaults to a new folder in
    the session's shared folder.

    A null html is an empty payload. A null page_id is never the response that others
    revisit, unless all of them are null: then all are responses. Repeated rows of the
    largest page_id are responses each. Extra columns are ignored; an empty table gives an
    archive without records.
    """
    archive = Archive(path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    pages = own_columns(pages, "page_id", "url", "html")
    agree = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("sha1") == F.max("sha1"))
    kept = _packed(pages).groupBy("digest").agg(F.first("body").alias("body"), F.max("n_bytes").alias("n_bytes"), agree.alias("agree"), F.count("*").alias("copies"))
    kept = kept.select("digest", "n_bytes", "copies", F.when(F.col("agree"), F.col("body")).otherwise(F.raise_error(F.lit("different payloads have one digest")).cast("binary")).alias("body"))
    kept.write.parquet(f"{archive.path}/payloads")
    described, spark = _described(pages), pages.sparkSession
    large = described.where(F.col("n_bytes") >= revisit_from)
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"))
    hot = frequent(archive.payloads(spark).select("digest", "copies"), archive.payloads(spark).agg(F.sum("copies")).first()[0] or 0)
    records = uneven_join(large, holders, hot, "digest", "left")
    records = records.unionByName(described.where(F.col("n_bytes") < revisit_from).withColumn("holder", F.lit(None).cast("long")))
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    _headers(records.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))).write.parquet(f"{archive.path}/headers")
    return archive


def records(archive: Archive, spark: SparkSession) -> DataFrame:
    """The exact bytes of every record (one column, ``record``), as a WARC file holds them.

    Payloads of up to ``SMALL`` bytes that very many records have, as empty ones, are
    broadcast, a thousand at most. A payload that no longer has its digest is an error. Nulls
    are as the archive has them; an archive without records gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)
                out = [h + p + (b"" if b is None else _checked(zlib.decompress(b), d)) + b"\r\n\r\n" for h, p, d, b in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    headers, payloads = archive.headers(spark), archive.payloads(spark)
    hot = frequent(payloads.where(F.col("n_bytes") <= SMALL).select("digest", "copies"), headers.count())
    whole = uneven_join(headers.where("has_payload"), payloads.select("digest", "body"), hot, "digest").select("header", "http", "digest", "body")
    bare = headers.where("not has_payload").select("header", "http", "digest", F.lit(None).cast("binary").alias("body"))
    return whole.unionByName(bare).mapInArrow(run, "record binary")


def _checked(body: bytes, digest: str) -> bytes:
    if hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"stored payload {digest} is damaged")
    return body


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


PARSED = "page_id long, record_type string, target string, stated_digest string, refers_to long, payload binary"


def parsed(records: DataFrame) -> DataFrame:
    """The records (``record``: bytes of one or more records) with their fields and payloads.

    Ids that are not of this archive's form are null, as the payload of a revisit is; other
    columns are ignored, repeated rows are records each, and a null record is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn) if (urn := urn.removeprefix(f"<{URN}").removesuffix(">")).lstrip("-").isdigit() else None
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for fields, block in parse(data.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if fields["warc-type"] == "response" else None
                    rows.append((number(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-payload-digest"), number(fields.get("warc-refers-to", "")), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "record_type", "target", "stated_digest", "refers_to", "payload"])

    return records.select("record").mapInArrow(run, PARSED)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files, each file read whole by one task; an empty file has none."""
    return parsed(spark.read.format("binaryFile").load(path).select(F.col("content").alias("record")))


def read(archive: Archive, spark: SparkSession) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to.

    Size and digest are computed from the bytes read back; a revisit has those of the
    response it refers to, which must agree with the digest in its own header.
    """
    sha1 = F.sha1("payload")
    rows = parsed(records(archive, spark)).select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1.alias("payload_digest"), F.substring_index("stated_digest", ":", -1).alias("stated"))
    rows = stored(rows, "warc-read")
    first = rows.where("record_type = 'response'")
    full = first.where("page_id is not null").dropDuplicates(["page_id"]).select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    revisits = rows.where("record_type = 'revisit'")
    hot = stored(frequent(revisits.groupBy("refers_to").agg(F.count("*").alias("copies")), rows.count()), "warc-hot")
    again = uneven_join(revisits, full, hot, "refers_to", "left").withColumns({"payload_bytes": F.col("n"), "payload_digest": F.col("d")}).select(first.columns)
    same = F.col("stated") == F.col("payload_digest")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload read back differs from its record's digest")))
    return first.unionByName(again).select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
