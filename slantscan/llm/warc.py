"""WARC archives written and read by Spark, with revisit resolution.

A record's payload is text, so a record is written through Spark's text writer:
the line separator is CR LF, and the text ends with one CR LF, which together
close the record. The files are gzip members, read by one task each from start
to end; the reader takes each record's bytes by its Content-Length, so payloads
may hold anything, record heads included.

Resolution: the records' heads alone are shuffled by payload digest; of equal
payloads the first record stays a response, the others become revisit records
that name it. Only digests that occur more than once are joined back to the
records, and payloads of revisits are dropped before anything is written.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch

LEAST_BYTES = 100  #: shorter payloads are never revisited
FILE_RECORDS = 20_000  #: records in an archive file at most
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  #: the tables have no capture time; a fixed one keeps reruns equal
CRLF = "\r\n"


def records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Response records: record_id, page_id, target_uri, payload, payload_bytes,
    payload_digest (SHA-256, hex). A null payload is empty, a null address "".
    Record ids are numbered by the row's place, so repeated rows differ."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    # an address is one header line: control characters and blanks are percent-encoded
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("target_uri"), payload.alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    p = p.withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    key = F.md5(F.concat_ws(" ", F.monotonically_increasing_id().cast("string"), F.col("page_id").cast("string"), F.col("payload_digest")))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return p.withColumn("record_id", F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts)))


def resolve(recs: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """Adds record_type, refers_to_id and refers_to_uri; payloads of revisits become empty.

    Of records with equal payloads of ``least`` bytes or more the one with the
    smallest page_id (null last; ties: smallest record_id) is the response.
    """
    heads = recs.where(F.col("payload_bytes") >= least)
    rank = F.struct(F.col("page_id").isNull(), "page_id", "record_id", "target_uri")
    first = heads.groupBy("payload_digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.selectExpr("payload_digest AS digest", "first.record_id AS first_id", "first.target_uri AS first_uri")
    first = scratch.save(first, "first")
    r = recs.join(first, (recs.payload_digest == first.digest) & (recs.payload_bytes >= least), "left")
    other = F.coalesce(F.col("first_id") != F.col("record_id"), F.lit(False))
    return r.select(
        "record_id",
        "page_id",
        "target_uri",
        F.when(other, F.lit("revisit")).otherwise("response").alias("record_type"),
        F.when(other, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        "payload_digest",
        F.when(other, F.col("first_id")).alias("refers_to_id"),
        F.when(other, F.col("first_uri")).alias("refers_to_uri"),
    )


def write(recs: DataFrame, path: str) -> None:
    """Write resolved records as WARC/1.1 files under ``path``."""

    def head(name, value):
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))

    c = F.col
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        head("WARC-Type", c("record_type")),
        head("WARC-Record-ID", F.concat(F.lit("<"), c("record_id"), F.lit(">"))),
        head("WARC-Date", F.lit(DATE)),
        head("WARC-Target-URI", c("target_uri")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("payload_digest"))),
        head("WARC-Refers-To", F.concat(F.lit("<"), c("refers_to_id"), F.lit(">"))),
        head("WARC-Refers-To-Target-URI", c("refers_to_uri")),
        head("WARC-Refers-To-Date", F.when(c("refers_to_id").isNotNull(), F.lit(DATE))),
        head("WARC-Profile", F.when(c("refers_to_id").isNotNull(), F.lit(PROFILE))),
        head("X-Page-ID", c("page_id").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        head("Content-Length", F.octet_length("payload").cast("string")),
        F.lit(CRLF),
        c("payload"),
        F.lit(CRLF),
    )
    out = recs.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip")
    out.option("maxRecordsPerFile", FILE_RECORDS).text(path)


FIELDS = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "WARC-Target-URI": "target_uri",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Refers-To": "refers_to_id",
    "WARC-Refers-To-Target-URI": "refers_to_uri",
    "X-Page-ID": "page_id",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS.values()) + ", payload binary"


def _parse(batches):
    """Lines of archive files, in order -> a row per record."""
    head, need, body, blank = None, 0, [], 0
    done: list[dict] = []
    size = 0
    for b in batches:
        for line in b.column(0).to_pylist():
            if head is None:  # between records
                if line.startswith(b"WARC/"):
                    head, need = {}, -1
                elif line:
                    raise ValueError(f"no record starts with {line[:40]!r}")
            elif need < 0:
                if line:
                    name, _, value = line.decode().partition(":")
                    head[name] = value.strip().removeprefix("<").removesuffix(">")
                else:
                    need, body, blank = int(head["Content-Length"]), [], 0
            else:
                body.append(line)
                blank += len(line) + 2
                if blank - 2 > need:
                    raise ValueError(f"record {head.get('WARC-Record-ID')}: the payload is longer than Content-Length")
                if blank - 2 == need:  # this line ends the payload
                    done.append(head | {"payload": b"\r\n".join(body)})
                    size += need
                    head = None
        if size > 1 << 24 or len(done) > 5000:
            yield _batch(done)
            done, size = [], 0
    if head is not None:
        raise ValueError("an archive ends inside a record")
    if done:
        yield _batch(done)


def _batch(done: list[dict]) -> pa.RecordBatch:
    cols = [pa.array([r.get(k) for r in done], pa.string()) for k in FIELDS]
    return pa.RecordBatch.from_arrays([*cols, pa.array([r["payload"] for r in done], pa.binary())], names=[*FIELDS.values(), "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, one row each; payload as bytes.
    A file that isn't well formed fails the job."""
    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary").alias("value"))
    r = lines.mapInArrow(_parse, SCHEMA)
    return r.withColumn("payload_digest", F.regexp_replace("payload_digest", "^sha256:", "")).withColumn("page_id", F.col("page_id").cast("long"))


def archive(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html") -> None:
    """Write ``pages`` as deduplicated archives under ``path``. ``pages`` is read once."""
    scratch = Scratch(pages.sparkSession)
    # written once: the heads that are resolved and the records that go out must be the same rows
    # with the same ids, also if ``pages`` gives its rows in another order each time it is read
    recs = scratch.save(records(pages, id_col, url_col, payload_col), "records")
    write(resolve(recs, scratch), path)
    scratch.drop("records", "first")


def rewrite(spark: SparkSession, path: str, to: str) -> None:
    """Deduplicate archives across files: read those under ``path``, resolve all
    their records anew and write them, with fresh headers, under ``to``.

    Revisit records get their payload's digest and length from the response of
    that digest; one whose response is in none of the files keeps its reference.
    """
    scratch = Scratch(spark)
    r = read(spark, path)
    full = r.where("record_type = 'response'").withColumn("payload", F.decode("payload", "UTF-8"))
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    found = resolve(full.select("record_id", "page_id", "target_uri", "payload", "payload_bytes", "payload_digest"), scratch)
    rank = F.struct(F.col("page_id").isNull(), "page_id", "record_id", "target_uri")
    first = full.groupBy("payload_digest").agg(F.min(rank).alias("first")).selectExpr("payload_digest AS digest", "first.record_id AS first_id", "first.target_uri AS first_uri")
    old = r.where("record_type = 'revisit'").join(scratch.save(first, "responses"), F.col("payload_digest") == F.col("digest"), "left")
    old = old.select("record_id", "page_id", "target_uri", "record_type", F.lit("").alias("payload"), "payload_digest", F.coalesce("first_id", "refers_to_id").alias("refers_to_id"), F.coalesce("first_uri", "refers_to_uri").alias("refers_to_uri"))
    write(found.unionByName(old), to)


def digest_rows(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row per record read back: page_id, payload_bytes, payload_digest (of the
    full payload: a revisit's is that of the response it names), record_type,
    refers_to (that response's page_id). ``strict``: a revisit without its response fails the job."""
    scratch = Scratch(spark)
    lost = F.raise_error(F.concat(F.lit("no record is the response of revisit "), F.col("record_id")))
    r = read(spark, path).select("record_id", "page_id", "record_type", "refers_to_id", "payload_digest", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"))
    r = scratch.save(r, "read")
    named = r.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("wanted")).distinct()
    first = r.join(named, F.col("record_id") == F.col("wanted")).select(F.col("record_id").alias("first_id"), F.col("page_id").alias("refers_to"), F.col("n").alias("first_n"), F.col("sha").alias("first_sha"))
    first = scratch.save(first, "first")
    out = r.join(first, F.col("refers_to_id") == F.col("first_id"), "left")
    if strict:
        out = out.where(F.when((F.col("record_type") == "revisit") & F.col("first_id").isNull(), lost.cast("boolean")).otherwise(True))
    return out.select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("first_n")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("first_sha")).otherwise(F.col("sha")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read them back as ``digest_rows``.

    A null html is an empty payload; a null page_id stays null (and is the last
    choice for the response); repeated rows are records of their own; an empty
    table writes an empty archive. Other columns are not looked at. The input need
    not be repeatable: its records are written once and everything is made of them.
    """
    scratch = Scratch(pages.sparkSession)
    path = scratch.path(f"warc-{uuid.uuid4().hex}")
    archive(pages, path)
    return digest_rows(pages.sparkSession, path, strict=True)
