"""A content-addressed WARC archive.

Three tables in one folder: payloads (each distinct payload once, under its SHA-256), headers
(the exact header bytes of each record, without its payload) and, made from both by a join, the
records as they would stand in a WARC file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: WARC-Date of all records unless another is given; a fixed one makes archives reproducible.
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four letters."""
    digest, letters = F.sha1(payload), []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(kind: str, extra: list[Column]) -> Column:
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"), *extra, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write a record for each row of pages into the archive at path.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least
    min_revisit_bytes bytes those with the smallest id are responses; the others are revisits of it.
    Smaller payloads always make responses. Repeated rows make records of their own. A null id
    counts as larger than any other; a group of null ids only has responses. A null URL is left
    out of the header; line breaks in one are percent-encoded. Other columns are ignored.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    noted = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), sha1_base32(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes"), "payload")
    # a payload travels once for each task that has seen it
    stored = noted.groupBy("address").agg(F.min("page_id").alias("first"), F.first("payload").alias("payload"))
    stored.select("address", "first", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "first")
    all_ = noted.drop("payload").join(firsts, "address")
    again = (F.col("bytes") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    where = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(CRLF)), F.lit(""))
    common = [F.lit("WARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"), where, F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(CRLF)]
    response = [*common, F.lit("Content-Type: text/html; charset=utf-8"), F.lit(f"{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF)]
    revisit = [*common, F.lit("WARC-Refers-To: "), urn(F.col("first")), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}Content-Length: 0{CRLF}")]
    header = F.encode(F.when(again, _header("revisit", revisit)).otherwise(_header("response", response)), "utf-8")
    all_.select("address", header.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, verified): every record with the full payload that it stands for, a revisit's too.

    verified is whether the payload read has the SHA-256 under which it is stored.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("address", "payload", (F.sha2("payload", 256) == F.col("address")).alias("verified"))
    return spark.read.parquet(f"{path}/headers").join(payloads, "address").select("header", "payload", "verified")


def field(name: str, header: str = "header") -> Column:
    """A field of the header column, null where it is missing."""
    found = F.regexp_extract(F.decode(header, "utf-8"), rf"\n{re.escape(name)}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def record_bytes() -> Column:
    """What stands in a WARC file for a row of read_archive."""
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), body, F.lit((CRLF * 2).encode()))


def header_of(record: Column) -> Column:
    """The header bytes of a record: all up to and with its first empty line."""
    return F.substr(record, F.lit(1), F.instr(F.decode(record, "iso-8859-1"), CRLF * 2) + 3)


def block_of(record: Column, header: Column, length: Column) -> Column:
    """The block of a record behind its header, of the length that the header states."""
    return F.substr(record, F.length(header) + 1, length.cast("int"))


def write_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the archive's records as WARC files, a file for each task, into a shared folder; returns (file, records).

    Files are named by partition and appear whole or not at all, so a task that runs again or twice replaces its
    own. Read the result once: each reading writes the files.
    """
    from .shared import writing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc", 0
        with writing(name) as f:
            for batch in batches:
                for record in batch.column(0):
                    f.write(record.as_buffer())
                n += len(batch)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return read_archive(spark, path).select(record_bytes().alias("record")).mapInArrow(run, "file string, records long")


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        out.append((fields, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


ORACLE = f"""
with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(encode(coalesce(html, ''))) d, min(page_id) over (partition by coalesce(html, '')) first from pages),
b as (select *, list_transform([{", ".join(f"substr(d, {5 * i + 1}, 5)" for i in range(8))}], lambda h: cast('0x' || h as int)) n from p)
select page_id, payload_bytes,
       array_to_string(list_transform(n, lambda x: substr('{BASE32}', x // 32768 + 1, 1) || substr('{BASE32}', x // 1024 % 32 + 1, 1) || substr('{BASE32}', x // 32 % 32 + 1, 1) || substr('{BASE32}', x % 32 + 1, 1)), '') payload_digest,
       case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to, true verified, true digest_matches
from b
"""
