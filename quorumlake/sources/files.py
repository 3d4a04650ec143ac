"""Files as sources, and rows made fit for a log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.text import response_kind

#: Fields of a logged request whose contents nobody may read.
SECRET_FIELDS = (("req", "headers", "authorization"), ("req", "headers", "cookie"), ("res", "headers", "set-cookie"))
REDACTED = "[Redacted]"


def discover(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length) of the files below folder whose names match; a name or folder that begins with _ hides what is in it. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "modificationTime", "length").where(~below(F.col("path"), folder).rlike("(^|/)_"))


def below(path: Column, folder: str) -> Column:
    """What follows folder in the path of a file that was discovered there."""
    return F.substr(path, F.instr(path, _plain(folder)) + len(_plain(folder)))


def _plain(folder: str) -> str:
    return folder.split("://", 1)[-1].removeprefix("file:").rstrip("/")


def watch(spark: SparkSession, folder: str, glob: str = "*", files_at_once: int | None = None) -> DataFrame:
    """Streaming: the files that come into folder, (path, modificationTime, length, content). What comes while a batch runs waits for the next, so scans never overlap."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(folder)


def redacted(row: Column, schema, fields: tuple[tuple[str, ...], ...] = SECRET_FIELDS) -> Column:
    """The struct row, of this type, with a fixed text in place of these fields; fields that it lacks or that are null stay so."""
    for path in fields:
        at = schema
        for name in path:
            at = at[name].dataType if hasattr(at, "fieldNames") and name in at.fieldNames() else None
            if at is None:
                break
        else:
            value = row
            for name in path:
                value = value.getField(name)
            quoted = ".".join(f"`{n}`" for n in path)
            row = row.withField(quoted, F.when(value.isNotNull(), F.lit(REDACTED)))
    return row


#: Fixed value: bytes of a request's body that are taken at most.
BODY_BYTES = 5 * 1024 * 1024


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a database. With a numeric key and its bounds it is read in so many partitions; rows beyond the bounds are read too."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def requests(bodies: DataFrame, schema: str, body: str = "body", most_bytes: int = BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows with `request`, the body as a struct; rows refused, with `reason`: too large or no JSON object). Fields of a wrong type are null."""
    read = bodies.withColumn("request", F.from_json(F.col(body), schema)).withColumn("__object", F.coalesce(F.trim(F.col(body)).startswith("{") & F.try_parse_json(F.col(body)).isNotNull(), F.lit(False)))
    small = F.coalesce(F.octet_length(F.col(body)) <= most_bytes, F.lit(True))
    good = read.where(small & F.col("__object")).drop("__object")
    bad = read.where(~(small & F.col("__object"))).withColumn("reason", F.when(~small, "too large").otherwise("no JSON object")).drop("__object", "request")
    return good, bad


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, nulls written out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files in folder whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each row of files, (name, content binary), as a file of its own in a folder that all workers reach; returns how many.

    A file appears whole or not at all, so a task that runs twice does no harm. Names are unique and without slashes; null contents are skipped.
    """

    def run(rows) -> None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(at, recursive=True)
        for r in rows:
            own = f"{at}/.{r['name']}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(bytes(r["content"]))
            store.move(own, f"{at}/{r['name']}")

    kept = files.select("name", "content").where("content is not null")
    n = kept.count()
    kept.foreachPartition(run)
    return n


def fetched(requests_: DataFrame, send: Callable[[str, str, str | None], tuple[int, str | None, bytes]]) -> DataFrame:
    """requests_: (id, method, url, body string) to (id, status, kind, text, error): answers by way of send(method, url, body), which returns (status, content type, content).

    kind is json, text or blob by the content type; text is null for blobs. GET and HEAD with a body are errors, as are
    answers that are no success and failures to send.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for id_, method, url, body in zip(rows["id"], rows["method"], rows["url"], rows["body"], strict=True):
                verb = (method or "GET").upper()
                if body is not None and verb in ("GET", "HEAD"):
                    out.append((id_, None, None, None, f"{verb} requests cannot have a body"))
                    continue
                try:
                    status, kind, content = send(verb, url, body)
                except Exception as e:
                    out.append((id_, None, None, None, str(e)))
                    continue
                out.append((id_, status, kind, content, None if 200 <= status < 300 else f"HTTP {status}"))
            yield pd.DataFrame(out, columns=["id", "status", "type", "content", "error"])

    own = requests_.schema["id"].dataType.simpleString()
    raw = requests_.select("id", "method", "url", "body").mapInPandas(run, f"id {own}, status int, type string, content binary, error string")
    kind = response_kind(F.col("type"))
    return raw.select("id", "status", F.when(F.col("status").isNotNull(), kind).alias("kind"), F.when(kind != "blob", F.decode("content", "utf-8")).alias("text"), "error")
