"""Tables and files in the folder that driver and executors share.

The folder is what the session names in spark.checkpoint.dir. Where that is
unset and the master is local, as in tests on one machine, a temporary folder is made and set;
on a cluster that would be another folder on each machine, so it is an error there.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_registered: list = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quorumlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/quorumlake-{what}-{uuid.uuid4().hex}"
    if not _registered:
        _registered.append(atexit.register(_clean))
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete(spark, path)


def made() -> list[str]:
    """The paths that new_folder has given out and that still stand."""
    return [path for _, path in _made]


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of new_folder that nothing reads any more."""
    gone = set(paths)
    for path in paths:
        delete(spark, path)
    _made[:] = [x for x in _made if x[1] not in gone]


def cut_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again, with its path: lineage ends here, and a lost executor costs nothing that is done."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    return cut_at(df, what)[0]


#: Rows of a batch between Spark and Python: texts are some KB each, and each Python stage of a task holds a batch on either side.
BATCH = 1000


def hold_batches(spark: SparkSession, rows: int = BATCH) -> str:
    """Hold the session's Arrow batches to so many rows if they are at Spark's default; returns what the setting was.

    The setting is read when a plan runs, so a query that returns a plan can't put it back; callers who run their plans
    themselves can. No operator needs it for right results.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":
        spark.conf.set(name, str(rows))
    return before


def release() -> None:
    """Give back what a worker's allocators hold but don't use: workers live on between tasks, several to a core."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quorumlake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(name := f"{folder}/quorumlake-code.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(name)


def local_path(path: str) -> str | None:
    """The path as this machine's open() takes it, or None for a remote store."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


@contextlib.contextmanager
def writing(path: str):
    """A file object; what is written stands at path when the block ends, whole or not at all, so that a task that runs twice does no harm."""
    own = uuid.uuid4().hex
    if (at := local_path(path)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(f"{at}.{own}", "wb") as f:
            yield f
        os.replace(f"{at}.{own}", at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(f"{at}.{own}") as f:
        yield f
    store.move(f"{at}.{own}", at)


def write_file(path: str, data: bytes) -> None:
    with writing(path) as f:
        f.write(data)


def file_exists(path: str) -> bool:
    if (at := local_path(path)) is not None:
        return os.path.exists(at)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def map_file(path: str, dtype: str):
    """A file of numbers, memory-mapped; without a file, no numbers. One in a remote store is first copied to an unlinked local file."""
    import numpy as np

    if not file_exists(path):
        return np.zeros(0, dtype)
    if (at := local_path(path)) is not None:
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.zeros(0, dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as own, store.open_input_stream(at) as f:
        while block := f.read(1 << 22):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype, "r") if own.tell() else np.zeros(0, dtype)
