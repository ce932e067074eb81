"""Shared folder, written tables and files that every worker can read.

Everything that must outlive an executor goes below ``spark.checkpoint.dir``.  Where that
setting is absent, a local session (one machine) gets a folder of its own, and any other session
is refused: its workers would each write to their own disk.  Files of our own
formats are written by workers under a name of the attempt and published in the rows that
the task returns, so that a retried task never disturbs a reader.
"""

from __future__ import annotations

import ctypes
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The URI that the cluster names in spark.checkpoint.dir; set only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = root if root.startswith("file:") else f"file://{os.path.abspath(root)}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one call; not created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as Parquet below the folder and reads it again: lineage ends here."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fewer_rows_per_batch(spark: SparkSession, rows: int = 256) -> None:
    """Bounds an Arrow batch of whole texts; long texts would fill memory with the default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions(spark: SparkSession, least: int = 8) -> int:
    """Buckets of a store: the cluster's shuffle width rounded up to a power of two."""
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (n - 1).bit_length()


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts) -> int:
    """Writes the byte parts to a file of the shared folder; returns its size."""
    local, size = _local(uri), 0
    if local is None:
        system, path = _remote(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            for x in parts:
                size += out.write(x)
        return size
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(local, "wb") as out:
        for x in parts:
            size += out.write(x)
    return size


def mapped(uri: str) -> memoryview:
    """The file's bytes, memory-mapped where the shared folder is mounted, else read."""
    local = _local(uri)
    if local is None:
        system, path = _remote(uri)
        with system.open_input_file(path) as f:
            return memoryview(f.read())
    if not os.path.getsize(local):
        return memoryview(b"")
    with open(local, "rb") as f:
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Views:
    """Files kept open, the last used: ``files`` of them, and of those that must be read, not mapped, ``most`` bytes."""

    def __init__(self, most: int = 256 << 20, files: int = 4096) -> None:
        self.most, self.files, self.held, self.size = most, files, OrderedDict(), 0

    def __call__(self, uri: str) -> memoryview:
        if uri in self.held:
            self.held.move_to_end(uri)
            return self.held[uri]
        view = self.held[uri] = mapped(uri)
        if _local(uri) is None:
            self.size += len(view)
        while (self.size > self.most or len(self.held) > self.files) and len(self.held) > 1:
            gone, old = self.held.popitem(last=False)
            self.size -= len(old) * (_local(gone) is None)
        return view


def remove(uri: str) -> None:
    local = _local(uri)
    if local is None:
        system, path = _remote(uri)
        system.delete_file(path)
    elif os.path.exists(local):
        os.remove(local)


def array_at(view: memoryview, dtype, offset: int, count: int) -> np.ndarray:
    return np.frombuffer(view, dtype=dtype, count=count, offset=offset) if count else np.empty(0, dtype)


def tidy(run):
    """The function of a mapInArrow, giving its worker's free memory back to the system when it ends.

    Workers are kept for later tasks; without this each keeps the most that any of its tasks has used.
    """

    def whole(batches):
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            return

    return whole


def attempt_name() -> str:
    """Differs between attempts of one task."""
    return uuid.uuid4().hex[:16]
