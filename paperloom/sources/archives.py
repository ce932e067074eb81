"""Zip containers as rows."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an entry that are unpacked, at most.
LIMIT = 256 << 20


def entries(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, name, size, content): files of zip containers; a broken container gives none, an entry over the limit has null content."""
    schema = f"{key} string, name string, size long, content binary"

    def run(batches):
        for b in batches:
            rows = []
            for k, data in zip(b.column("k").to_pylist(), b.column("c").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        rows += [(k, i.filename, i.file_size, z.read(i) if i.file_size <= LIMIT else None) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary()))], names=[key, "name", "size", "content"])

    return df.select(F.col(key).cast("string").alias("k"), F.col(content).alias("c")).mapInArrow(run, schema)


def pack(df: DataFrame, key: str, name: str = "name", content: str = "content") -> DataFrame:
    """(key, content): a zip container for each key, entries by name; equal inputs give equal bytes."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(content).alias("c")))).alias("f"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, content binary"

    def run(batches):
        for b in batches:
            out = []
            for files in b.column("f").to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for f in files:
                        z.writestr(zipfile.ZipInfo(f["n"]), f["c"] or b"", zipfile.ZIP_DEFLATED)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.binary())], names=[key, "content"])

    return rows.mapInArrow(run, schema)
