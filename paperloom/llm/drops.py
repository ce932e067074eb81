"""Rows without those of listed ids and texts, whose texts do not move.

A row is known by its id and its whole text, so that of two texts under one id only the listed one
goes.  Both make one digest of 125 bits: 64 bits are the key of a store of sorted arrays in the shared
folder, the others its value.  The workers that read the rows search the store.  A join would move
every text to meet a digest, or send all digests to all workers; here the plan is the same at every
size.  Two rows out of 10**11 share a digest with a probability of 10**-16.

Rows with a null id are never listed.  Null texts are empty.  Repeated rows of an id and a text are all
listed or none; ``ONE`` keeps one of them.  An empty table, and an empty list, change nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts, shared
from .counts import U
from .tokens import mix

#: What becomes of the rows of a listed id and text: all go, or one stays.
ALL, ONE = 1, 2


def text_hash(text: str) -> bytes:
    """The first 128 bits of SHA-256."""
    return hashlib.sha256(text.encode()).digest()[:16]


def _digests(keys: pa.Array, hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 61 bits) of each row of an id and the hash of its text."""
    own = mix(np.array(keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(U).copy())
    h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return mix(h[:, 0] ^ own), mix(h[:, 1] + own * U(0x9E3779B97F4A7C15)) >> U(3)


def stored(listed: DataFrame, folder: str) -> tuple[list[dict], int]:
    """The store of ``listed`` (k long, text_hash binary, kind int from 1 to 3), each id and text once, and its bits."""
    bits = counts.bits_for(listed.sparkSession)

    def send(batches):
        for b in batches:
            if len(b):
                a, rest = _digests(b.column("k"), b.column("text_hash").to_pylist())
                order = np.argsort(a)
                kind = np.array(b.column("kind"), np.int64).astype(U)
                yield counts.blobs(a[order], (rest << U(2) | kind)[order].astype(np.int64), counts.bucket_of(a[order], bits))

    return counts.count(listed.select("k", "text_hash", "kind").mapInArrow(shared.tidy(send), counts.BLOBS), folder, bits), bits


def kinds(store: counts.Store, ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """The kind of each row of an id and a text, 0 where it is not listed."""
    if not len(ids):
        return np.zeros(0, np.int64)
    a, rest = _digests(ids, [text_hash(t or "") for t in texts.to_pylist()])
    found = store.lookup(a)[0].astype(U)
    return np.where((found >> U(2) == rest) & (found > 0) & ~np.array(ids.is_null()), found & U(3), U(0)).astype(np.int64)


def without(docs: DataFrame, listed: DataFrame, folder: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows in ``listed`` (k long, text_hash binary, kind int: ALL or ONE), each id and text once; all columns stay."""
    shared.fewer_rows_per_batch(docs.sparkSession)
    files, bits = stored(listed, folder)

    def rows(kind: int):
        def keep(batches):
            store = counts.Store(files, bits)
            for b in batches:
                yield b.filter(pa.array(kinds(store, b.column(key), b.column(column)) == kind))

        return docs.mapInArrow(shared.tidy(keep), docs.schema)

    same = "_same"
    while same in docs.columns:
        same += "_"
    one = rows(ONE).withColumn(same, F.coalesce(F.col(f"`{column}`"), F.lit(""))).dropDuplicates([key, same]).drop(same)
    return rows(0).unionByName(one)


def once(rows: DataFrame, kind: Column) -> DataFrame:
    """The list of ``without`` from rows (k, text_hash): each id and text once, with the kind that the column gives; null ids are left out."""
    return rows.where("k IS NOT NULL").groupBy("k", "text_hash").agg(kind.cast("int").alias("kind")).select("k", "text_hash", "kind")
