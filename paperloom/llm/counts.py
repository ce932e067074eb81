"""Counts of 64-bit keys over a corpus, kept as sorted arrays in files of the shared folder.

Workers count what a few million keys hold, cut the sorted keys into buckets and send each bucket as
one small blob of key differences; a bucket's reader merges its blobs and writes one file of sorted
keys and counts.  A key costs a few bytes of shuffle for each flush that holds it, however often it
occurs, so frequent keys do no harm.  Readers map the files and search sorted queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Keys that a worker gathers before it sends them.
FLUSH = 1_000_000
BLOBS = "bucket int, keys binary, counts binary"
U = np.uint64


def pack_ints(x: np.ndarray) -> bytes:
    """A width and as many low bytes of each value."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of a key."""
    return (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def blobs(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of sorted distinct keys; counts of one are left out."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    names = bucket[np.concatenate([[0], cut])].tolist() if len(bucket) else []
    k, c = [], []
    for x, n in zip(np.split(keys, cut), np.split(counts, cut)):
        if len(x):
            d = np.diff(x, prepend=U(0))
            low = int(np.bitwise_or.reduce(d))
            shift = max((low & -low).bit_length() - 1, 0)  # keys cut to fewer bits end in zeros
            k.append(bytes([shift]) + pack_ints(d >> U(shift)))
            c.append(b"" if (n == 1).all() else pack_ints(n))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "keys", "counts"])


def unblob(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.cumsum(unpack_ints(keys[1:]) << U(keys[0]), dtype=U)
    return k, unpack_ints(counts).astype(np.int64) if counts else np.ones(len(k), np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def gathered(parts: Iterable[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Blobs of a stream of key arrays."""
    held, size = [], 0
    for x in parts:
        held.append(x)
        size += len(x)
        if size >= FLUSH:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            yield blobs(k, n, bucket_of(k, bits))
            held, size = [], 0
    if size:
        k, n = np.unique(np.concatenate(held), return_counts=True)
        yield blobs(k, n, bucket_of(k, bits))


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of blobs that come by bucket."""
    at, keys, counts, size = None, [], [], 0
    for b in batches:
        for bucket, k, c in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist()):
            if bucket != at:
                if keys:
                    yield at, *summed(keys, counts)
                at, keys, counts, size = bucket, [], [], 0
            k, c = unblob(k, c)
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > 2 * FLUSH and len(keys) > 1:
                k, c = summed(keys, counts)
                keys, counts, size = [k], [c], len(k) // 2
    if keys:
        yield at, *summed(keys, counts)


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select("bucket", "keys", "counts").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")


def count(rows: DataFrame, folder: str, bits: int, least: int = 1) -> list[dict]:
    """Writes the store of the blobs in rows; returns its files (bucket, path, n, total) by bucket.

    Keys counted fewer than ``least`` times are left out of the files; ``total`` and ``distinct`` have them.
    Counts have four bytes each, or eight (``wide``) in a file that holds one of 2**32 or more.
    """
    schema = "bucket int, path string, n long, total long, distinct long, wide boolean"

    def write(batches):
        for bucket, k, n in merged(batches):
            total, distinct = int(n.sum()), len(k)
            if least > 1:
                k, n = k[n >= least], n[n >= least]
            path = f"{folder}/{bucket:06d}-{shared.attempt_name()}"
            wide = int(n.max(initial=0)) >= 1 << 32
            shared.put(path, [k.astype("<u8").tobytes(), n.astype(_WIDTH[wide]).tobytes()])
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "path": path, "n": len(k), "total": total, "distinct": distinct, "wide": wide}], schema=_MANIFEST)

    made = shared.write_table(by_bucket(rows, 1 << bits).mapInArrow(shared.tidy(write), schema), folder, "manifest")
    return sorted((r.asDict() for r in made.collect()), key=lambda r: r["bucket"])  # a row for each file


_MANIFEST = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("distinct", pa.int64()), ("wide", pa.bool_())])
_WIDTH = {False: "<u4", True: "<u8"}


class Store:
    """Counts and ranks of keys in the files of ``count``."""

    def __init__(self, files: list[dict], bits: int) -> None:
        self.bits, self.files, self.open = bits, {f["bucket"]: f for f in files}, shared.Views()
        at = 0
        for f in files:
            self.files[f["bucket"]]["base"] = at
            at += f["n"]
        self.size = at

    def arrays(self, bucket: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        f = self.files.get(bucket)
        if f is None:
            return None
        n = f["n"]
        view = self.open(f["path"])
        return shared.array_at(view, "<u8", 0, n), shared.array_at(view, _WIDTH[f["wide"]], 8 * n, n), f["base"]

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, rank) of each key; 0 and -1 where it is not in the store."""
        order = np.argsort(keys)
        q = keys[order]
        counts, ranks = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64)
        bucket = bucket_of(q, self.bits)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(q)]]) if len(q) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            got = self.arrays(int(bucket[lo]))
            if got is None or not len(got[0]):
                continue
            k, n, base = got
            pos = np.searchsorted(k, q[lo:hi])
            pos[pos == len(k)] = 0
            hit = k[pos] == q[lo:hi]
            counts[lo:hi] = np.where(hit, n[pos], 0)
            ranks[lo:hi] = np.where(hit, base + pos, -1)
        out = np.empty_like(counts), np.empty_like(ranks)
        out[0][order], out[1][order] = counts, ranks
        return out


def bits_for(spark) -> int:
    return (shared.partitions(spark) - 1).bit_length()


def map_blobs(df: DataFrame, keys: Callable, bits: int, most: int = 4 << 20, column: str = "t", made: bool = False) -> DataFrame:
    """Blobs of the keys that the function finds in pieces of the rows; with ``made`` each task makes the function by calling ``keys``."""
    from .frames import slices

    def run(batches):
        find = keys() if made else keys
        yield from gathered((find(b) for whole in batches for b in slices(whole, column, most)), bits)

    return df.mapInArrow(shared.tidy(run), BLOBS)


def text_rows(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, t): the key as long and the text, null as empty."""
    shared.fewer_rows_per_batch(df.sparkSession)
    return df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("t"))
