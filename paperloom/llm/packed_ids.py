"""Token ids in files: frequency ranks in one to four bytes, with the lengths in separate control bytes.

A control byte holds two bits (length less one) for each of four ranks; the data bytes follow
little-endian.  A reader looks the lengths up in a table of 256 rows, sums them to offsets and
gathers all values of a block at once.  Blocks hold whole documents.  Ranks come from the counts
of all tokens of all documents (ties: lower id first).

Ids are made once: a first pass sorts the documents by id, writes shards whose blocks are ranked by
their own counts, and counts; a second pass ranks the shards anew by the corpus counts.  A task
writes under a name of its attempt and returns it, so a lost executor leaves at most an unused file.

Null texts are empty; null ids stand first; equal ids follow each other by a hash of the text, and may stand in several
files.  An empty table gives no files.  Columns other than the key and the text play no part, whatever their
names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .bpe import Encoder
from .frames import slices

MAGIC = b"PLIDS01\n"
#: Ids in a block, unless one document has more.
BLOCK = 1 << 20
#: Parts of texts that a worker remembers, about 200 bytes each.
MEMO = 1_000_000
_HEAD = struct.Struct("<IIQQ")
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned values below 2**32."""
    v = values.astype("<u4", copy=False)
    if v.max(initial=0) < 1 << 16:
        two = v > 0xFF
        size = two.astype(np.uint8) + np.uint8(1)
        end = np.cumsum(size, dtype=np.int64)
        at = end - size
        out = np.empty(int(end[-1]) if len(v) else 0, np.uint8)
        out[at] = v.astype(np.uint8)
        out[at[two] + 1] = (v[two] >> np.uint32(8)).astype(np.uint8)
        data = out.tobytes()
    else:
        size = (1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
        data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()
    pad = np.concatenate([size - 1, np.zeros(-len(size) % 4, np.uint8)]).reshape(-1, 4)
    return (pad[:, 0] | pad[:, 1] << 2 | pad[:, 2] << 4 | pad[:, 3] << 6).tobytes(), data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values, by table lookup of the lengths."""
    size = _LENGTHS[control].ravel()[:n]
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype("<u4")
    for k in range(1, int(size.max(initial=1))):
        some = np.flatnonzero(size > k)
        out[some] |= padded[at[some] + k].astype("<u4") << np.uint32(8 * k)
    return out


def ranking(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids by falling count, then rising id."""
    return ids[np.lexsort((ids, -counts))].astype("<u4")


def block(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, order: np.ndarray | None) -> list[bytes]:
    """One block; with order None it gets its own ranking, stored in it."""
    table = np.empty(0, "<u4")
    if order is None:
        counts = np.bincount(ids)
        own = np.flatnonzero(counts)
        table = order = ranking(own, counts[own])
    rank = np.zeros(int(order.max(initial=0)) + 1, "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    control, data = pack(rank[ids])
    known = np.array([d is not None for d in docs], np.uint8)
    return [_HEAD.pack(len(docs), len(table), len(ids), len(data)), table.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), known.tobytes(), lengths.astype("<u8").tobytes(), control, data]


def blocks(view: memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, lengths, token ids) of each block of a file."""
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a file of packed ids")
    n = struct.unpack_from("<I", view, 8)[0]
    order, at = shared.array_at(view, "<u4", 12, n), 12 + 4 * n
    while at < len(view):
        docs, own, ids, size = _HEAD.unpack_from(view, at)
        at += _HEAD.size
        table = shared.array_at(view, "<u4", at, own) if own else order
        at += 4 * own
        names = shared.array_at(view, "<i8", at, docs).tolist()
        known = shared.array_at(view, np.uint8, at + 8 * docs, docs)
        lengths = shared.array_at(view, "<u8", at + 9 * docs, docs)
        at += 17 * docs
        control = shared.array_at(view, np.uint8, at, (ids + 3) // 4)
        data = shared.array_at(view, np.uint8, at + len(control), size)
        at += len(control) + size
        yield [d if k else None for d, k in zip(names, known)], lengths, table[unpack(control, data, ids)] if ids else np.empty(0, "<u4")


def library_encoder(path: str):
    """Text to ids by the tokenizers library; single words go straight to its merge model."""
    from tokenizers import Tokenizer

    from .bpe import byte_letters, settings

    settings(path)
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    model, letters = whole.model, str.maketrans({chr(b): c for b, c in byte_letters().items()})
    stops = {x: whole.encode(x, add_special_tokens=False).ids for x in ".,"}
    space = byte_letters()[32]

    def word(text: str) -> list[int]:
        plain = space + text[1:] if text.isascii() else text.encode().decode("latin-1").translate(letters)
        return [t.id for t in model.tokenize(plain)]

    def ids(text: str) -> list[int]:
        if text[:1] == " ":
            if text[1:].isalpha():
                return word(text)
            if text[1:-1].isalpha() and text[-1] in ".,":
                return word(text[:-1]) + stops[text[-1]]
        return whole.encode(text, add_special_tokens=False).ids

    return ids


_MADE = T.StructType([T.StructField(*x) for x in (("token", T.IntegerType()), ("n", T.LongType()), ("path", T.StringType()), ("first", T.LongType()), ("hash", T.LongType()), ("tokens", T.LongType()))])


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One for a worker: its memo serves all tasks that the worker runs."""
    return Encoder(library_encoder(path), MEMO)


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the ids of all documents below folder, by ascending key; returns (path, start, tokens), a row for each file.

    Null text is empty; a null key sorts first and stays null; equal keys follow each other, by a hash of the text.
    ``end_id`` is appended to each document.  An empty table gives no files.
    """
    spark = docs.sparkSession
    shared.fewer_rows_per_batch(spark)
    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t")
    stop = struct.pack("<I", end_id) if end_id is not None else b""

    def encode(batches):
        encoder, counts, first, total = worker_encoder(vocabulary), np.zeros(1 << 16, np.int64), None, 0
        path = f"{folder}/first/{shared.attempt_name()}"

        def made():
            nonlocal first, total, counts
            names, ids = [], []
            yield MAGIC + struct.pack("<I", 0)

            def flush():
                nonlocal counts, total
                all_ids = np.frombuffer(b"".join(ids), "<u4")
                more = np.bincount(all_ids, minlength=len(counts))
                counts = more + np.pad(counts, (0, len(more) - len(counts)))
                total += len(all_ids)
                return b"".join(block(names, np.array([len(x) // 4 for x in ids]), all_ids, None))

            size = 0
            for whole in batches:
                for b in slices(whole, "t", 1 << 22):
                    first = first or (b.column("k")[0].as_py(), b.column("h")[0].as_py())
                    for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                        names.append(k)
                        ids.append(encoder(t) + stop)
                        size += len(ids[-1]) // 4
                        if size >= BLOCK:
                            yield flush()
                            names.clear(), ids.clear()
                            size = 0
            if names:
                yield flush()

        out = made()
        head = next(out)
        body = next(out, None)
        if body is None:
            return
        shared.put(path, _chain(head, body, out))
        used = np.flatnonzero(counts)
        none = [None] * len(used)
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), None], pa.int32()), pa.array([*counts[used].tolist(), None], pa.int64()), pa.array([*none, path], pa.string()), pa.array([*none, first[0]], pa.int64()), pa.array([*none, first[1]], pa.int64()), pa.array([*none, total], pa.int64())], names=_MADE.names)

    made = shared.write_table(ordered.mapInArrow(shared.tidy(encode), _MADE), folder, "counts")
    # as many rows as the vocabulary has ids, and as there are files
    counts = made.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).collect()
    order = ranking(np.array([r.token for r in counts], np.int64), np.array([r.n for r in counts], np.int64)).tobytes() if counts else b""
    files, start = [], 0
    for r in sorted(made.where("path IS NOT NULL").collect(), key=lambda r: (r["first"] is not None, r["first"] or 0, r["hash"])):
        files.append((r.path, start, r.tokens))
        start += r.tokens

    def again(batches):
        table = np.frombuffer(order, "<u4")
        for b in batches:
            for path, start, tokens in zip(*(b.column(c).to_pylist() for c in ("path", "start", "tokens"))):
                new = f"{folder}/ids/{start:016d}-{shared.attempt_name()}"
                shared.put(new, _chain(MAGIC + struct.pack("<I", len(table)) + order, *(b"".join(block(d, n, x, table)) for d, n, x in blocks(shared.mapped(path)))))
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([start], pa.int64()), pa.array([tokens], pa.int64())], names=["path", "start", "tokens"])

    schema = "path string, start long, tokens long"
    table = _spread(spark, files, schema)
    done = shared.write_table(table.mapInArrow(shared.tidy(again), schema), folder, "files")
    for path, _, _ in files:  # all of the second pass is in place
        shared.remove(path)
    return done


def _chain(*parts):
    for p in parts:
        if isinstance(p, bytes):
            yield p
        else:
            yield from p


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A task for each row."""
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)


def read_ids(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, token_ids binary]) of each document of the files of write_ids."""
    spark = files.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids binary" * with_ids
    rows = [tuple(r) for r in files.select("path", "start").collect()]

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                for docs, lengths, ids in blocks(shared.mapped(path)):
                    end = np.cumsum(lengths.astype(np.int64))
                    raw = ids.astype("<u4").tobytes()
                    own = [raw[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), lengths.astype(np.int64).tolist())]
                    cols = [pa.array(docs, pa.int64()), pa.array(start + end - lengths.astype(np.int64), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids)
                    start += len(ids)

    return _spread(spark, rows, "path string, start long").mapInArrow(shared.tidy(read), schema)
