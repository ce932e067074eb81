"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

1. One pass over the documents looks every word trigram up among those of the test items.  Hits near
   one diagonal of a document and an item become a window of the document's words.
2. A window whose words could not reach the least score even if all those it has in common with the
   item were aligned is dropped, which is exact.  How frequent a seed is does not matter.
3. Local alignment of words (match 2, other -1, gap -1) scores each window; the similarity is
   the score over that of the whole item, and a window counts from 0.5 on.

Items are read in blocks of bounded text (one longer item stands alone), each with its own pass, so what
workers hold is bounded.  An item of fewer than three words is no evidence and matches nothing; null
texts are empty and match nothing; repeated documents and items give one finding for each pair of ids.
An empty table of documents or items gives no findings.  Columns other than the key, the text and the
item's own two play no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts, shared
from .counts import U
from .drops import ALL, once, text_hash, without
from .frames import slices
from .tokens import shingles, word_hashes

SEED, LEAST = 3, 0.5
MATCH, OTHER, GAP = 2, -1, -1
#: Bytes of item text in a block.
BLOCK = 32 << 20


class Items:
    """The words and seeds of a block of test items."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        h, _, _, at = word_hashes(pa.array(texts, pa.string()))
        long = np.diff(at) >= SEED
        self.ids = [i for i, ok in zip(ids, long.tolist()) if ok]
        self.words = [h[at[i] : at[i + 1]] for i in np.flatnonzero(long).tolist()]
        self.kinds = [np.unique(w, return_counts=True) for w in self.words]
        self.size = np.array([len(w) for w in self.words], np.int64)
        g, gat = shingles(np.concatenate(self.words) if self.words else np.empty(0, U), np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64), SEED)
        item = np.repeat(np.arange(len(self.words)), np.diff(gat))
        order = np.argsort(g, kind="stable")
        self.seeds, self.first = np.unique(g[order], return_index=True)
        self.first = np.concatenate([self.first, [len(g)]])
        self.item, self.place = item[order], (np.arange(len(g)) - gat[item])[order]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.seeds & U(0xFFFFF)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in g, seed) of the seeds in g."""
        some = np.flatnonzero(self.quick[(g & U(0xFFFFF)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.seeds, g[some]), max(len(self.seeds) - 1, 0))
        hit = self.seeds[pos] == g[some] if len(self.seeds) else np.zeros(0, bool)
        return some[hit], pos[hit]

    def common(self, i: int, words: np.ndarray) -> int:
        """The words of item i that an alignment with these words could match at most: each as often as the item or the words have it."""
        own, many = self.kinds[i]
        pos = np.minimum(np.searchsorted(own, words), len(own) - 1)
        return int(np.minimum(np.bincount(pos[own[pos] == words], minlength=len(own)), many).sum())


def windows(items: Items, col: pa.Array, least: float = LEAST):
    """(row, item, first word, words) of each window of a column of texts."""
    h, _, _, at = word_hashes(col)
    g, gat = shingles(h, at, SEED)
    where, seed = items.find(g)
    if not len(where):
        return
    row = np.searchsorted(gat, where, "right") - 1
    word = where - gat[row]
    many = items.first[seed + 1] - items.first[seed]
    up = np.repeat(np.arange(len(where)), many)
    entry = items.first[seed][up] + np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
    item, start = items.item[entry], word[up] - items.place[entry]
    row = row[up]
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    slack = items.size[item]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])])
    cut = np.concatenate([np.flatnonzero(new), [len(row)]])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        r, i = int(row[lo]), int(item[lo])
        pad = int(slack[lo]) // 2
        a = max(0, int(start[lo]) - pad)
        b = min(int(at[r + 1] - at[r]), int(start[hi - 1]) + int(slack[lo]) + pad)
        words = h[at[r] + a : at[r] + b]
        if MATCH * items.common(i, words) >= least * MATCH * len(items.words[i]):
            yield r, i, a, words


def align(item: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(score, end) of the best local alignment of the item with each text; the end is exclusive, 0 without any match."""
    width = max(map(len, texts))
    t = np.zeros((len(texts), width), U)
    real = np.zeros((len(texts), width), bool)
    for i, x in enumerate(texts):
        t[i, : len(x)] = x
        real[i, : len(x)] = True
    before = np.zeros((len(texts), width + 1), np.int32)
    best, end = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    for w in item:
        now = np.maximum(before + GAP, 0)
        now[:, 1:] = np.maximum(now[:, 1:], before[:, :-1] + np.where((t == w) & real, MATCH, OTHER))
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(axis=1)
        value = now[np.arange(len(texts)), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        before = now
    return best, end


_WINDOW = "k long, text_hash binary, item int, start int, words binary"
_FOUND = "k long, text_hash binary, item int, score int, start int, end int"


def _search(docs: DataFrame, items: Items, folder: str, least: float) -> DataFrame:
    def look(batches):
        for whole in batches:
            for b in slices(whole, "t", 4 << 20):
                keys = b.column("k").to_pylist()
                found = list(windows(items, b.column("t"), least))
                if found:
                    hashes = {r: text_hash(b.column("t")[r].as_py()) for r in {f[0] for f in found}}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[f[0]] for f in found], pa.int64()), pa.array([hashes[f[0]] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3].astype("<u8").tobytes() for f in found], pa.binary())],
                        names=["k", "text_hash", "item", "start", "words"],
                    )

    near = shared.write_table(docs.mapInArrow(shared.tidy(look), _WINDOW), folder, "windows")

    def score(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("k", "text_hash", "item", "start", "words")]
            by: dict[int, list[tuple]] = {}
            for k, t, i, s, w in zip(*cols):
                by.setdefault(i, []).append(((k, t), s, np.frombuffer(w, "<u8")))
            out = []
            for i, found in by.items():
                found.sort(key=lambda f: len(f[2]))
                for lo in range(0, len(found), 64):
                    part = found[lo : lo + 64]
                    best, end = align(items.words[i], [w for _, _, w in part])
                    for (k, s, w), value, e in zip(part, best.tolist(), end.tolist()):
                        if value >= least * MATCH * len(items.words[i]):
                            back, size = align(items.words[i][::-1], [w[:e][::-1]])
                            out.append((*k, i, value, s + e - int(size[0]), s + e))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], names=["k", "text_hash", "item", "score", "start", "end"])

    found = near.mapInArrow(shared.tidy(score), _FOUND)
    names = docs.sparkSession.createDataFrame([(i, x, len(w)) for i, (x, w) in enumerate(zip(items.ids, items.words))], "item int, item_id long, size int")
    best = found.groupBy("k", "text_hash", "item").agg(F.max(F.struct("score", (-F.col("start")).alias("early"), "end")).alias("b"))
    return best.join(names, "item").select("k", "text_hash", "item_id", (F.col("b.score") / (MATCH * F.col("size"))).alias("similarity"), (-F.col("b.early")).alias("start_word"), F.col("b.end").alias("end_word"))


def found_in(docs: DataFrame, items: DataFrame, folder: str, column: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(k, text_hash, item_id, similarity, start_word, end_word): the best window of each text and test item of a block."""
    spark = docs.sparkSession
    rows = counts.text_rows(docs, column, key)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = max(1, math.ceil(2 * size / BLOCK))
    parts = [spark.createDataFrame([], "k long, text_hash binary, item_id long, similarity double, start_word int, end_word int")]
    for p in range(many):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == p).collect()  # about BLOCK / 2 bytes
        own = Items([r.item_id for r in block], [r.text for r in block])
        if own.ids:
            parts.append(_search(rows, own, f"{folder}/{p}", least))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def find(docs: DataFrame, items: DataFrame, folder: str, column: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word): a row for each document and each test item found in it.

    items: (item_id, text).  The best window of a pair counts, then the first.  Several texts under one id
    are one document here, and several under one item id one item.
    """
    best = F.max_by(F.struct("similarity", "start_word", "end_word"), F.struct("similarity", -F.col("start_word"), F.col("end_word")))
    return found_in(docs, items, folder, column, key, least).groupBy(F.col("k").alias("doc_id"), "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, items: DataFrame, folder: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows in whose text a test item was found; rows with a null id stay."""
    gone = once(found_in(docs, items, folder, column, key), F.lit(ALL))
    return without(docs, gone, f"{folder}/gone", column, key)
