"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by its scorers.

Words are the runs of bytes other than ASCII white space, A-Z in lower case; each document ends in an
end token and starts in a start context.  The vocabulary is a store of sorted word hashes (see
``counts``), whose ranks are word ids; bigram counts are sorted arrays of (context id, word id).  A
context that holds more than one bucket's share of all tokens is spread over all buckets by its words,
and only its numbers of followers, of which there are as many as such contexts, pass the driver.

Words are known by 64-bit hashes.  Counts have 64 bits, and bigrams are keys of (place of the context in its
bucket, word id), so nothing is cut at any size.

p(w | v) = max(c(vw) - D(c), 0) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v) * q(w), where q is the same
over numbers of distinct contexts, interpolated with 1 / (V + 1); an unseen context gives q(w).

Null and empty texts have the end token only.  Without training documents every word has
probability 1.  Repeated rows count again, and each is scored; an empty table gives no rows.  Columns other
than the key, the text and those of the held-out test play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts, shared
from .counts import U
from .frames import slices
from .tokens import word_hashes

#: The hash that stands for the end token (fixed value; no word has it but by chance).
END = 0x5EED0E4D0F7E47D1
_SOME = 3 << 19


def _sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): word hashes of all rows, each row followed by END; ends are the rows' ends."""
    h, _, _, at = word_hashes(col)
    n = np.diff(at)
    ends = np.cumsum(n + 1)
    out = np.full(len(h) + len(n), END, U)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = h
    return out, ends


class Vocabulary:
    """Word counts, ids (from 1; 0 is the start context) and, once counted, numbers of distinct contexts."""

    def __init__(self, files: list[dict], bits: int, contexts: dict[int, str] | None = None) -> None:
        self.store, self.contexts, self.open = counts.Store(files, bits), contexts, shared.Views()
        self.tokens = sum(f["total"] for f in files)
        self.bases = np.array([f["base"] for f in self.store.files.values()], np.int64)
        self.names = list(self.store.files)

    def word_bucket(self, ids: np.ndarray) -> np.ndarray:
        """Index of the file that holds an id from 1."""
        return np.searchsorted(self.bases, ids - 1, "right") - 1

    def followers(self, ids: np.ndarray) -> np.ndarray:
        """Distinct contexts of each word id; 0 for ids below 1."""
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids > 0)
        where = self.word_bucket(ids[known])
        for b in np.unique(where).tolist():
            some = known[where == b]
            out[some] = shared.array_at(self.open(self.contexts[b]), "<u8", 0, self.store.files[self.names[b]]["n"])[ids[some] - 1 - self.bases[b]]
        return out


def _steps(vocabulary: Vocabulary, col: pa.Array, documents: int):
    """(word count, word id, context count, context id, row ends) of each token; an unknown word has id -1."""
    h, ends = _sequences(col)
    n, rank = vocabulary.store.lookup(h)
    ids = np.where(rank >= 0, rank + 1, -1)
    before, many = np.empty_like(ids), np.empty_like(n)
    before[1:], many[1:] = ids[:-1], n[:-1]
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    before[first], many[first] = 0, documents
    return n, ids, many, before, ends


class Codes:
    """Bigrams as (bucket, 64-bit key): a context's place among those of its bucket, or among the hot ones, before the word's id.

    Contexts are dealt to buckets in order; a hot one's bigrams are dealt by word.  Ids are not cut: a
    vocabulary too large for the keys of so few buckets raises ValueError.
    """

    def __init__(self, size: int, buckets: int, hot: list[int]) -> None:
        self.size, self.buckets, self.hot = size, buckets, np.array(sorted(hot), np.int64)
        self.word_bits, self.local_bits = (size + 1).bit_length(), max((size // buckets + 2).bit_length(), len(hot).bit_length())
        if 1 + self.local_bits + self.word_bits > 64:
            raise ValueError("so many words need more buckets: raise spark.sql.shuffle.partitions")

    def place(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether hot, index among the hot contexts)."""
        if not len(self.hot):
            return np.zeros(len(context), bool), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return self.hot[at] == context, at

    def first(self, bucket: np.ndarray | int) -> np.ndarray | int:
        """The first context of a bucket."""
        return -(-bucket * (self.size + 1) // self.buckets)

    def __call__(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, key) of each bigram."""
        hot, index = self.place(context)
        bucket = np.where(hot, (word * 0x9E3779B1 >> 7) % self.buckets, context * self.buckets // (self.size + 1))
        local = np.where(hot, index + (1 << self.local_bits), context - self.first(bucket))
        return bucket, local.astype(U) << U(self.word_bits) | word.astype(U)

    def context_of(self, bucket: int, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, whether hot) of places in a bucket."""
        hot = local >> self.local_bits > 0
        index = np.where(hot, local & ((1 << self.local_bits) - 1), 0)
        return np.where(hot, self.hot[index] if len(self.hot) else 0, local + self.first(bucket)), hot

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, word) of keys."""
        return (key >> U(self.word_bits)).astype(np.int64), (key & U((1 << self.word_bits) - 1)).astype(np.int64)


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where one of these is 0."""
    if min(n) <= 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


def train(docs: DataFrame, folder: str, column: str = "text") -> dict:
    """Counts the documents and writes the model's files below folder; returns what a scorer needs."""
    spark = docs.sparkSession
    bits = counts.bits_for(spark)
    buckets = 1 << bits
    rows = counts.text_rows(docs.select(F.lit(0).alias("doc_id"), F.col(f"`{column}`").alias("text")))
    words = counts.map_blobs(rows, lambda b: _sequences(b.column("t"))[0], bits, _SOME)
    files = counts.count(words, f"{folder}/words", bits)
    tokens, size = sum(f["total"] for f in files), sum(f["n"] for f in files)
    model = {"bits": bits, "files": files, "tokens": tokens, "size": size, "documents": 0, "bigrams": {}, "hot": {}, "hot_ids": [], "contexts": {}, "d": [[0.0, 0.5, 1.0, 1.5]] * 2, "distinct": 0, "base_left": 1.0}
    if not tokens:
        return model
    h = np.array([END], U)
    documents = int(counts.Store(files, bits).lookup(h)[0][0])
    model["documents"] = documents
    hot = model["hot_ids"] = _hot(spark, files, max(1, tokens // buckets), documents)

    def pairs(batches):
        v, codes = Vocabulary(files, bits), Codes(size, buckets, hot)
        held, held_n = [], 0

        def flush():
            context, word = (np.concatenate(x) for x in zip(*held))
            own, at = np.unique(context, return_inverse=True)
            k, n = np.unique(at.astype(U) << U(codes.word_bits) | word.astype(U), return_counts=True)
            at, word = codes.split(k)
            bucket, key = codes(own[at], word)
            order = np.argsort(key)
            return counts.blobs(key[order], n[order], bucket[order])

        for whole in batches:
            for b in slices(whole, "t", _SOME):
                _, ids, _, before, _ = _steps(v, b.column("t"), documents)
                held.append((before, ids))
                held_n += len(ids)
                if held_n >= counts.FLUSH:
                    yield flush()
                    held, held_n = [], 0
        if held_n:
            yield flush()

    def reduce(batches):
        v, codes = Vocabulary(files, bits), Codes(size, buckets, hot)
        for bucket, k, n in counts.merged(batches):
            if len(k) >= 1 << 32:
                raise ValueError("so many bigrams need more buckets: raise spark.sql.shuffle.partitions")
            place, word = codes.split(k)
            kind = np.minimum(n, 3)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            own = place[first]
            by = [np.add.reduceat((kind == j).astype(np.int64), first) for j in (1, 2, 3)]
            path = f"{folder}/bigrams/{bucket:06d}-{shared.attempt_name()}"
            large = np.flatnonzero(n >= 255)
            shared.put(path, [k.astype("<u8").tobytes(), own.astype("<u8").tobytes(), *(x.astype("<u4").tobytes() for x in by), large.astype("<u4").tobytes(), n[large].astype("<u8").tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes()])
            # a hot context is here in part: its parts are added up elsewhere
            context, spread = codes.context_of(bucket, own)
            note = {"bucket": bucket, "path": path, "n": len(k), "own": len(own), "large": len(large), "seen": [int((n == j).sum()) for j in (1, 2, 3, 4)], "hot": [[int(context[i]), *(int(x[i]) for x in by)] for i in np.flatnonzero(spread).tolist()]}
            yield _rows([note])
            w, times = np.unique(word, return_counts=True)
            out = counts.blobs(w.astype(U), times, v.word_bucket(w))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([None] * len(out), pa.string())], names=["bucket", "keys", "counts", "note"])

    import json

    def _rows(notes):
        return pa.RecordBatch.from_arrays([pa.array([n["bucket"] for n in notes], pa.int32()), pa.array([None] * len(notes), pa.binary()), pa.array([None] * len(notes), pa.binary()), pa.array([json.dumps(n) for n in notes])], names=["bucket", "keys", "counts", "note"])

    shuffled = counts.by_bucket(rows.mapInArrow(shared.tidy(pairs), counts.BLOBS), buckets)
    made = shared.write_table(shuffled.mapInArrow(shared.tidy(reduce), f"{counts.BLOBS}, note string"), folder, "bigram_notes")
    seen = np.zeros(4, np.int64)
    for r in made.where("note IS NOT NULL").select("note").collect():  # a row for each file
        note = json.loads(r.note)
        model["bigrams"][note["bucket"]] = {x: note[x] for x in ("path", "n", "own", "large")}
        model["distinct"] += note["n"]
        seen += note["seen"]
        for context, *by in note["hot"]:
            model["hot"][context] = [a + b for a, b in zip(model["hot"].get(context, [0, 0, 0]), by)]

    def contexts(batches):
        v = Vocabulary(files, bits)
        for b, k, n in counts.merged(batches):
            out = np.zeros(v.store.files[v.names[b]]["n"], np.int64)
            out[k.astype(np.int64) - 1 - v.bases[b]] = n
            path = f"{folder}/contexts/{b:06d}-{shared.attempt_name()}"
            shared.put(path, [out.astype("<u8").tobytes()])
            yield _rows([{"bucket": b, "path": path, "seen": [int((n == j).sum()) for j in (1, 2, 3, 4)]}])

    held = counts.by_bucket(made.where("note IS NULL"), buckets).mapInArrow(shared.tidy(contexts), f"{counts.BLOBS}, note string")
    few = np.zeros(4, np.int64)
    for r in shared.write_table(held, folder, "context_notes").collect():
        note = json.loads(r.note)
        model["contexts"][note["bucket"]] = note["path"]
        few += note["seen"]
    model["d"] = [_discounts(seen.tolist()), _discounts(few.tolist())]
    low = model["d"][1]
    three = size - int(few[0] + few[1])
    model["base_left"] = (low[1] * int(few[0]) + low[2] * int(few[1]) + low[3] * three) / model["distinct"]
    return model


def _hot(spark, files: list[dict], share: int, documents: int) -> list[int]:
    """Contexts that stand before ``share`` tokens or more; there are as many as buckets at most."""

    def large(batches):
        for b in batches:
            for path, n, wide, base in zip(*(b.column(c).to_pylist() for c in ("path", "n", "wide", "base"))):
                times = shared.array_at(shared.mapped(path), "<u8" if wide else "<u4", 8 * n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(times >= share) + base + 1)], names=["id"])

    base = np.cumsum([0] + [f["n"] for f in files]).tolist()
    rows = [(f["path"], f["n"], f["wide"], at) for f, at in zip(files, base)]
    found = spark.createDataFrame(rows, "path string, n long, wide boolean, base long").repartition(min(len(rows), 64)).mapInArrow(shared.tidy(large), "id long")
    return sorted([r.id for r in found.collect()] + [0] * (documents >= share))


class Scorer:
    """Probabilities of a trained model."""

    def __init__(self, model: dict) -> None:
        self.m, self.open = model, shared.Views()
        self.vocabulary = Vocabulary(model["files"], model["bits"], model["contexts"])
        self.buckets = 1 << model["bits"]
        self.codes = Codes(model["size"], self.buckets, model["hot_ids"])
        self.hot_by = np.array([model["hot"].get(x, [0, 0, 0]) for x in self.codes.hot.tolist()], np.int64).reshape(-1, 3)

    def _bucket(self, b: int):
        f = self.m["bigrams"].get(b)
        if f is None:
            return None
        view, n, own, large = self.open(f["path"]), f["n"], f["own"], f["large"]
        at = 8 * n + 20 * own
        return (
            shared.array_at(view, "<u8", 0, n), shared.array_at(view, "<u8", 8 * n, own), [shared.array_at(view, "<u4", 8 * n + 8 * own + 4 * own * j, own) for j in range(3)],
            shared.array_at(view, "<u4", at, large), shared.array_at(view, "<u8", at + 4 * large, large), shared.array_at(view, np.uint8, at + 12 * large, n),
        )

    def low(self, ids: np.ndarray) -> np.ndarray:
        """q(w): the lower order, over numbers of distinct contexts."""
        n = self.vocabulary.followers(ids)
        d = np.array(self.m["d"][1])
        return np.maximum(n - d[np.minimum(n, 3)], 0) / max(1, self.m["distinct"]) + self.m["base_left"] / (self.m["size"] + 1)

    def __call__(self, col: pa.Array):
        """For each row: tokens, known tokens, base score and score."""
        m = self.m
        n, ids, many, before, ends = _steps(self.vocabulary, col, m["documents"])
        p = self.low(ids)
        ctx = np.flatnonzero((before >= 0) & (many > 0))
        c, w = before[ctx], ids[ctx]
        hot, index = self.codes.place(c)
        home, _ = self.codes(np.where(hot, 0, c), np.zeros(len(c), np.int64))
        own_place = c - self.codes.first(home)
        to, key = self.codes(c, np.maximum(w, 0))
        by = np.zeros((len(ctx), 3), np.int64)
        if hot.any():
            by[hot] = self.hot_by[index[hot]]
        seen = np.zeros(len(ctx), np.int64)
        for kind, where in (("context", np.where(hot, -1, home)), ("pair", np.where(w > 0, to, -1))):
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(self.buckets + 1))
            for b in range(self.buckets):
                some = order[edge[b] : edge[b + 1]]
                got = self._bucket(b) if len(some) else None
                if got is None:
                    continue
                keys, own, stats, large, large_n, small = got
                if kind == "context":
                    q = own_place[some].astype(U)
                    pos = np.minimum(np.searchsorted(own, q), len(own) - 1)
                    hit = own[pos] == q
                    for j in range(3):
                        by[some, j] = np.where(hit, stats[j][pos], 0)
                else:
                    q = key[some]
                    sort = np.argsort(q)
                    pos = np.empty(len(q), np.int64)
                    pos[sort] = np.minimum(np.searchsorted(keys, q[sort]), len(keys) - 1)
                    got_n = np.where(keys[pos] == q, small[pos], 0).astype(np.int64)
                    full = np.flatnonzero(got_n == 255)
                    if len(full):
                        got_n[full] = large_n[np.searchsorted(large, pos[full].astype(np.uint32))]
                    seen[some] = got_n
        d = np.array(m["d"][0])
        total = many[ctx]
        p[ctx] = np.maximum(seen - d[np.minimum(seen, 3)], 0) / total + (by @ d[1:]) / total * p[ctx]
        first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        base = np.log10((n + 1) / (m["tokens"] + m["size"] + 1))
        return ends - first, add((n > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, held_out: Column, folder: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Trains on the rows that are not held out and scores all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.
    """
    held = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{column}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(held.where(~F.col("held_out")), folder)
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches):
        scorer = Scorer(model)
        for whole in batches:
            for b in slices(whole, "text", _SOME):
                n, known, base, s = scorer(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model["tokens"], np.int64)), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return held.mapInArrow(shared.tidy(run), schema)
