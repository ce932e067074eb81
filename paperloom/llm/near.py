"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

A shingle is five words (a shorter text is one shingle).  Its weight is tf * N / (N + df): the inverse
document frequency is gentle on purpose, since with a logarithm the shingles that copies share would
weigh a third of the edits, and copies would fall under the threshold for being many.

1. All shingles' document frequencies are counted over the corpus (``counts``).
2. A shingle that no other document has cannot be shared.  A text whose shared shingles weigh less
   than the threshold's part of it therefore has no partner; the rest are the candidates.
3. Candidates get 42 consistent weighted samples in 14 bands of 3; equal texts are one candidate.
4. The members of a band's bucket are compared by weighted Jaccard similarity.  Those of a large bucket
   meet its first member; what is not like it meets all others, in blocks, so a bucket of any size is
   done by many tasks.  A task returns only a spanning forest of the links it finds, which has the same
   classes as all of them.
5. Connected components of the links are the classes; the least doc_id names each.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**3)**14 = 0.00004.

A null text is empty; texts without words are near only to equal texts.  A row whose doc_id is null
stands alone, with a null class.  Repeated rows share a class.  Several texts under one id are apart:
each belongs to the class of its own text.  An empty table gives no rows.  Columns of docs other than the
key and the text play no part, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts, shared
from .counts import U
from .drops import ALL, ONE, once, text_hash, without
from .frames import slices
from .graph import Forest, components, join_sized
from .tokens import mix, shingles, word_hashes

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 14, 3
#: Members of a block of a bucket, and of a tile that one matrix product compares.
BLOCK, TILE, COLUMNS = 512, 256, 4096
_PIECE = 1 << 20


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by Newton's steps."""
    q = (np.arange(n) + 0.5) / n
    x = np.full(n, 1.5)
    x[:] = np.sqrt(2 * q) + q
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return x


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = _gamma_quantiles()
    return x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32)


def samples(g: np.ndarray, log_weight: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples (32 bits each) of each non-empty row of weighted features."""
    r_of, inverse, log_c = _draws()
    out = np.empty((len(at) - 1, k), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = g * U((2 * i + 1) * 0xD1342543DE82EF95 % (1 << 64) | 1)
            h ^= h >> U(29)
            h *= U(0xBF58476D1CE4E5B9)
            h ^= h >> U(32)
            first = (h >> U(48)).astype(np.int64)
            r, beta = r_of[first], (h & U(0xFFFFFFFF)).astype(np.float32) * np.float32(2**-32)
            t = np.floor(log_weight * inverse[first] + beta)
            value = log_c[(h >> U(32) & U(0xFFFF)).astype(np.int64)] - r * (t - beta + np.float32(1))
            bits = value.view(np.uint32).astype(U)
            rising = np.where(bits >> U(31), ~bits & U(0xFFFFFFFF), bits | U(0x80000000))
            what = (h ^ (t.astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15))) * U(0xC2B2AE3D27D4EB4F) >> U(32)
            out[:, i] = (np.minimum.reduceat(rising << U(32) | what, at[:-1]) & U(0xFFFFFFFF)).astype(np.uint32)
    return out


def weighted(col: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, times, at): the distinct shingles of each row."""
    h, _, _, at = word_hashes(col)
    g, at = shingles(h, at, words)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(g)
    gs, rs = g[order], row[order]
    same = gs[1:] == gs[:-1]
    if same.any():
        run = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        some = np.flatnonzero(run)
        again = some[np.lexsort((order[some], rs[some], gs[some]))]
        order[some], gs[some], rs[some] = order[again], gs[again], rs[again]
        first = np.flatnonzero(np.concatenate([[True], ~same | (rs[1:] != rs[:-1])]))
    else:
        first = np.arange(len(gs))
    times = np.diff(np.concatenate([first, [len(gs)]]))
    back = np.argsort(order[first])
    g, times, row = gs[first][back], times[back], rs[first][back]
    return g, times, np.searchsorted(row, np.arange(len(at)))


def kept_bits(documents: int) -> int:
    """Bits of a shingle's hash that its frequency is kept under: so many that at any size about one in 40,000 meets another's.

    One that does counts as shared, which costs a comparison and never a link.
    """
    return min(64, 24 + documents.bit_length())


def cut(g: np.ndarray, kept: int) -> np.ndarray:
    return g & ~U((1 << (64 - kept)) - 1)


def frequencies(rows: DataFrame, folder: str, documents: int, words: int = WORDS) -> tuple[list[dict], int]:
    """The store of shingles of two documents or more, and its bits."""
    bits, kept = counts.bits_for(rows.sparkSession), kept_bits(documents)
    found = counts.map_blobs(rows, lambda b: cut(weighted(b.column("t"), words)[0], kept), bits, _PIECE)
    return counts.count(found, folder, bits, least=2), bits


_SIGNED = "k long, text_hash binary, can boolean, path string, at long, n int, total double, bands array<long>"


def sign(rows: DataFrame, folder: str, files: list[dict], bits: int, documents: int, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """A row for each of (k, t); ``can`` is false where the text can have no partner."""

    def run(batches):
        store, kept = counts.Store(files, bits), kept_bits(documents)
        path = f"{folder}/{shared.attempt_name()}"
        rows_out: list[pa.RecordBatch] = []

        def vectors():
            at = 0
            for whole in batches:
                for b in slices(whole, "t", _PIECE):
                    g, times, ptr = weighted(b.column("t"), words)
                    df, _ = store.lookup(cut(g, kept))
                    idf = documents / (documents + np.maximum(df, 1))
                    w = idf * times
                    total = np.concatenate([[0.0], np.cumsum(w)])
                    common = np.concatenate([[0.0], np.cumsum(np.where(df > 1, w, 0.0))])
                    whole_w, shared_w = total[ptr[1:]] - total[ptr[:-1]], common[ptr[1:]] - common[ptr[:-1]]
                    keys = b.column("k")
                    can = (shared_w >= (threshold - 1e-6) * whole_w) & ~np.array(keys.is_null())
                    size = np.diff(ptr)
                    some = np.flatnonzero(can & (size > 0))
                    bands: list[list[int] | None] = [None] * len(can)
                    place = np.zeros((len(can), 2), np.int64)
                    weight = np.zeros(len(can))
                    if len(some):
                        take = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in some])
                        own = np.concatenate([[0], np.cumsum(size[some])])
                        sig = samples(g[take], np.log(w[take]).astype(np.float32), own, BANDS * ROWS).astype(U).reshape(len(some), BANDS, ROWS)
                        with np.errstate(over="ignore"):
                            key = mix((sig * (np.arange(1, ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15) | U(1))).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U) * U(0xA0761D6478BD642F))
                        for i, x in zip(some.tolist(), key.view(np.int64).tolist()):
                            bands[i] = x
                        for i in some.tolist():
                            lo, hi = ptr[i], ptr[i + 1]
                            keep = np.flatnonzero(df[lo:hi] > 1) + lo
                            level = np.repeat(np.arange(len(keep)), times[keep])
                            turn = np.arange(len(level)) - np.repeat(np.cumsum(times[keep]) - times[keep], times[keep])
                            with np.errstate(over="ignore"):
                                f = g[keep][level] + turn.astype(U) * U(0xD6E8FEB86659FD93)
                            order = np.argsort(f)
                            place[i] = at, len(f)
                            weight[i] = whole_w[i]
                            at += 12 * len(f)
                            yield f[order].astype("<u8").tobytes() + idf[keep][level][order].astype("<f4").tobytes()
                    names = [text_hash(t) for t in b.column("t").to_pylist()]
                    rows_out.append(pa.RecordBatch.from_arrays([keys, pa.array(names, pa.binary()), pa.array(can), pa.array([path] * len(can)), pa.array(place[:, 0]), pa.array(place[:, 1].astype(np.int32)), pa.array(weight), pa.array(bands, pa.list_(pa.int64()))], names=["k", "text_hash", "can", "path", "at", "n", "total", "bands"]))

        shared.put(path, vectors())
        yield from rows_out

    return rows.mapInArrow(shared.tidy(run), _SIGNED)


@lru_cache(maxsize=1)
def _views() -> shared.Views:
    """One for a worker."""
    return shared.Views()


def _vector(path: str, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    view = _views()(path)
    return shared.array_at(view, "<u8", at, n), shared.array_at(view, "<f4", at + 8 * n, n)


def links_of(members: list[tuple], left: list[int], right: list[int], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right members (path, at, n, total), as index pairs."""
    forest, out = Forest(len(members)), []
    if len(left) * len(right) <= 64:
        kept = {i: _vector(*members[i][:3]) for i in {*left, *right}}
        for i in left:
            for j in right:
                if i == j or forest.root(i) == forest.root(j) or min(members[i][3], members[j][3]) < (threshold - 1e-6) * max(members[i][3], members[j][3]):
                    continue
                (a, w), (b, _) = kept[i], kept[j]
                pos = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                both = float(w[b[pos] == a].sum(dtype=np.float64)) if len(b) and len(a) else 0.0
                if both >= threshold * (members[i][3] + members[j][3] - both) - 1e-9 and forest.join(i, j):
                    out.append((i, j))
        return out
    total = np.array([m[3] for m in members])
    tiles = lambda x: [np.array(x[i : i + TILE]) for i in range(0, len(x), TILE)]
    same = left == right
    for p, a in enumerate(tiles(left)):
        for b in tiles(right)[p if same else 0 :]:
            if len({forest.root(int(i)) for i in np.concatenate([a, b])}) == 1:
                continue
            both = _tile(members, a, b)
            ok = both >= threshold * (total[a][:, None] + total[b][None, :] - both) - 1e-5 * total[a][:, None]
            for x, y in np.argwhere(ok).tolist():
                i, j = int(a[x]), int(b[y])
                if i != j and forest.root(i) != forest.root(j) and links_of([members[i], members[j]], [0], [1], threshold):
                    forest.join(i, j)
                    out.append((i, j))
    return out


def _tile(members: list[tuple], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights that the members of two tiles share, by products of bounded matrices."""
    sides = []
    for side in (a, b):
        v = [_vector(*members[i][:3]) for i in side.tolist()]
        sides.append((np.concatenate([x for x, _ in v]), np.concatenate([w for _, w in v]), np.repeat(np.arange(len(v)), [len(x) for x, _ in v])))
    features = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(a), len(b)))
    placed = []
    for h, w, row in sides:
        pos = np.searchsorted(features, h)
        pos[pos == len(features)] = 0
        hit = np.flatnonzero(features[pos] == h) if len(features) else np.empty(0, np.int64)
        hit = hit[np.argsort(pos[hit], kind="stable")]
        placed.append((pos[hit], w[hit], row[hit]))
    for lo in range(0, len(features), COLUMNS):
        m = []
        for (pos, w, row), n, one in zip(placed, (len(a), len(b)), (False, True)):
            s, e = np.searchsorted(pos, [lo, lo + COLUMNS])
            x = np.zeros((n, min(COLUMNS, len(features) - lo)), np.float32)
            x[row[s:e], pos[s:e] - lo] = 1 if one else w[s:e]
            m.append(x)
        out += m[0] @ m[1].T
    return out


_MEMBER = ["k", "path", "at", "n", "total"]


def bucket_links(members: DataFrame, folder: str, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (u, v) of rows (bucket, k, path, at, n, total): as many as connect all members of a bucket that links connect.

    A bucket of up to ``block`` members is one task's work.  In a larger one all members are compared with
    the first; those that are not like it are then compared, block by block, with all members, while two that
    are like it need no more links.
    """
    members = members.select("bucket", *_MEMBER)
    first = members.groupBy("bucket").agg(F.count("*").alias("many"), F.min(F.struct(*_MEMBER)).alias("first")).where("many > 1")
    first = shared.write_table(first, folder, "buckets")
    many = members.count()
    small = join_sized(members, first.where(F.col("many") <= block).select("bucket", "many"), "bucket", "many", many)
    large = join_sized(members, first.where(F.col("many") > block), "bucket", "many", many)

    def compare(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in (*_MEMBER, "first"))))
            linked = [r[0] == r[5]["k"] or bool(links_of([r[1:5], tuple(r[5][c] for c in _MEMBER[1:])], [0], [1], threshold)) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bucket", *_MEMBER, "many")), pa.array([r[5]["k"] for r in rows], pa.int64()), pa.array(linked, pa.bool_())], names=["bucket", *_MEMBER, "many", "first", "linked"])

    star = shared.write_table(large.select("bucket", *_MEMBER, "many", "first").mapInArrow(shared.tidy(compare), "bucket long, k long, path string, at long, n int, total double, many long, first long, linked boolean"), folder, "stars")
    loose = star.where("NOT linked").groupBy("bucket").agg(F.count("*").alias("apart"))
    open_ones = join_sized(star, loose, "bucket", "apart", many)
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("k"), n).cast("int")
    none, yes, no = F.lit(0), F.lit(True), F.lit(False)
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    work = (
        small.select("bucket", none.alias("i"), none.alias("j"), yes.alias("left"), yes.alias("right"), *_MEMBER)
        .unionByName(open_ones.where("NOT linked").select("bucket", own(blocks("apart")).alias("i"), to(blocks("many")).alias("j"), yes.alias("left"), no.alias("right"), *_MEMBER))
        .unionByName(open_ones.select("bucket", to(blocks("apart")).alias("i"), own(blocks("many")).alias("j"), no.alias("left"), yes.alias("right"), *_MEMBER))
    )
    work = work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        def done(rows):
            members = [r[3:] for r in rows]
            left, right = ([x for x, r in enumerate(rows) if r[side]] for side in (0, 1))
            return [(rows[x][2], rows[y][2]) for x, y in links_of(members, left, right, threshold) if rows[x][2] != rows[y][2]]

        at, rows, out = None, [], []
        for b in batches:
            for bucket, i, j, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, i, j) != at:
                    if rows:
                        out += done(rows)
                    at, rows = (bucket, i, j), []
                rows.append(rest)
            if out:
                yield _links(out)
                out = []
        if rows and (out := done(rows)):
            yield _links(out)

    def _links(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    return work.mapInArrow(shared.tidy(run), "u long, v long").unionByName(star.where("linked AND k <> first").select(F.col("first").alias("u"), F.col("k").alias("v")))


def classes(docs: DataFrame, folder: str, column: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, class_size, text_hash, class_text): a row for each row of docs.

    A class is named by the id and the text hash of its first row (least id, then least hash), so that texts
    under one id are apart.
    """
    rows = counts.text_rows(docs, column, key)
    documents = docs.count()
    files, bits = frequencies(rows, f"{folder}/frequencies", documents, words)
    signed = shared.write_table(sign(rows, f"{folder}/vectors", files, bits, documents, threshold, words), folder, "signed")
    candidates = signed.where("can")
    # a node for each text: equal texts have equal vectors, so any row's will do
    texts = candidates.groupBy("text_hash").agg(F.min("k").alias("first"), F.count("*").alias("copies"), F.first(F.struct("path", "at", "n", "total", "bands")).alias("v"))
    texts = shared.write_table(texts.withColumn("node", F.monotonically_increasing_id()), folder, "texts")
    members = shared.write_table(texts.select(F.explode("v.bands").alias("bucket"), F.col("node").alias("k"), "v.path", "v.at", "v.n", "v.total"), folder, "members")
    label = components(bucket_links(members, f"{folder}/links", threshold), f"{folder}/components")
    placed = shared.write_table(texts.select("text_hash", "first", "copies", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), folder, "placed")
    sizes = shared.write_table(placed.groupBy("label").agg(F.sum("copies").alias("class_size"), F.count("*").alias("texts"), F.min(F.struct("first", "text_hash")).alias("least")), folder, "classes")
    named = join_sized(placed.select("text_hash", "copies", "label"), sizes, "label", "texts", documents)
    named = shared.write_table(named.select("text_hash", "copies", F.col("least.first").alias("class_id"), F.col("least.text_hash").alias("class_text"), "class_size"), folder, "named")
    near = join_sized(candidates.select("k", "text_hash"), named, "text_hash", "copies", documents).select("k", "class_id", "class_size", "text_hash", "class_text")
    alone = signed.where("NOT can").select("k", F.col("k").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "text_hash", F.col("text_hash").alias("class_text"))
    return near.unionByName(alone).select(F.col("k").alias(key), "class_id", "class_size", F.lower(F.hex("text_hash")).alias("text_hash"), F.lower(F.hex("class_text")).alias("class_text"))


def keep_one(docs: DataFrame, folder: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs of each class, that of the least id, then of the least text hash; all columns stay.

    Of repeated rows of that id and text one stays; rows with a null id stay.
    """
    found = shared.write_table(classes(docs, folder, column, key), folder, "classes_of_rows")
    rows = found.where("class_size > 1").select(F.col(f"`{key}`").alias("k"), F.unhex("text_hash").alias("text_hash"), "class_id", F.unhex("class_text").alias("class_text"))
    first = F.first((F.col("k") == F.col("class_id")) & (F.col("text_hash") == F.col("class_text")))
    return without(docs, once(rows, F.when(first, ONE).otherwise(ALL)), f"{folder}/gone", column, key)
