import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import counts, graph, ngram, shared

WORDS = "the stone river of light and a small bird over old hills".split()


def corpus(n=120):
    rng = np.random.default_rng(2)
    return [(i, " ".join(rng.choice(WORDS + [f"w{i}" for i in range(40)], rng.integers(0, 40)))) for i in range(n)]


def test_blobs():
    rng = np.random.default_rng(0)
    for shift in (0, 20):
        k = np.unique(rng.integers(0, 2**62, 500).astype(np.uint64) >> np.uint64(shift) << np.uint64(shift))
        n = rng.integers(1, 400, len(k))
        out = counts.blobs(k, n, counts.bucket_of(k, 3))
        back = [counts.unblob(a, b) for a, b in zip(out.column("keys").to_pylist(), out.column("counts").to_pylist())]
        assert np.concatenate([x for x, _ in back]).tolist() == k.tolist() and np.concatenate([x for _, x in back]).tolist() == n.tolist()
    got = list(counts.merged([out, out]))
    assert sum(int(n.sum()) for _, _, n in got) >= n.sum()


def test_store(spark, folder):
    df = spark.createDataFrame([(i, f"a b c{i % 5}") for i in range(60)], "k long, t string")
    from paperloom.llm.tokens import word_hash, word_hashes

    rows = counts.map_blobs(df, lambda b: word_hashes(b.column("t"))[0], 2)
    files = counts.count(rows, folder, 2, least=13)
    store = counts.Store(files, 2)
    n, rank = store.lookup(np.array([word_hash(w) for w in ("b", "a", "c1", "zzz")], np.uint64))
    assert n.tolist() == [60, 60, 0, 0] and sorted(rank.tolist()) == [-1, -1, 0, 1]
    assert sum(f["total"] for f in files) == 180 and sum(f["distinct"] for f in files) == 7


def test_components(spark, folder):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 150), (200, 150)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long"), folder).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert graph.components(spark.createDataFrame([], "u long, v long"), f"{folder}2").count() == 0


def brute(docs, held):
    """Scores by dictionaries of words."""
    split = lambda t: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" "), None]
    tokens = {i: [w for w in split(t) if w != ""] for i, t in docs}
    train = [s for i, s in tokens.items() if not held[i]]
    c = Counter(w for s in train for w in s)
    n, v = sum(c.values()), len(c)
    pair = Counter((a, b) for s in train for a, b in zip(["<s>", *s], s))
    total = Counter(c)
    total["<s>"] = len(train)
    left = Counter(b for _, b in pair)
    discount = lambda x: ngram._discounts([sum(1 for y in x if y == k) for k in (1, 2, 3, 4)])
    high, low = discount(pair.values()), discount(left.values())
    by = {}
    for (a, _), k in pair.items():
        by.setdefault(a, Counter())[min(k, 3)] += 1
    spare = sum(low[min(k, 3)] for k in left.values()) / len(pair)
    q = lambda w: max(left[w] - low[min(left[w], 3)], 0) / len(pair) + spare / (v + 1)

    def p(a, b):
        if not total[a]:
            return q(b)
        k = pair[a, b]
        return max(k - high[min(k, 3)], 0) / total[a] + sum(high[j] * m for j, m in by[a].items()) / total[a] * q(b)

    words = set(c)
    for a in [*list(words)[:5], "<s>"]:  # a distribution: all words and one unknown
        assert abs(sum(p(a, w) for w in words) + p(a, "unknown!") - 1) < 1e-9
    return {i: (len(s), sum(w in c for w in s), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *s], s))) for i, s in tokens.items()}


def test_scores_equal_brute_force(spark, folder):
    rows = [*corpus(), (500, None), (501, "The THE the\tstone"), (502, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    want = brute(rows, held)
    for r in ngram.score(df, out, folder).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_odd_rows(spark, odd_docs, no_docs, folder):
    got = ngram.score(odd_docs, F.col("doc_id") == 4, folder).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 1] == [1]
    assert ngram.score(no_docs, F.lit(False), f"{folder}2").count() == 0
    untrained = ngram.score(odd_docs, F.lit(True), f"{folder}3").collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)
    json.dumps([r.doc_id for r in untrained])


def test_counts_above_32_bits(spark, folder):
    keys = np.array([3, 5, 1 << 63], np.uint64)
    n = np.array([1, (1 << 33) + 7, 1 << 40])

    def blobs(batches):
        for _ in batches:
            yield counts.blobs(keys, n, counts.bucket_of(keys, 2))

    rows = spark.range(1).repartition(1).mapInArrow(blobs, counts.BLOBS)
    files = counts.count(rows.unionByName(rows), folder, 2)
    got, rank = counts.Store(files, 2).lookup(np.array([5, 4, 1 << 63, 3], np.uint64))
    assert got.tolist() == [2 * ((1 << 33) + 7), 0, 1 << 41, 2] and rank[1] == -1


def test_bigram_keys_of_many_words():
    size, buckets = (1 << 36) - 5, 1 << 10
    codes = ngram.Codes(size, buckets, [0, 17, 1 << 35])
    rng = np.random.default_rng(6)
    context = np.concatenate([[0, 17, 1 << 35, 1, size], rng.integers(0, size, 500)])
    word = np.concatenate([[size, 1, 1 << 33, 1, 1], rng.integers(1, size, 500)])
    bucket, key = codes(context, word)
    assert (bucket >= 0).all() and (bucket < buckets).all()
    for c, w, b, k in zip(context.tolist(), word.tolist(), bucket.tolist(), key):
        place, back = codes.split(np.array([k]))
        own, hot = codes.context_of(b, place)
        assert (int(own[0]), int(back[0]), bool(hot[0])) == (c, w, c in (0, 17, 1 << 35))
    with pytest.raises(ValueError):
        ngram.Codes(1 << 40, 8, [])


def test_views_are_bounded(monkeypatch):
    monkeypatch.setattr(shared, "_local", lambda uri: None)
    monkeypatch.setattr(shared, "mapped", lambda uri: memoryview(bytes(100)))
    views = shared.Views(most=1000, files=8)
    for i in range(200):
        assert len(views(f"s3://x/{i % 40}")) == 100
        assert views.size <= 1000 and len(views.held) <= 8
    views = shared.Views(most=50)
    assert len(views("a")) == 100 == len(views("b")) and views.size == 100


def test_a_cluster_must_name_its_folder():
    class Nothing:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Nothing()

    class Session:
        conf, sparkContext = Nothing(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(Session())
