import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

from paperloom.llm import drops, leaks, near, passages, toxicity

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in "ka lo mi ne pu ra so ti".split() for b in "bar den fil gon hus jat".split()]


def text(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(words, k):
    out = list(words)
    for i in RNG.sample(range(len(out)), k):
        out[i] = RNG.choice(VOCABULARY) + "x"
    return out


def shingles(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Classes by all pairs, plain weighted Jaccard."""
    s = [shingles(t) for _, t in rows]
    df = Counter(g for x in s for g in x)
    w = [{g: k * len(rows) / (len(rows) + df[g]) for g, k in x.items()} for x in s]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(v, w[j].get(g, 0)) for g, v in w[i].items())
            all_ = sum(w[i].values()) + sum(w[j].values()) - both
            if rows[i][1] == rows[j][1] or (all_ and both / all_ >= 0.8):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def documents():
    rows = []
    for _ in range(25):
        base = text(RNG.randint(20, 200))
        rows += [base, base, edited(base, 1), edited(base, 2), edited(base, 8)]
    line = text(30)
    rows += [line + text(60) for _ in range(20)] + [["a"] * 40, ["a"] * 40, ["a"] * 41]
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(900, ""), (901, ""), (902, "one two"), (903, "one two"), (904, " ")]


def test_classes_equal_brute_force(spark, folder):
    rows = documents()
    got = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert got == brute_classes(rows)


def test_large_buckets_in_blocks(spark, folder, monkeypatch):
    base = text(120)
    rows = [(i, " ".join(edited(base, i % 3))) for i in range(60)] + [(100 + i, " ".join(text(100))) for i in range(10)]
    blocks = near.bucket_links
    monkeypatch.setattr(near, "bucket_links", lambda members, folder, threshold: blocks(members, folder, threshold, 7))
    got = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert got == brute_classes(rows)


def test_texts_under_one_id_are_apart(spark, folder):
    a, b = " ".join(text(60)), " ".join(text(60))
    docs = spark.createDataFrame([(3, b), (5, a), (5, b), (9, a), (9, None), (9, ""), (None, a), (None, a)], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.class_size, r.class_text == r.text_hash) for r in near.classes(docs, folder).collect() if r.doc_id}
    assert got == {(3, 3, 2, True), (5, 5, 2, True), (5, 3, 2, True), (9, 5, 2, True), (9, 9, 2, True)}
    kept = [(r.doc_id, r.text or "") for r in near.keep_one(docs, f"{folder}2").collect()]
    assert sorted(kept, key=str) == sorted([(3, b), (5, a), (9, ""), (None, a), (None, a)], key=str)


def test_columns_with_clashing_names(spark, folder):
    names = "k, t, v, bucket, i, j, path, at, n, total, bands, many, first, label, node, class_id, class_size, text_hash, kind, toxic, _id, _same, rejected, words, item, item_id, start".split(", ")
    base = " ".join(text(80))
    rows = [(1, base, *["x"] * len(names)), (2, base, *["y"] * len(names)), (3, " ".join(text(80)), *["z"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(7, rows[2][1], "x")], "item_id long, text string, doc_id string")
    labels = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 1, "x"), (3, 0, "x")], "doc_id long, toxic int, text string")
    kept = near.keep_one(docs, f"{folder}1")
    assert kept.columns == docs.columns and {r.doc_id: r.k for r in kept.collect()} == {1: "x", 3: "z"}
    left = leaks.drop_leaks(docs, items, f"{folder}2")
    assert left.columns == docs.columns and {r.doc_id: r.item for r in left.collect()} == {1: "x", 2: "y"}
    assert {(r.doc_id, r.item_id) for r in leaks.find(docs, items, f"{folder}3").collect()} == {(3, 7)}
    assert toxicity.grade(docs, toxicity.fit(docs, labels)).count() == 3
    assert {r.doc_id: r.class_docs for r in passages.repeated(docs, f"{folder}4").collect()} == {1: 2, 2: 2}


def test_leaks_go_by_id_and_text(spark, folder):
    item, clean = " ".join(text(30)), " ".join(text(60))
    docs = spark.createDataFrame([(1, clean), (1, f"{clean[:40]} {item}"), (2, clean), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(4, item), (4, item), (5, None), (6, "")], "item_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in leaks.drop_leaks(docs, items, folder).collect()), key=str) == sorted([(1, clean), (2, clean), (None, item)], key=str)
    assert leaks.find(docs, items.limit(0), f"{folder}2").count() == 0 == leaks.find(docs.limit(0), items, f"{folder}3").count()


def test_listed_rows_go(spark, folder):
    docs = spark.createDataFrame([(i % 50, f"t{i % 3}", i) for i in range(300)], "doc_id long, text string, n int")
    listed = spark.createDataFrame([(i, drops.text_hash(f"t{i % 3}"), drops.ALL) for i in range(10)] + [(i, drops.text_hash("t1"), drops.ONE) for i in range(20, 30)], "k long, text_hash binary, kind int")
    left = [(r.doc_id, r.text) for r in drops.without(docs, listed, folder).collect()]
    want = [(r.doc_id, r.text) for r in docs.collect() if not (r.doc_id < 10 and r.text == f"t{r.doc_id % 3}")]
    one = Counter(x for x in want if 20 <= x[0] < 30 and x[1] == "t1")
    assert Counter(left) == Counter(want) - one + Counter(dict.fromkeys(one, 1))


def test_tiles_find_what_pairs_find(tmp_path):
    base = text(150)
    col = pa.array([" ".join(edited(base, RNG.randint(0, 6))) for _ in range(40)])
    g, times, at = near.weighted(col)
    parts, members, pos = [], [], 0
    for i in range(len(col)):
        f = np.sort(g[at[i] : at[i + 1]])
        parts.append(f.astype("<u8").tobytes() + np.ones(len(f), "<f4").tobytes())
        members.append((f"file://{tmp_path}/v", pos, len(f), float(len(f))))
        pos += 12 * len(f)
    (tmp_path / "v").write_bytes(b"".join(parts))
    everyone = list(range(len(members)))
    tiled = near.links_of(members, everyone, everyone, 0.8)
    up = near.Forest(len(members))
    for i in everyone:
        for j in everyone[:i]:
            if near.links_of(members, [i], [j], 0.8):
                up.join(i, j)
    again = near.Forest(len(members))
    for i, j in tiled:
        assert again.join(i, j)
    assert [again.root(i) for i in everyone] == [up.root(i) for i in everyone]


def test_odd_rows(spark, odd_docs, no_docs, folder):
    got = near.classes(odd_docs, folder).collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.class_id, r.class_size) for r in got}
    assert {(5, 5, 3), (6, 5, 3), (None, None, 1), (1, 1, 2), (2, 1, 2), (4, 4, 1)} <= by
    kept = near.keep_one(odd_docs, f"{folder}2")
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7]
    assert near.classes(no_docs, f"{folder}3").count() == 0 and near.keep_one(no_docs, f"{folder}4").count() == 0


def test_similarity_of_samples():
    base = text(400)
    other = edited(base, 8)
    g, times, at = near.weighted(pa.array([" ".join(base), " ".join(other)]))
    sig = near.samples(g, np.log(times).astype(np.float32), at, 600)
    a, b = shingles(" ".join(base)), shingles(" ".join(other))
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.06


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(150):
        sizes = rng.integers(0, 40, 5)
        at = np.concatenate([[0], np.cumsum(sizes)])
        v = rng.integers(0, rng.choice([5, 50, 10**9]), at[-1]).astype(np.uint32)
        least = int(rng.integers(1, 12))
        want = []
        for a, b in zip(at[:-1], at[1:]):
            for c in range(a, b):
                l = r = c  # noqa: E741
                while l > a and v[l - 1] > v[c]:
                    l -= 1  # noqa: E741
                while r + 1 < b and v[r + 1] >= v[c]:
                    r += 1
                if r - l + 1 >= least:
                    want.append((l, c, r))
        assert sorted(zip(*(x.tolist() for x in passages.compact_windows(v, at, least)))) == sorted(want)


def test_repeats_of_a_value_cost_no_steps():
    """Lines that are run grow with neither the repeats of a least value nor their number of windows."""
    v = np.tile(np.random.default_rng(1).permutation(30).astype(np.uint32), 700)
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        if frame.f_code.co_filename != passages.__file__:
            return None
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        left, c, right = passages.compact_windows(v, np.array([0, len(v)]), 46)
    finally:
        sys.settrace(before)
    assert lines < 3000
    zero = np.flatnonzero(v == 0)
    want = [(lo, z, len(v) - 1) for lo, z in zip([0, *(zero[:-1] + 1).tolist()], zero.tolist()) if len(v) - lo >= 46]
    assert list(zip(left.tolist(), c.tolist(), right.tolist())) == want


def test_repeated_tokens_meet_the_nearest():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.sort(rng.choice(200, rng.integers(1, 60), replace=False)) for _ in "ab")
        a, b = ((rng.integers(0, 40, len(x)).astype(np.uint32), x) for x in (a, b))
        shared = [(int(t), int(p)) for t, p in zip(*a) if t in b[0]]
        if not shared:
            assert not len(passages._chain(a, b)[0])
            continue
        of = {t: b[1][b[0] == t].tolist() for t, _ in shared}
        sole = [of[t][0] - p for t, p in shared if len(of[t]) == 1]
        shift = int(np.median(sole)) if sole else min(of[t][0] for t, _ in shared) - min(p for _, p in shared)
        near = {p: min(of[t], key=lambda q: (abs(q - p - shift), q)) for t, p in shared}
        p, q = passages._chain(a, b)
        assert all(near[x] == y for x, y in zip(p.tolist(), q.tolist()))
        assert (np.diff(p) > 0).all() and (np.diff(q) > 0).all()


def test_repeated_passages(spark, folder):
    p, q = text(60), text(80)
    rows = [text(100) + p + text(30), text(5) + p + text(200), p, text(40) + edited(q, 1) + text(3), q + text(90), text(300), text(30) + p[:30] + text(30)]
    rows += [["x"] * 100, ["x"] * 120]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)] + [(None, " ".join(p)), (50, None)], "doc_id long, text string")
    got = {}
    for r in passages.repeated(df, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.class_id, r.class_docs))
    assert got[0] == [(100, 160, 0, 3)] and got[1] == [(5, 65, 0, 3)] and got[2] == [(0, 60, 0, 3)]
    assert got[3][0][2:] == (3, 2) and got[3][0][0] <= 45 and got[4][0][2:] == (3, 2)
    assert set(got) == {0, 1, 2, 3, 4, 7, 8}


def region(x, y):
    """Shared tokens and their places of two lists of words, as verify takes them."""
    s = [[" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for w in (x, y)]
    ids = {t: i for i, t in enumerate(sorted(set(s[0]) & set(s[1])))}
    side = lambda t: (np.array([ids[g] for g in t if g in ids], np.uint32), np.array([i for i, g in enumerate(t) if g in ids], np.int64))
    return side(s[0]), side(s[1])


def brute_stretch(a, b, least, threshold):
    """The length of the longest stretches (its shorter side) that begin and end with shared tokens and are similar, by all pairs of ends; 0 if none."""
    best = 0
    at = {int(t): int(p) for t, p in zip(*b)}
    pairs = [(int(p), at[int(t)]) for t, p in zip(*a)]
    for i, (l1, l2) in enumerate(pairs):
        for j in range(i, len(pairs)):
            r1, r2 = pairs[j]
            n1, n2 = r1 - l1 + 1, r2 - l2 + 1
            both = len({int(t) for t in a[0][(a[1] >= l1) & (a[1] <= r1)]} & {int(t) for t in b[0][(b[1] >= l2) & (b[1] <= r2)]})
            if min(n1, n2) >= least and both >= threshold * (n1 + n2 - both) - 1e-9:
                best = max(best, min(n1, n2))
    return best


def test_edits_within_a_passage_equal_brute_force():
    rng = random.Random(5)
    word = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randrange(10**6)}" for _ in range(n)]
    found = lost = 0
    for n in (55, 60, 70, 80, 100):
        for at in range(0, n, 3):
            p = word(n)
            q = list(p)
            q[at] = "edit"
            if at % 2:
                q[(at * 7) % n : (at * 7) % n + 1] = []
            a, b = region(word(12) + p + word(9), word(7) + q + word(11))
            want = brute_stretch(a, b, passages.LEAST, passages.THRESHOLD)
            got = passages.verify(a, b)
            assert max((min(r1 - l1, r2 - l2) + 1 for l1, r1, l2, r2 in got), default=0) == want
            found, lost = found + bool(want), lost + (not want)
    assert found > 80 and lost > 0
    p = word(1000)
    q = [w if i % 48 else "edit" + w for i, w in enumerate(p)]
    (l1, r1, l2, r2), *_ = passages.verify(*region(p, q))
    assert r1 - l1 > 900 and r2 - l2 > 900


def test_repeated_lines_within_a_passage():
    rng = random.Random(6)
    word = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randrange(10**6)}" for _ in range(n)]
    line, p, stray = word(20), word(50), word(8)
    x = stray + word(30) + p + line * 3 + word(30) + stray
    y = stray + word(60) + p + line + word(60) + stray
    assert any(l1 <= 38 and r1 >= 38 + 65 for l1, r1, _, _ in passages.verify(*region(x, y)))
    x, y = ["x"] * 100 + word(10), ["x"] * 120 + word(12)
    assert passages.verify(*region(x, y)) == [(0, 95, 0, 115)]


def test_passages_between_fragments_equal_brute_force(spark, folder):
    rng = random.Random(8)
    word = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(30):  # two documents share a passage; more share only fragments of it, and some stand first and last
        p = word(54)
        part = [word(20) + p[a : a + 44] + word(20) for a in (0, 10, 5, 3)]
        rows.append((part[0], word(30) + p + word(25), word(12) + p + word(40), part[1], part[2], part[3]))
    docs = [(100 * k + g, " ".join(r[k])) for g, r in enumerate(rows) for k in range(6)]
    runs = {}
    for i, t in docs:  # all runs of 50 words, which is what the method must find
        w = t.split()
        for j in range(len(w) - 49):
            runs.setdefault(tuple(w[j : j + 50]), set()).add(i)
    want = {frozenset(x) for x in runs.values() if len(x) > 1}
    got = {}
    for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string"), folder).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert len(want) == 30 and {frozenset(x) for x in got.values()} == want


def test_rest_pairs_in_blocks(spark, folder, monkeypatch):
    rng = random.Random(9)
    word = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randrange(10**6)}" for _ in range(n)]
    p = word(90)
    cut = lambda a, n: word(15) + p[a : a + n] + word(15)
    rows = [cut(0, 42)] * 2 + [cut(40, 50), cut(38, 52), cut(0, 46), cut(25, 46)] + [cut(41, 44) for _ in range(12)] + [cut(46, 44)]
    rest = passages._rest_links
    monkeypatch.setattr(passages, "_rest_links", lambda *a: rest(*a, 3))
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated(df, folder).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_repeated_rows_are_one_document(spark, folder):
    p = text(70)
    rows = [(1, " ".join(p)), (1, " ".join(p)), (2, " ".join(text(60))), (2, "x " + " ".join(p)), (4, " ".join(text(80))), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.class_id, r.class_docs) for r in passages.repeated(df, folder).collect()}
    assert got == {(1, 0, 1, 2), (2, 1, 1, 2)}
    assert passages.repeated(spark.createDataFrame(rows[:3], df.schema), f"{folder}2").count() == 0


def test_passages_of_odd_rows(spark, odd_docs, no_docs, folder):
    assert passages.repeated(odd_docs, folder).count() == 0
    assert passages.repeated(no_docs, f"{folder}2").count() == 0


def test_alignment_equals_a_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64)
        texts = [rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(3)]
        best, end = leaks.align(a, texts)
        for t, s, e in zip(texts, best.tolist(), end.tolist()):
            h = np.zeros((len(a) + 1, len(t) + 1), int)
            for i in range(len(a)):
                for j in range(len(t)):
                    h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == t[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            assert s == h.max() and (s == 0 or h[:, e].max() == s)


def test_leaks(spark, odd_docs, no_docs, folder):
    items = [text(30) for _ in range(6)] + [["to", "be"]]
    docs = [text(200) for _ in range(40)]
    for i in range(5):
        docs[i][50:50] = edited(items[i], 3 * (i % 3))
    docs[7][10:10] = items[5][:10]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)] + [(99, None), (100, "to be")], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(20, None), (21, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.find(d, b, folder).collect()}
    assert set(got) == {(i, i) for i in range(5)}
    assert got[0, 0].similarity == 1.0 and (got[0, 0].start_word, got[0, 0].end_word) == (50, 80)
    assert {r.doc_id for r in leaks.drop_leaks(d, b, f"{folder}2").collect()} == {*range(5, 40), 99, 100}
    assert leaks.find(odd_docs, b, f"{folder}3").count() == 0 and leaks.find(no_docs, b, f"{folder}4").count() == 0
    assert leaks.find(d, b.limit(0), f"{folder}5").count() == 0
    assert leaks.drop_leaks(odd_docs, b, f"{folder}6").count() == odd_docs.count()


def test_leaks_of_heavy_edits(spark, folder):
    items = [text(30) for _ in range(5)]
    every_fifth = [[w + "x" if j % 5 == 4 else w for j, w in enumerate(x)] for x in items]
    docs = [text(60) for _ in range(200)]
    for i in range(4):
        docs[i][20:20] = every_fifth[i]
    for i in range(50, 110):  # one edited copy in a third of the rows
        docs[i][20:20] = every_fifth[4]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.find(d, b, folder).collect()}
    assert set(got) == {*((i, i) for i in range(4)), *((i, 4) for i in range(50, 110))}
    assert all(0.6 < x < 0.75 for x in got.values())


def test_blocks_of_items_change_nothing(spark, folder, monkeypatch):
    items = [text(25) for _ in range(8)]
    d = spark.createDataFrame([(i, " ".join(text(20) + items[i] + text(20))) for i in range(8)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK", 400)
    assert {(r.doc_id, r.item_id) for r in leaks.find(d, b, folder).collect()} == {(i, i) for i in range(8)}


def test_toxicity(spark, odd_docs, no_docs):
    bad = ["Grumpf,", "snarlish.", "bleckword"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = text(60), i % 4 == 0
        if toxic:
            for _ in range(RNG.randint(1, 4)):
                words.insert(RNG.randint(0, 60), RNG.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame([*rows, (900, None), (901, "a grumpf"), (None, "snarlish")], "doc_id long, text string")
    held = [x for x in labels if x[0] % 5 == 0]
    lab = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade(d, model).collect()}
    assert np.mean([got[i].rejected == bool(t) for i, t in held]) > 0.97
    assert got[901].rejected and not got[900].rejected and got[None].rejected
    assert np.mean([got[i].severity for i, t in held if t]) > 1 > np.mean([got[i].severity for i, t in held if not t])
    assert toxicity.fit(d, lab.where("toxic = 0")) is None and toxicity.fit(no_docs, lab) is None
    plain = toxicity.grade(odd_docs, None)
    assert plain.count() == odd_docs.count() and plain.where("rejected").count() == 0
    assert toxicity.grade(odd_docs, model).count() == odd_docs.count() and toxicity.grade(no_docs, model).count() == 0


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(4)
    n, x = 600, rng.random((600, 3)) < 0.5
    grade = np.clip(x[:, 0].astype(int) + x[:, 1].astype(int), 0, 2)
    row, col = np.nonzero(x)
    w, t = toxicity.fit_ordinal(n, row, col, grade, 3, 3)
    assert w[0] > 1 and w[1] > 1 and abs(w[2]) < 1 and t[0] < t[1]
