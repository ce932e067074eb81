"""The registered queries and the pipeline on small tables, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import gif, leaks, near, toxicity
from paperloom.llm.tokens import LETTERS, word_hashes
from tests.llm.test_near import brute_classes, edited, text

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_gif": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature frames",
    "op2_packed_ids": "doc_id start n_tokens ids_crc32",
    "op3_kneser_ney": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_url_rules": "page_id host path rule verdict mined_rule support",
    "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_toxicity": "doc_id severity rejected",
    "op7_near": "doc_id class_id class_size class_text",
    "op8_leaks": "doc_id item_id similarity",
    "op9_passages": "doc_id start_word end_word class_id",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans scores n_spans",
}


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name, documents):
    df = entry.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name in ("op4_url_rules", "op8_leaks", "op9_passages"):
        assert rows
    else:
        assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)


def test_ids_of_whole_table(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    two = {r.doc_id: r for r in entry.queries()["op2_packed_ids"](spark, SF).collect()}
    five = {r.doc_id: r for r in entry.queries()["op5_bpe"](spark, SF).collect()}
    at = 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        raw = np.array([*ids, 2], "<u4").tobytes()
        a, b = two[d["doc_id"]], five[d["doc_id"]]
        assert (a.start, a.n_tokens, a.ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw))
        assert (b.n_tokens, b.ids_sha256, b.decoded_sha256) == (len(ids), hashlib.sha256(raw[:-4]).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
        at += len(ids) + 1


@pytest.mark.parametrize("name", ["op3_kneser_ney", "op4_url_rules", "op7_near", "op10_pii"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = entry.queries()[name](spark, SF).select(*columns).collect()
    assert len(columns) == len(entry.queries()[name](spark, SF).columns)
    plain = lambda r: tuple(round(v, 4) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, rows), key=str) == sorted(map(plain, want.fetchall()), key=str)


def test_media_of_whole_table(spark, documents):
    got = {r.doc_id: r for r in entry.queries()["op1_gif"](spark, SF).collect()}
    for d in documents:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert [f.start_ms for f in r.frames] == [100 * i for i in range(len(r.frames))] and sum(f.height for f in r.frames) * 64 == len(p)
        assert r.media_sha256 == hashlib.sha256(gif.encode_grey(p)).hexdigest()


def test_leaks_equal_alignment_of_all_pairs(spark, documents):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    words = lambda t: word_hashes(pa.array([t or ""]))[0]
    docs = sorted(((d["doc_id"], words(d["text"])) for d in documents), key=lambda d: len(d[1]))
    want = {}
    for x in items:
        own = words(x["text"])
        for lo in range(0, len(docs), 16):
            score, _ = leaks.align(own, [w for _, w in docs[lo : lo + 16]]) if len(docs[lo + min(15, len(docs) - lo - 1)][1]) else (np.zeros(16), None)
            for (i, _), s in zip(docs[lo : lo + 16], score.tolist()):
                if s >= len(own):  # half of two for each word
                    want[i, x["item_id"]] = s / (2 * len(own))
    got = {(r.doc_id, r.item_id): r.similarity for r in entry.queries()["op8_leaks"](spark, SF).collect()}
    assert got == want and want


def test_passages_hold_all_runs_of_fifty_words(spark, documents):
    runs = {}
    for d in documents:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "").split()
        for j in range(len(w) - 49):
            runs.setdefault(hash(tuple(w[j : j + 50])), set()).add((d["doc_id"], j))
    found = {}
    for r in entry.queries()["op9_passages"](spark, SF).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.class_id))
    inside = lambda i, j: {c for a, b, c in found.get(i, []) if a <= j and j + 50 <= b}
    shared = [x for x in runs.values() if len({i for i, _ in x}) > 1]
    assert shared
    for x in shared:
        assert set.intersection(*(inside(i, j) for i, j in x)), x


def test_severity_equals_plain_sums(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in entry.queries()["op6_toxicity"](spark, SF).collect()}
    if model is None:
        assert all(r.severity == 0 for r in got.values())
        return
    weight = dict(zip(model.known.tolist(), model.weights.tolist()))
    for d in documents[:60]:
        words = {w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (d["text"] or "").encode())}
        hashes = {int(h) & ~1 for w in words for h in word_hashes(pa.array([w]).cast(pa.large_binary()), LETTERS, (4, 5))[0].ravel() if int(h) & ~1}
        s = sum(weight.get(h, 0.0) for h in hashes)
        upto = [1 / (1 + np.exp(s - t)) for t in model.thresholds]
        assert abs(got[d["doc_id"]].severity - sum(1 - p for p in upto)) < 1e-6


def tables(spark, folder):
    rng = random.Random(9)
    rows, labels, items = [], [], [text(30) for _ in range(4)]
    for i in range(260):
        words = text(60)
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, 60), rng.choice(["grumpf", "snarlish", "bleckword"]))
        rows.append(words)
        labels.append((i, int(i % 4 == 0)))
    for i in range(40):
        base = text(80)
        rows += [base, edited(base, 1), base + ["tail"]]
    for i in range(4):
        rows.append(text(30) + edited(items[i], i) + text(10))
    rows.append([*text(20), "mail", "me@example.org", "now"])
    docs = [(i, " ".join(r), "en", "s", len(" ".join(r))) for i, r in enumerate(rows)] + [(9000, None, None, None, None), (9001, "", "en", "s", 0)]
    save = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save(labels[:200], "doc_id long, toxic int", "labels")
    save([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string", "benchmark")
    return docs


def test_pipeline(spark, folder):
    docs = tables(spark, folder)
    bad = ("grumpf", "snarlish", "bleckword")
    clean = [d for d in docs if not any(w in (d[1] or "") for w in bad)]
    classes = brute_classes([(d[0], d[1] or "") for d in clean])
    leaked = {i for i, t, *_ in docs if 380 <= i < 384}
    want = {i for i, c in classes.items() if i == c} - leaked
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == want
    texts = {d[0]: d[1] or "" for d in docs}
    clear = {i: t.replace("me@example.org", "[EMAIL]") for i, t in texts.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(clear[i].encode()).hexdigest() for i, r in got.items())
    stage = corpus_pipeline.STAGES[3][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.n_chars for r in stage.collect()} == {i: len(t) for i, t in clear.items()}


def test_pipeline_drops_heavily_edited_passages(spark, folder):
    items = [text(30) for _ in range(4)]
    cut = [[w + "x" if j % 5 == 4 else w for j, w in enumerate(x)] for x in items]
    rows = [text(60) for _ in range(120)]
    for i in range(30):  # one edited passage in many different documents, and three in one each
        rows[i][15:15] = cut[0] if i >= 3 else cut[i + 1]
    docs = [(i, " ".join(r), "en", "s", len(" ".join(r))) for i, r in enumerate(rows)]
    save = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(i, 0) for i in range(100)], "doc_id long, toxic int", "labels")
    save([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string", "benchmark")
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(range(30, 120))


def test_pipeline_with_repeated_ids(spark, folder):
    a, b, c, leak = (" ".join(text(70)) for _ in range(4))
    item = " ".join(text(30))
    rows = [(3, b), (5, a), (5, b), (9, a), (9, c), (12, c + " tail"), (12, f"{leak} {item}"), (14, f"{leak[:50]} {item}"), (15, leak), (None, a), (16, None), (17, ""), (18, " ".join(text(70)))]
    save = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    more = ["toxic", "_id", "k", "t"]
    save([(i, t, "en", "s", len(t or ""), *more) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, toxic string, _id string, k string, t string", "documents")
    save([(18, 0)], "doc_id long, toxic int", "labels")
    save([(1, item)], "item_id long, text string", "benchmark")
    got = sorted(((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(3, sha(b)), (5, sha(a)), (9, sha(c)), (15, sha(leak)), (None, sha(a)), (16, sha("")), (18, sha(rows[-1][1]))], key=str)


def test_stages_take_empty_tables_and_more_columns(spark, folder):
    tables(spark, folder)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, pii string, n_tokens int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    more = spark.createDataFrame([(1, "plain text of a document", "en", "s", 24, True, "x", 3)], empty.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns and out.count() == 1, name


def test_named_constants():
    assert (near.WORDS, near.THRESHOLD) == (5, 0.8)
