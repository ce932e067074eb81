import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from paperloom.llm import bpe, packed_ids, shared
from paperloom.llm.tokens import shingles, word_hashes

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


PARTS = ["a", "b", " ", "  ", "\n", "\t", "\u2003", "\u3000", "é", "ß", "1", "²", "½", "'s", "'ll", "'", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "\u2028", "😀", "the", "ing", ".", ",", "-", "\x00", "\u0301", "中", "\r\n", "_"]


def texts(n=800):
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("make", [lambda: bpe.Encoder(bpe.vocabulary(VOCABULARY).ids), lambda: packed_ids.worker_encoder(VOCABULARY)])
def test_ids_equal_the_library(make):
    t, encode = library(), make()
    for x in texts():
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_memo_that_starts_anew_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    t, encode = library(), bpe.Encoder(bpe.vocabulary(VOCABULARY).ids)
    x = "The stones, the stones.\nThe river and the stones, again."
    assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_decode():
    v, t = bpe.vocabulary(VOCABULARY), library()
    for x in texts(200):
        ids = v.ids(x)
        assert v.decode(ids) == t.decode(ids, skip_special_tokens=False) == x


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs):
    t = library()
    rows = bpe.round_trip(odd_docs, VOCABULARY).collect()
    assert len(rows) == odd_docs.count() and bpe.round_trip(no_docs, VOCABULARY).count() == 0
    for r, d in zip(rows, odd_docs.collect()):
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.lang, r.n_tokens) == (d.doc_id, d.lang, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_encode_then_decode_column(odd_docs):
    back = bpe.decode_ids(bpe.encode_text(odd_docs, VOCABULARY), VOCABULARY).collect()
    assert [r.decoded for r in back] == [d.text or "" for d in odd_docs.collect()]


def test_pack_and_unpack():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, rng.choice([2, 300, 70_000, 2**32 - 1]), n).astype("<u4")
        control, data = packed_ids.pack(v)
        assert len(control) == (n + 3) // 4
        assert packed_ids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == v.tolist()


def test_files_of_ids(spark, odd_docs, no_docs, folder):
    t = library()
    files = packed_ids.write_ids(odd_docs, folder, VOCABULARY, end_id=2)
    got = sorted(packed_ids.read_ids(files).collect(), key=lambda r: r.start)
    docs = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, d in zip(got, docs, strict=True):
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.token_ids)) == (d.doc_id, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    path = files.first().path
    order = shared.array_at(shared.mapped(path), "<u4", 12, 20).tolist()
    counts = np.bincount(np.concatenate([np.frombuffer(bytes(r.token_ids), "<u4") for r in got]))
    assert order == packed_ids.ranking(np.flatnonzero(counts), counts[counts > 0])[:20].tolist()
    assert packed_ids.read_ids(packed_ids.write_ids(no_docs, f"{folder}2", VOCABULARY)).count() == 0


def test_word_hashes():
    xs = ["", "Ab  cd", None, "x" * 3_000_000 + " y", "ab", "z\tq\nAB", "ab", " ", "cd ab"]
    h, starts, ends, at = word_hashes(pa.array(xs))
    names, k = {}, 0
    for i, x in enumerate(xs):
        words = (x or "").lower().split()
        assert at[i + 1] - at[i] == len(words)
        for w in words:
            assert names.setdefault(w, h[k]) == h[k] and ends[k] - starts[k] == len(w)
            k += 1
    assert len(set(names.values())) == len(names)
    g, gat = shingles(h, at, 2)
    assert np.diff(gat).tolist() == [0, 1, 0, 1, 1, 2, 1, 0, 1]


def test_documents_of_one_id_are_spread(spark, folder):
    rows = [(7, f"text number {i} of one id") for i in range(400)] + [(3, "before"), (9, "after"), (7, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task
    try:
        files = packed_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), folder, VOCABULARY, end_id=2)
        assert files.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(packed_ids.read_ids(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    t = library()
    want = sorted((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in rows)
    assert sorted((r.doc_id, tuple(np.frombuffer(bytes(r.token_ids), "<u4").tolist())) for r in got) == want


def test_other_vocabulary_settings_are_refused(tmp_path):
    spec = json.load(open(VOCABULARY, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            bpe.settings(str(path))
    bpe.settings(VOCABULARY)
