"""Writing and reading page files: encryption, sections at the end, damage, object streams."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.functions import bidi, crypto
from paperloom.operators import annotations, compare, graphs, layout, pages, records
from paperloom.plans.documents import rich_file
from paperloom.sources import codecs, pdf, pdf_parts, pdf_write

TEXTS = ["first page, Grüße 中文 (a) \\ b", "second", "third"]


def shown(data, password=""):
    f = pdf.File(data, password)
    return [r["text"] for p in f.pages() for r in pdf.runs(f, p)]


def test_aes_is_that_of_its_definition():
    text = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        assert crypto.aes_blocks(key, text).tobytes().hex() == want
        assert crypto.aes_blocks(key, bytes.fromhex(want), decrypt=True).tobytes() == text
        data, start = bytes(range(256)) * 3, bytes(range(16))
        assert crypto.cbc_decrypt(key, crypto.cbc_encrypt(key, data, start), start) == data
        for n in (0, 1, 15, 16, 17):
            assert crypto.aes_open(key, crypto.aes_seal(key, data[:n], start)) == data[:n]


@pytest.mark.parametrize("kind", ["rc4-40", "rc4-128", "aes-128", "aes-256"])
@pytest.mark.parametrize("packed", [False, True])
def test_encrypted_files(kind, packed):
    plain = rich_file(4, TEXTS)
    sealed = pdf_write.rewrite(plain, packed=packed, lock=pdf_write.Lock(kind, "user", "owner"))
    assert b"page 1" not in sealed and b"A1" not in sealed
    assert shown(sealed, "user") == shown(plain) == ["page 1", "page 2", "page 3"]
    if kind == "aes-256":
        assert shown(sealed, "owner") == shown(plain)
    with pytest.raises(ValueError, match="password"):
        pdf.File(sealed, "wrong")
    assert [a[4] for a in pdf_parts._annotations("d", sealed, "user")] == [t[:20] for t in TEXTS]
    again = pdf_write.rewrite(sealed, "user")  # and without encryption
    assert shown(again) == shown(plain) and b"Encrypt" not in again


def test_sections_at_the_end():
    data = rich_file(2, TEXTS)
    f = pdf.File(data)
    at = next(n for n in f.numbers() if isinstance(x := f.get(pdf.Ref(n, 0)), dict) and x.get("Type") == "Page")
    later = pdf_write.append(data, {at: f.get(pdf.Ref(at, 0)) | {"Rotate": 180}})
    assert later.startswith(data) and pdf.File(later).revisions == 2
    assert [p.get("Rotate", 0) for p in pdf.File(later).pages()] == [180, 0, 0]
    assert pdf.File(later[: len(later) - 40]).pages()  # a lost end is found by a scan


def test_equal_pages_keep_their_numbers():
    Name, Ref = pdf.Name, pdf.Ref
    page = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 10, 10]}
    o = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Dests": {"a": [Ref(3, 0)], "b": [Ref(4, 0)]}}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0), Ref(4, 0)], "Count": 2}, 3: page, 4: dict(page)}
    assert list(pdf_parts._destinations("d", pdf_write.save(o, {"Root": Ref(1, 0)}))) == [("d", "a", 1), ("d", "b", 2)]


def test_status_tells_what_stopped_a_relation(spark):
    good = rich_file(1, TEXTS)
    cut = good[: len(good) // 2]
    df = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(cut)), ("no", bytearray(b"x")), ("none", None)], "path string, content binary")
    got = {(r.doc_id, r.relation): (r.n_rows, r.error) for r in pdf.status(df).collect()}
    assert got["good", "pages"] == (3, None) and got["no", "pages"][1] and got["none", "pages"][1]
    assert {d for d, _ in got} == {"good", "cut", "no", "none"}


def test_large_streams_are_refused():
    import zlib

    with pytest.raises(ValueError, match="larger"):
        codecs.flate(zlib.compress(bytes(10_000)), 1000)
    assert codecs.prefix(zlib.compress(bytes(10_000)), 1000) == bytes(1000)


@pytest.mark.parametrize("name", ["FlateDecode", "LZWDecode", "ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode"])
def test_codecs_round_trip(name):
    for data in (b"", b"a", b"abcabcabc" * 3000, bytes(range(256)) * 40, hashlib.shake_256(b"x").digest(70_000)):
        assert codecs.decode(codecs.encode(data, name), [name]) == data


def test_images():
    import struct

    rgb = bytes(range(27))
    assert codecs.pixels(codecs.png(3, 3, 3, rgb)) == (3, 3, 3, rgb)
    rows = [b"\1\2\3\4\5\6" + b"\0\0", b"\7\x08\x09\x0a\x0b\x0c" + b"\0\0"]
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 16, 0, 54, 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + b"".join(rows)
    assert codecs.pixels(bmp) == (2, 2, 3, bytes([9, 8, 7, 12, 11, 10, 3, 2, 1, 6, 5, 4]))
    with pytest.raises(ValueError):
        codecs.pixels(b"GIF89a")


def test_right_to_left_text():
    word = "שלום"
    assert bidi.reorder(word[::-1]) == word and bidi.reorder("plain") == "plain" and bidi.reorder(None) is None
    assert bidi.reorder(f"abc {word} def") == f"abc {word[::-1]} def"
    assert bidi.reorder(f"{word[::-1]} 123") == f"123 {word}"
    assert bidi.reorder("سلام 123", 1) == "123 مالس"
    assert bidi.levels("a1", 0) == [0, 0] and bidi.levels("א1", 1) == [1, 2]
    mark = "ש" + "ׁ" + "ל"
    assert unicodedata.bidirectional(mark[1]) == "NSM" and bidi.levels(mark) == [1, 1, 1]
    for t in (f"abc {word} def", f"{word} abc 12", f"({word})"):
        assert bidi.reorder(bidi.reorder(t, 0), 0) == t


def test_levels_and_flow_tables():
    blocks = [(50, 100, 90, 120), (10, 101, 40, 130), (10, 50, 90, 90)]
    assert [b[0] for b in layout._level(sorted(blocks, key=lambda b: -b[1]))] == [10, 50, 10]
    assert layout.lattices([(0, 0, 595, 842), (50, 99, 60, 100), (50, 10, 60, 11), (50, 10, 51, 100), (59, 10, 60, 100)], 595, 842) == [([50.5, 59.5], [99.5, 10.5])]


def test_arithmetic_refuses_what_is_no_expression():
    for bad in ("1 +", "(1", "1 2", "x", "1 $ 2", ")"):
        with pytest.raises(ValueError):
            records.arithmetic(bad, {})
    with pytest.raises(ValueError):
        records.xfa_value(F.lit(""), "a[x]")
    with pytest.raises(ValueError):
        records.bind_xml(None, "k", "xml", "a b", {})


def test_pages_keep_columns_of_the_user(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y")], "doc int, page_no int, text string, _mine string")
    assert pages.extract_range(df, 2, 2).first()._mine == "y"
    assert pages.attempt(pages.delete, df, [5]) == (False, None) and pages.attempt(pages.split_bulks, df, []) == (False, None)
    ok, out = pages.attempt(pages.delete, df, [1])
    assert ok and out.count() == 1


def test_deep_graphs(spark):
    n = 150
    nodes = spark.range(n + 5).withColumnRenamed("id", "id")
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graphs.reachable(nodes, edges, spark.range(1), depth=20)
    assert found.count() == 21
    chain = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 4)], "id int, up int")
    links = chain.where("up IS NOT NULL").select(F.col("up").alias("src"), F.col("id").alias("dst"))
    assert {(r.id, r.level) for r in graphs.reachable(chain.select("id"), links, chain.where("up IS NULL").select("id")).collect()} == {(i, i) for i in range(4)}


def test_annotation_values(spark):
    rows = spark.createDataFrame([("d", 1, 1, "FreeText", 'a <b> & "c"', None, "http://x/?a=1&b=2", 1.0, 2.0, 3.0, 4.0)], "doc_id string, page_no int, seq int, type string, contents string, author string, uri string, llx double, lly double, urx double, ury double")
    assert annotations.from_xfdf(annotations.to_xfdf(rows)).collect() == rows.collect()
    assert annotations.from_xfdf(annotations.to_xfdf(rows), ["Text"]).count() == 0
    assert annotations.stamps(rows).count() == 0


def test_diff_of_empty_and_long_texts():
    assert compare.diff_text("", "") == [] and compare.diff_text(None, "a") == [("insert", "a")]
    a = "the quick brown fox " * 50
    ops = compare.diff_text(a, a.replace("quick", "slow"))
    assert "".join(t for o, t in ops if o != "insert") == a and "".join(t for o, t in ops if o != "delete") == a.replace("quick", "slow")
