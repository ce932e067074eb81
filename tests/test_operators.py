import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import calculator, geometry, numbering, strings
from paperloom.operators import checks, compare, edits, graphs, pages, records, search
from paperloom.sources import codecs, html, pdf


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_phrases(spark):
    texts = ["Hello World", "hello  world", "Hello\u00a0World", "HelloWorld", "a\nHello\nWorld", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = lambda p: {r.doc_id for r in search.hits(df, p).collect()}
    assert ids(search.pattern("hello world", case_sensitive=False)) == {0, 2}
    assert ids(search.pattern("hello world")) == set()
    assert ids(search.pattern("hello  world")) == {1}
    assert {0, 4} <= ids(search.pattern("Hello \n World"))
    assert ids(search.pattern("World", whole_word=True)) == {0, 2, 4}
    assert ids(search.pattern("(", regex=True)) == set()  # does not parse
    assert [(r.start, r.end) for r in search.fragments(df.where("doc_id = 0"), "o").collect()] == [(4, 5), (7, 8)]


def test_across_pages(spark):
    df = spark.createDataFrame([(1, 2, "b end"), (1, 1, "start a"), (1, 3, None)], "doc long, page_no int, text string")
    r = search.across_pages(df, r"a\s+b").collect()
    assert [(x.first_page, x.last_page) for x in r] == [(1, 2)]


def test_edits(spark):
    t = F.lit("ab ab \\ ab")
    r = one(spark, edits.replace_text(t, "ab", "X").alias("all"), edits.replace_text(t, "ab", "X", True, True).alias("first"), edits.replace_text(t, "ab", "X", True).alias("page"), edits.redact_phrase(t, "ab").alias("red"))
    assert (r["all"], r["first"], r["page"], r["red"]) == ("X X \\ X", "X ab \\ ab", "X X \\ X", "██ ██ \\ ██")
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.page_no, r.text) for r in edits.paginate(df, 24, 10).collect()] == [(1, 1, "a\nb"), (1, 2, "c"), (2, 1, "")]
    assert [r.line for r in edits.wrap(df.where("doc_id = 1"), 1).collect()] == ["a", "b", "c"]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([(d, p, f"{d}-{p}") for d, n in ((1, 5), (2, 1)) for p in range(1, n + 1)], "doc long, page_no int, text string")


def texts(df, doc=1):
    return [r.text for r in df.where(F.col("doc") == doc).orderBy("page_no").collect()]


def test_page_algebra(spark, book):
    assert texts(pages.extract_range(book, -3, 2)) == ["1-1", "1-2"]
    assert texts(pages.extract_range(book, 4, 99)) == ["1-4", "1-5"]
    assert texts(pages.extract_set(book, [5, 2, 2, 77])) == ["1-2", "1-5"]
    assert texts(pages.insert_after(book, 99, book.where("page_no = 1")), 2) == ["2-1", "2-1"]
    assert texts(pages.insert_after(book, 0, book.where("page_no = 2")))[:2] == ["1-2", "1-1"]
    assert texts(pages.delete(book, [1, 1])) == ["1-2", "1-3", "1-4", "1-5"]
    with pytest.raises(Exception, match="out of range"):
        pages.delete(book, [2]).collect()
    assert texts(pages.delete(book, [2], strict=False), 2) == ["2-1"]
    assert texts(pages.split_to_end(book, 4)) == ["1-4", "1-5"]
    for bad in ([], [(3, 2)], [(1,)]):
        with pytest.raises(ValueError):
            pages.split_bulks(book, bad)
    with pytest.raises(ValueError):
        pages.n_up(book, 0, 2)
    b = {(r.sheet, r.side, r.position): r.page_no for r in pages.booklet(book).where("doc = 1").collect()}
    assert [b[k] for k in ((0, "front", 1), (0, "front", 2), (0, "back", 1), (0, "back", 2), (1, "front", 1), (1, "back", 2))] == [None, 1, 2, None, None, 5]
    assert pages.with_errors([("a", book), ("b", None)], skip=True)[1] == ["b"]
    with pytest.raises(ValueError):
        pages.with_errors([("a", book), ("b", None)])
    boxed = book.withColumns({"llx": F.lit(0.0), "lly": F.lit(0.0), "urx": F.lit(10.0), "ury": F.lit(30.0)})
    assert [r.top for r in pages.page_breaks(boxed, [10, 20]).where("doc = 2").orderBy("page_no").collect()] == [0, 10, 20]
    assert pages.rotate(book.withColumn("rotate", F.lit(270)), 180).first().rotate == 90


def test_numbers(spark):
    r = one(spark, *[numbering.roman(F.lit(n)).alias(f"r{n}") for n in (0, 4, 1994, 3999, 4000)], *[numbering.alpha(F.lit(n)).alias(f"a{n}") for n in (1, 26, 27, 52, 702, 703, 18278)])
    assert list(r) == ["0", "IV", "MCMXCIV", "MMMCMXCIX", "4000", "A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]
    r = one(spark, numbering.bates(F.lit(7), "P", "S", 1).alias("b"), numbering.number(F.lit(-1234.5), 2, 2).alias("n"), numbering.number(F.lit(1234.5), 2, 3, "$").alias("m"), numbering.percent(F.lit(0.25), 0).alias("p"))
    assert list(r) == ["P007S", "-1.234,50", "$1234,50", "25%"]


def test_calculator(spark):
    run = lambda p, *x: [c.alias(f"c{i}") for i, c in enumerate(calculator.program(p, *x))]
    x = F.lit(-2.5)
    assert list(one(spark, *run("{ round }", x))) == [-2.0]
    assert list(one(spark, *run("{ 0 div }", x))) == [float("-inf")]
    assert list(one(spark, *run("{ 1 2 3 3 1 roll }"))) == [3, 1, 2]
    assert list(one(spark, *run("{ 1 2 3 2 copy }"))) == [1, 2, 3, 2, 3]
    assert list(one(spark, *run("{ 7 8 9 1 index }"))) == [7, 8, 9, 8]
    assert list(one(spark, *run("{ -7 2 idiv }"))) == [-3]
    assert list(one(spark, *run("{ -1 -1 atan }"))) == [-135]
    assert list(one(spark, *run("{ 1 3 bitshift 16 -2 bitshift }"))) == [8, 4]
    assert list(one(spark, *run("{ dup 0 lt { neg } if }", x))) == [2.5]
    grid = calculator.sampled([F.lit(0.5), F.lit(0.25)], [0, 1, 2, 3], [2, 2])[0]
    assert one(spark, grid.alias("g")).g == pytest.approx(1.0)
    m = geometry.multiply(geometry.rotation(30), (2, 0, 0, 2, 5, 6))
    px, py = geometry.apply(geometry.multiply(m, geometry.inverse(m)), 3, 4)
    assert list(one(spark, px.alias("x"), py.alias("y"))) == pytest.approx([3, 4])


def test_strings(spark):
    s = F.lit("abcabc")
    r = one(spark, strings.index_of(s, "c").alias("a"), strings.last_index_of(s, "c").alias("b"), strings.substring(s, 4, 1).alias("c"), strings.substr(s, -2).alias("d"), strings.replace(s, "b", "$1").alias("e"), strings.replace(s, "b", "x", True).alias("f"), strings.last_index_of(s, "z").alias("g"), strings.slice_(strings.split(F.lit("a.b.c"), "."), -2).alias("h"), strings.decode_entities(F.lit("&amp;lt; &lt;")).alias("i"))
    assert list(r) == [2, 5, "bca", "bc", "a$1cabc", "axcaxc", -1, ["b", "c"], "&lt; <"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, i=i, x=x, r=row: min(left + 1, r[j] + 1, r[j - 1] if x == b[j - 1] else left + 1), initial=i))
    return row[-1]


def test_diff():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 14)))
        ops = compare.diff_text(a, b)
        assert "".join(t for o, t in ops if o != compare.INSERT) == a
        assert "".join(t for o, t in ops if o != compare.DELETE) == b
        assert all(t for _, t in ops) and all(x[0] != y[0] for x, y in itertools.pairwise(ops))
        solved = list(compare._solve(a, b))
        if a not in b and b not in a:
            assert sum(len(t) for o, t in solved if o != compare.EQUAL) >= edit_distance(a, b)
    assert compare.diff_text("the cat", "the hat") == [("equal", "the "), ("delete", "c"), ("insert", "h"), ("equal", "at")]
    assert compare.diff_text(None, None) == [] and compare.diff_text(None, "x") == [("insert", "x")]


def test_diff_columns(spark):
    df = spark.createDataFrame([(1, 1, "a cat", "a bat"), (1, 2, None, "new")], "doc int, page_no int, a string, b string")
    ops = df.select("doc", "page_no", compare.diff("a", "b").alias("ops"))
    stats = compare.summed(ops.select("doc", "page_no", *compare.statistics(F.col("ops")))).where("page_no IS NULL").first()
    assert (stats.total_chars, stats.deleted_chars, stats.inserted_chars, stats.deletions, stats.insertions) == (5, 1, 4, 1, 2)
    r = ops.select(compare.markdown(F.col("ops")).alias("m"), compare.html(F.col("ops")).alias("h")).first()
    assert r.m == "a ~~c~~**b**at" and "<del>c</del><ins>b</ins>" in r.h


def test_records(spark):
    df = spark.createDataFrame([(1, "Name", "Jo(h)n \\"), (1, "City", None)], "id int, name string, value string")
    back = records.from_fdf(records.to_fdf(df, "id"), "id")
    assert {(r.name, r.value) for r in back.collect()} == {("Name", "Jo(h)n \\"), ("City", "")}
    wide = spark.createDataFrame([(1, "<a&b>", None)], "id int, x string, y string")
    assert {(r.name, r.value) for r in records.from_xml(records.to_xml(wide, "id", ["x", "y"]), "id").collect()} == {("x", "<a&b>"), ("y", "")}
    form = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2")], "doc string, name string, value string")
    new = spark.createDataFrame([("d", "a", "9"), ("d", "zz", "0")], "doc string, name string, value string")
    assert {(r.name, r.value, r.filled) for r in records.fill(form, new).collect()} == {("a", "9", True), ("b", "2", False)}
    v = spark.createDataFrame([("k", 1.0), ("k", None), ("m", 3.0), ("m", 4.0)], "k string, v double")
    got = {r.k: r for r in records.calculate(v, ["k"], "v").collect()}
    assert got["k"].sum is None and (got["m"].sum, got["m"].prd) == (7.0, 12.0)


def test_graphs_and_checks(spark):
    objects = spark.createDataFrame([(1, "m", []), (2, "m", []), (3, "i", [1]), (4, "i", [2]), (5, "z", [4])], "id int, content string, refs array<int>")
    kept = graphs.link_duplicates(objects)
    assert {(r.id, tuple(r.refs)) for r in kept.collect()} == {(1, ()), (3, (1,)), (5, (3,))}
    marks = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "doc string, page_no int, hard boolean")
    images = spark.createDataFrame([("d", 2, "a", 0.2), ("d", 2, "a", 0.2), ("d", 3, "b", 0.9)], "doc string, page_no int, image string, coverage double")
    assert {r.page_no: r.blank for r in checks.blank_pages(marks, images, 0.3).collect()} == {1: False, 2: True, 3: False}
    sig = spark.createDataFrame([("a", True, 0, 10), ("b", True, 0, 8), ("c", False, 0, 10)], "doc string, valid boolean, start int, end int")
    size = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "doc string, size int")
    assert {r.doc: r.compromised for r in checks.sound(sig, size).collect()} == {"a": False, "b": True, "c": True}
    page = "<title>T</title><p>One<script>x</script> two<!-- c --><p>Three &amp; four"
    assert one(spark, html.text(F.lit(page)).alias("t"), html.title(F.lit(page)).alias("n")) == ("T\nOne two\nThree & four", "T")


def test_codecs():
    rng = random.Random(7)
    for n in (0, 1, 300, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert codecs.decode(zlib.compress(data), ["Fl"]) == data
        assert codecs.ascii_hex(data.hex().encode() + b">") == data
    import base64

    assert codecs.decode(base64.a85encode(zlib.compress(b"deep" * 50)) + b"~>", ["ASCII85Decode", "FlateDecode"]) == b"deep" * 50
    assert codecs.run_length(bytes([2, 65, 66, 67, 254, 90, 128, 9])) == b"ABCZZZ"
    assert codecs.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert codecs.decode(b"same", ["Unknown"]) == b"same" and codecs.prefix(zlib.compress(b"abcdef"), 3) == b"abc"
    rows = bytes([2, 1, 2, 3, 1, 1, 1, 1])  # up, then sub
    assert codecs.predict(rows, 15, columns=3) == bytes([1, 2, 3, 1, 2, 3])
    assert codecs.image_size(b"\x89PNG\r\n\x1a\n" + bytes(8) + (5).to_bytes(4, "big") + (6).to_bytes(4, "big") + b"\x08\x02") == ("png", 5, 6, 8)


def test_page_files(spark):
    data = pdf.build([[(72, 700, 12, "Hello (World)")], [(72, 700, 12, "b"), (300, 700.5, 12, "c"), (72, 650, 12, "d")]], info={"Title": "T"}, fields={"Name": "John"})
    damaged = data.replace(b"startxref", b"startxxxx")
    df = spark.createDataFrame([("ok", bytearray(data)), ("bad", bytearray(damaged)), ("no", bytearray(b"text")), ("null", None)], "path string, content binary")
    got = {r.doc_id: r for r in pdf.files(df).collect()}
    assert (got["ok"].n_pages, got["ok"].version, got["ok"].recovered, got["ok"].info) == (2, "1.7", False, {"Title": "T"})
    assert got["bad"].n_pages == 2 and got["bad"].recovered and got["no"].error and got["null"].error
    text = {(r.doc_id, r.page_no): r.text for r in pdf.page_text(pdf.text_runs(df)).collect()}
    assert text == {(d, p): t for d in ("ok", "bad") for p, t in ((1, "Hello (World)"), (2, "b c\r\nd"))}
    assert {(r.doc_id, r.name, r.value) for r in pdf.form_fields(df).collect()} == {("ok", "Name", "John"), ("bad", "Name", "John")}
    assert pdf.pages(df).count() == 4 and pdf.objects(df).where("kind = 'stream'").count() == 4


def test_lexer_and_maps():
    assert pdf.Lexer(b"<< /A#20B [1 -2.5 (x\\(y\\)\\101) <4142> 3 0 R true null] /C /D >>").object() == {"A B": [1, -2.5, b"x(y)A", b"AB", pdf.Ref(3, 0), True, None], "C": "D"}
    ops = pdf.operators(b"q 1 0 0 1 0 0 cm BI /W 1 /H 1 ID \x00\x01 EI Q [(a) -300 (b)] TJ")
    assert [o for o, _ in ops] == ["q", "cm", "BI", "Q", "TJ"] and ops[2][1][0] == {"W": 1, "H": 1}
    m, width = pdf._cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0003> <0061> <0004> <0005> [<0078> <0079>] endbfrange")
    assert (m, width) == ({1: "A", 2: "a", 3: "b", 4: "x", 5: "y"}, 2)
    assert [pdf.glyph(n) for n in ("a", "space", "uni00E9", "nothing")] == ["a", " ", "é", ""]
