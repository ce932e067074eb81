import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from paperloom.functions import crypto
from paperloom.operators import checks, compare, records
from paperloom.sources import archives, pdf, pdf_parts


def test_rc4_and_digests(spark):
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    df = spark.createDataFrame([("a", bytearray(b"Plaintext")), (None, None)], "s string, b binary")
    got = df.select(crypto.digest(F.col("s"), "sha3_256").alias("x"), crypto.digest(F.col("s"), "sha1").alias("y"), crypto.rc4_column(F.col("b"), b"Key").alias("z")).collect()
    assert got[0].x == hashlib.sha3_256(b"a").hexdigest() and got[0].y == hashlib.sha1(b"a").hexdigest() and bytes(got[0].z).hex() == "bbf316e8d940af0ad3"
    assert list(got[1]) == [None, None, None]


def locked(password: bytes) -> bytes:
    """A file whose content stream is encrypted under the standard handler, revision 3."""
    owner, ident, n = b"o" * 32, b"i" * 16, 16
    key = crypto.file_key(password, owner, -4, ident, 3, n)
    stream = crypto.rc4(crypto.object_key(key, 5, 0), b"BT /F1 12 Tf 72 700 Td (secret) Tj ET")
    user = crypto.user_entry(key, ident, 3) + bytes(16)
    parts = [
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n",
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R >> endobj\n5 0 obj << /Length %d >> stream\n" % len(stream), stream, b"\nendstream endobj\n",
        b"6 0 obj << /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >> endobj\n" % (owner.hex().encode(), user.hex().encode()),
        b"trailer << /Root 1 0 R /Encrypt 6 0 R /ID [<%s>] >>\n" % ident.hex().encode(),
    ]
    return b"".join(parts)


def test_encrypted_file(spark):
    f = pdf.File(locked(b""))
    assert [r["text"] for r in pdf.runs(f, f.pages()[0])] == ["secret"]
    f = pdf.File(locked(b"pass"), "pass")
    assert [r["text"] for r in pdf.runs(f, f.pages()[0])] == ["secret"]
    df = spark.createDataFrame([("x", bytearray(locked(b"other")))], "path string, content binary")
    assert pdf.files(df).first().error == "the password does not fit"


def test_zip(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.txt", "hello")
    df = spark.createDataFrame([("z", bytearray(buffer.getvalue())), ("bad", bytearray(b"no")), ("null", None)], "path string, content binary")
    assert [(r.path, r.name, r.size, bytes(r.content)) for r in archives.entries(df).collect()] == [("z", "a/b.txt", 5, b"hello")]
    files = spark.createDataFrame([("k", "b", bytearray(b"2")), ("k", "a", bytearray(b"1"))], "path string, name string, content binary")
    assert [(r.name, bytes(r.content)) for r in archives.entries(archives.pack(files, "path")).collect()] == [("a", b"1"), ("b", b"2")]


PARTS = b"""%PDF-1.5
1 0 obj << /Type /Catalog /Pages 2 0 R /StructTreeRoot << /K << /S /Document /K [<< /S /H1 /T (Head) >> << /S /P /ActualText (Body) /K 0 >>] >> >>
 /OCProperties << /OCGs [5 0 R 6 0 R] /D << /OFF [6 0 R] >> >> /Metadata 7 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] >> endobj
3 0 obj << /Type /Page /Contents 8 0 R >> endobj
4 0 obj << /Type /Page /Contents 9 0 R >> endobj
5 0 obj << /Name (On) >> endobj
6 0 obj << /Name (Off) >> endobj
7 0 obj << /Length 0 >> stream
<x:xmpmeta><rdf:Description xmp:CreatorTool="tool"><pdf:Producer>maker</pdf:Producer><dc:title><rdf:Alt><rdf:li xml:lang="x">Title</rdf:li></rdf:Alt></dc:title></rdf:Description></x:xmpmeta>
endstream endobj
8 0 obj << /Length 0 >> stream
q 0 g 1 0 0 rg Q
endstream endobj
9 0 obj << /Length 0 >> stream
q q 0.5 g Q
endstream endobj
trailer << /Root 1 0 R >>
"""


def test_structure_layers_metadata(spark):
    df = spark.createDataFrame([("d", bytearray(PARTS))], "path string, content binary")
    rows = lambda n: pdf_parts.part(df, n).collect()
    assert [(r.id, r.parent_id, r.level, r.type, r.title, r.actual) for r in rows("structure")] == [(1, None, 0, "Document", None, None), (2, 1, 1, "H1", "Head", None), (3, 1, 1, "P", None, "Body")]
    assert [(r.name, r.visible) for r in rows("layers")] == [("On", True), ("Off", False)]
    assert {(r.name, r.value) for r in rows("xmp")} == {("xmp:CreatorTool", "tool"), ("pdf:Producer", "maker"), ("dc:title", "Title")}
    assert [r.colour for r in rows("colours")] == ["rgb", "grayscale"]
    bad = {r.page_no for r in checks.unbalanced(pdf.content_ops(df)).collect()}
    assert bad == {2}
    assert checks.sanitized({"xmp": pdf_parts.part(df, "xmp"), "pages": pdf.pages(df)}, "xmp")["xmp"].count() == 0


def test_text_modes(spark):
    data = pdf.build([[(72, 600, 12, "below"), (72, 700, 12, "above")], []])
    runs = pdf.text_runs(spark.createDataFrame([("d", bytearray(data))], "path string, content binary"))
    assert pdf.raw_text(runs).first().text == "belowabove" and pdf.raw_text(runs, " ").first().text == "below above"
    pages = spark.createDataFrame([("d", 1, "a"), ("d", 2, ""), ("d", 3, "b"), ("d", 4, "")], "doc_id string, page_no int, text string")
    assert pdf.document_text(pages).first().text == "a\r\n\r\nb"


def test_words_and_records(spark):
    df = spark.createDataFrame([("a  b c", "a b d"), (None, "x")], "a string, b string")
    ops = lambda mode: [[(o.op, o.text) for o in r.d] for r in df.select(compare.side_by_side("a", "b", mode).alias("d")).collect()]
    assert ops("ignore") == [[("equal", "a b"), ("delete", "c"), ("insert", "d")], [("insert", "x")]]
    assert ops("normal")[0][0] == ("equal", "a") and "".join(t for o, t in ops("parse")[0] if o != "insert") == "a  b c"
    rows = spark.createDataFrame([(1, "n", "<v>"), (1, "m", None)], "id int, name string, value string")
    assert {(r.name, r.value) for r in records.from_xfdf(records.to_xfdf(rows, "id"), "id").collect()} == {("n", "<v>"), ("m", "")}
    j = spark.createDataFrame([(1, '{"a": 1}'), (2, "no")], "id int, t string")
    assert [(r.id, r.name, r.value, r.status) for r in records.json_status(j, "id", "t", ["a", "b"]).collect()] == [(1, "a", "1", "ok"), (1, "b", None, "missing"), (2, "a", None, "invalid"), (2, "b", None, "invalid")]
    f = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2")], "doc string, name string, value string")
    assert {(r.name, r.value) for r in records.edit(f, f.limit(0), ["b"], {"a": "x"}, {"x": "y"}).collect()} == {("x", "1"), ("y", "1")}
