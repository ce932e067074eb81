import time

from paperloom.operators import layout
from paperloom.sources import markdown, pdf, pdf_parts
from paperloom.streaming import files as streams

RULES = [(50, y, 350, y + 0.5) for y in (700, 670, 640)] + [(x, 640, x + 0.5, 700) for x in (50, 200, 350)]


def test_lattice():
    assert [(round(x) for x in xs) and (len(xs), len(ys)) for xs, ys in layout.lattices(RULES, 612, 792)] == [(3, 3)]
    assert layout.lattices([(0, 0, 612, 792)], 612, 792) == []  # a frame
    assert layout.lattices([(100, 100, 200, 150)], 612, 792)[0] == ([100, 200], [150, 100])  # one cell counts
    assert layout.boundaries([1, 5, 9, 30]) == [5, 30]
    assert layout._merged([(10, 0, 5), (10.3, 6, 9), (10, 20, 30)]) == [(10, 0, 9), (10, 20, 30)]


def test_table_cells(spark):
    texts = [("Header1", 60, 680), ("Header2", 210, 680), ("Cell1", 60, 650), ("Cell2", 210, 650), ("outside", 400, 650)]
    runs = spark.createDataFrame([("d", 1, i, t, float(x), float(y), 40.0, "F", 10.0) for i, (t, x, y) in enumerate(texts)], pdf._RUNS)
    boxes = spark.createDataFrame([("d", 1, *map(float, b)) for b in RULES], "doc_id string, page_no int, llx double, lly double, urx double, ury double")
    got = {(r.table_no, r.row_no, r.col_no): r.text for r in layout.table_cells(runs, boxes).collect()}
    assert got == {(1, 1, 1): "Header1", (1, 1, 2): "Header2", (1, 2, 1): "Cell1", (1, 2, 2): "Cell2"}


def test_paragraphs(spark):
    lines = ["The first paragraph runs over", "two lines of even length here.", "Short one.", "Another begins after it and is", "also two lines of much text."]
    runs = spark.createDataFrame([("d", 1, i, t, 72.0, 700.0 - 14 * i, 6.0 * len(t), "F", 12.0) for i, t in enumerate(lines)], pdf._RUNS)
    got = [r.text for r in layout.page_paragraphs(runs).orderBy("para_no").collect()]
    assert got == [" ".join(lines[:3]) if len(got) == 2 else " ".join(lines[:2]), *got[1:]] and got[-1] == " ".join(lines[3:])
    a, b, c = (0, 100, 50, 120), (60, 100, 90, 120), (0, 50, 90, 80)
    assert layout.reading_order([c, b, a]) == [a, b, c]


MARKDOWN = "# One *two*\n\nText [link](u) and `code`\nmore\n- a\n  - b\n\n> said\n---\n```py\nx = 1\n\ny\n```\nend"


def test_markdown(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, None)], "id int, text string")
    got = [(r.kind, r.level, r.text) for r in markdown.blocks(df, "id").orderBy("id", "block_no").collect()]
    assert got == [("heading", 1, "One *two*"), ("paragraph", 0, "Text [link](u) and `code`\nmore"), ("item", 1, "a"), ("item", 2, "b"), ("quote", 0, "said"), ("rule", 0, ""), ("code", 0, "x = 1\n\ny\n"), ("paragraph", 0, "end")]
    assert df.select(markdown.plain(df.text).alias("p")).first().p.startswith("# One two\n\nText link and code")


PARTS = rb"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 5 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 5 >>] >>
 /Names << /Dests << /Names [(here) [4 0 R /Fit]] >> /EmbeddedFiles << /Names [(a.txt) << /Desc (note) /EF << /F 9 0 R >> >>] >> /JavaScript << /Names [(s) << /JS (run\(\)) >>] >> >> >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 100 200] >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Annots [<< /Subtype /Link /Rect [1 2 3 4] /A << /URI (http://x) >> >> << /Subtype /Text /T (Ann) /Contents (hi) >>] /Resources << /XObject << /I 8 0 R >> >> /Contents 7 0 R >> endobj
4 0 obj << /Type /Page /Parent 2 0 R /Rotate 90 >> endobj
5 0 obj << /First 6 0 R >> endobj
6 0 obj << /Title (Top) /Dest [3 0 R /Fit] /First 10 0 R >> endobj
10 0 obj << /Title (Below) /A << /D [4 0 R /Fit] >> >> endobj
7 0 obj << /Length 63 >> stream
q 72 0 0 144 5 6 cm /I Do Q 10 10 m 20 30 l S 1 2 3 4 re f
endstream endobj
8 0 obj << /Subtype /Image /Width 100 /Height 100 /Length 1 >> stream
x
endstream endobj
9 0 obj << /Length 5 >> stream
hello
endstream endobj
11 0 obj << /ByteRange [0 10 20 30] /Contents <00> /Name (N) >> endobj
trailer << /Root 1 0 R >>
"""


def test_parts(spark):
    df = spark.createDataFrame([("d", bytearray(PARTS)), ("bad", bytearray(b"zzz"))], "path string, content binary")
    rows = lambda n: pdf_parts.part(df, n).collect()
    a = rows("annotations")
    assert [(r.page_no, r.type, r.uri, r.author, r.llx) for r in a] == [(1, "Link", "http://x", None, 1.0), (1, "Text", None, "Ann", 0.0)]
    assert pdf_parts.by_type(pdf_parts.part(df, "annotations"), ["Text"], 1, 1).count() == 1
    assert pdf_parts.rename_author(pdf_parts.part(df, "annotations"), "Ann", "Bo").where("author = 'Bo'").count() == 1
    assert [(r.title, r.level, r.page_no) for r in rows("outlines")] == [("Top", 0, 1), ("Below", 1, 2)]
    assert [(r.name, r.page_no) for r in rows("destinations")] == [("here", 2)]
    assert [(r.name, r.description, bytes(r.content)) for r in rows("attachments")] == [("a.txt", "note", b"hello")]
    assert [(r.name, r.code) for r in rows("scripts")] == [("s", "run()")]
    i = rows("images")[0]
    assert (i.width, round(i.dpi_x), round(i.dpi_y), i.e) == (100, 100, 50, 5.0)
    assert [(r.paint, r.llx, r.ury) for r in rows("paths")] == [("stroke", 10.0, 30.0), ("fill", 1.0, 6.0)]
    assert [(r.start, r.style, r.prefix, r.first) for r in rows("page_labels")] == [(0, "r", None, 1), (1, "D", "A-", 5)]
    assert [(r.end, r.covers_file) for r in rows("signatures")] == [(50, False)]
    assert [(r.page_no, r.rotate, r.ury) for r in pdf.pages(df).collect()] == [(1, 0, 200.0), (2, 90, 200.0)]


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(pdf.build([[(72, 700, 12, "first")]]))
    (source / "b.txt").write_bytes(b"no page file")
    for name, text in ((None, None), ("c.pdf", "second")):
        if name:
            time.sleep(1.1)
            (source / name).write_bytes(pdf.build([[(72, 700, 12, text)]]))
        streams.extract_to(streams.read(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["first", "second"]
    assert pdf.read(spark, str(source)).count() == 2
