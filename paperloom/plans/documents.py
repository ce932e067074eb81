"""Registered queries over page files with all that a file can hold: they are written from conversations and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import annotations, export, search
from paperloom.plans.catalogue import _P, _files, _pages, query, table
from paperloom.sources import pdf, pdf_parts, pdf_write
from paperloom.sources.pdf import Name, Ref, Stream


def rich_file(doc: int, texts: list[str]) -> bytes:
    """A file whose pages have text, an image, paths and an annotation, with outline, names, layers, labels, structure and fields."""
    o: dict[int, object] = {}

    def new(x) -> Ref:
        o[len(o) + 1] = x
        return Ref(len(o), 0)

    root, tree, font, image = new({}), new({}), new({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}), None
    image = new(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\0\x40\x80\xff"))
    pages, items, tags = [], [], []
    for i, text in enumerate(texts, 1):
        colour = b"1 0 0 rg" if i % 2 else b"0.5 g"
        body = b"q 100 0 0 50 72 600 cm /Im1 Do Q\n50 700 m 350 700 l S\n" + colour + b" 72 650 200 20 re f\nBT /F1 12 Tf 72 720 Td %s Tj ET" % pdf_write.syntax(f"page {i}")
        mark = new({"Type": Name("Annot"), "Subtype": Name("Text" if i % 2 else "Highlight"), "Rect": [10, 20, 110 + i, 60], "Contents": text[:20], "T": f"A{i}"})
        page = new({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": font}, "XObject": {"Im1": image}}, "Contents": new(Stream({}, body)), "Annots": [mark]})
        pages.append(page)
        items.append(new({"Title": f"T{i}", "Dest": [page, Name("Fit")]}))
        tags.append(new({"Type": Name("StructElem"), "S": Name("P"), "ActualText": text[:10], "Pg": page}))
    for a, b in zip(items[1:], items[2:]):
        o[a.number]["Next"] = b
    if len(items) > 1:
        o[items[0].number] |= {"First": items[1], "Last": items[-1]}
    whole = new({"Type": Name("StructElem"), "S": Name("Document"), "T": f"doc {doc}", "K": tags})
    layers = [new({"Type": Name("OCG"), "Name": n}) for n in ("Layer A", "Layer B")]
    note = new(Stream({"Type": Name("EmbeddedFile")}, texts[0].encode()))
    xmp = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description><dc:format>application/pdf</dc:format><xmp:CreatorTool>tool %d</xmp:CreatorTool></rdf:Description></rdf:RDF></x:xmpmeta>' % doc
    inner = new({"FT": Name("Tx"), "T": "inner", "V": f"value {doc}"})
    labels: list = [0, {"S": Name("r")}]
    if len(texts) > 2:
        labels += [2, {"S": Name("D"), "P": "A-", "St": 5}]
    o[tree.number] = {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)}
    o[root.number] = {
        "Type": Name("Catalog"), "Pages": tree, "Outlines": new({"First": items[0], "Last": items[0]}), "PageLabels": {"Nums": labels}, "Metadata": new(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, xmp)),
        "Names": {"Dests": {"Names": [y for i, p in enumerate(pages, 1) for y in (f"p{i}", [p, Name("Fit")])]}, "EmbeddedFiles": {"Names": ["note.txt", {"Type": Name("Filespec"), "Desc": "a note", "EF": {"F": note}}]}, "JavaScript": {"Names": ["js1", {"S": Name("JavaScript"), "JS": f"app.alert({doc})"}]}},
        "OCProperties": {"OCGs": layers, "D": {"OFF": [layers[1]]}}, "StructTreeRoot": {"Type": Name("StructTreeRoot"), "K": whole}, "AcroForm": {"Fields": [new({"FT": Name("Tx"), "T": "name", "V": f"doc {doc}"}), new({"T": "group", "Kids": [inner]})]},
    }
    return pdf_write.save(o, {"Root": root}, packed=bool(doc % 2))


def _rich(spark, d) -> DataFrame:
    """Rich files of all conversations; those of odd numbers have object streams."""
    rows = _pages(spark, d).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))), lambda r: r["t"]).alias("r"))

    def run(batches):
        for b in batches:
            made = [rich_file(n, t) for n, t in zip(b.column("doc").to_pylist(), b.column("r").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path long, content binary")


_D = "CAST(doc AS VARCHAR) AS doc_id"
_DOCS = f"(SELECT doc, count(*) AS n, max(CASE WHEN page_no = 1 THEN text END) AS first FROM {_P} GROUP BY doc)"


def _part(name: str):
    def read(spark, d):
        return pdf_parts.part(_rich(spark, d), name)

    return read


_ANNOTS = f"SELECT {_D}, page_no, 1 AS seq, CASE WHEN page_no % 2 = 1 THEN 'Text' ELSE 'Highlight' END AS type, substr(text, 1, 20) AS contents, 'A' || page_no AS author, CAST(NULL AS VARCHAR) AS uri, 10.0 AS llx, 20.0 AS lly, CAST(110 + page_no AS DOUBLE) AS urx, 60.0 AS ury FROM {_P}"


@query(_ANNOTS)
def pdf_annotations(spark, d):
    return _part("annotations")(spark, d)


@query(f"SELECT {_D}, page_no AS id, CAST(CASE WHEN page_no > 1 THEN 1 END AS INT) AS parent_id, 'T' || page_no AS title, CAST(page_no > 1 AS INT) AS level, page_no FROM {_P}")
def pdf_outlines(spark, d):
    return _part("outlines")(spark, d)


@query(f"SELECT {_D}, 'p' || page_no AS name, page_no FROM {_P}")
def pdf_destinations(spark, d):
    return _part("destinations")(spark, d)


@query(f"SELECT {_D}, 'note.txt' AS name, 'a note' AS description, sha256(first) AS sha256 FROM {_DOCS}")
def pdf_attachments(spark, d):
    return _part("attachments")(spark, d).select("doc_id", "name", "description", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT {_D}, 'js1' AS name, 'app.alert(' || doc || ')' AS code FROM {_DOCS}")
def pdf_scripts(spark, d):
    return _part("scripts")(spark, d)


@query(f"SELECT {_D}, name, visible FROM {_DOCS}, (VALUES ('Layer A', true), ('Layer B', false)) v(name, visible)")
def pdf_layers(spark, d):
    return _part("layers")(spark, d)


@query(f"SELECT {_D}, 1 AS id, CAST(NULL AS INT) AS parent_id, 0 AS level, 'Document' AS type, 'doc ' || doc AS title, CAST(NULL AS VARCHAR) AS alt, CAST(NULL AS VARCHAR) AS actual FROM {_DOCS} UNION ALL SELECT CAST(doc AS VARCHAR), CAST(page_no + 1 AS INT), 1, 1, 'P', NULL, NULL, substr(text, 1, 10) FROM {_P}")
def pdf_structure(spark, d):
    return _part("structure")(spark, d)


@query(f"SELECT {_D}, 'dc:format' AS name, 'application/pdf' AS value FROM {_DOCS} UNION ALL SELECT CAST(doc AS VARCHAR), 'xmp:CreatorTool', 'tool ' || doc FROM {_DOCS}")
def pdf_xmp(spark, d):
    return _part("xmp")(spark, d)


@query(f"SELECT CAST(doc AS VARCHAR) AS doc, 0 AS start, 'r' AS style, CAST(NULL AS VARCHAR) AS prefix, 1 AS first FROM {_DOCS} UNION ALL SELECT CAST(doc AS VARCHAR), 2, 'D', 'A-', 5 FROM {_DOCS} WHERE n > 2")
def pdf_label_ranges(spark, d):
    return _part("page_labels")(spark, d)


@query(f"SELECT {_D}, page_no, 'Im1' AS name, 2 AS width, 2 AS height, 100.0 AS a, 50.0 AS d, 72.0 AS e, 600.0 AS f, 1.44 AS dpi_x, 2.88 AS dpi_y FROM {_P}")
def pdf_images(spark, d):
    return _part("images")(spark, d).select("doc_id", "page_no", "name", "width", "height", "a", "d", "e", "f", F.round("dpi_x", 6).alias("dpi_x"), F.round("dpi_y", 6).alias("dpi_y"))


@query(f"SELECT {_D}, page_no, seq, paint, points, llx, lly, urx, ury FROM {_P}, (VALUES (1, 'stroke', 2, 50.0, 700.0, 350.0, 700.0), (2, 'fill', 4, 72.0, 650.0, 272.0, 670.0)) v(seq, paint, points, llx, lly, urx, ury)")
def pdf_paths(spark, d):
    return _part("paths")(spark, d)


@query(f"SELECT {_D}, page_no, CASE WHEN page_no % 2 = 1 THEN 'rgb' ELSE 'grayscale' END AS colour FROM {_P}")
def pdf_colours(spark, d):
    return _part("colours")(spark, d)


@query(f"SELECT {_D}, name, 'Tx' AS type, value || doc AS value FROM {_DOCS}, (VALUES ('name', 'doc '), ('group.inner', 'value ')) v(name, value)")
def pdf_form_fields(spark, d):
    return pdf.form_fields(_rich(spark, d))


@query(f"SELECT {_D}, relation, CAST(CASE relation WHEN 'form_fields' THEN 2 WHEN 'content_ops' THEN 15 * n ELSE n END AS BIGINT) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM {_DOCS}, (VALUES ('pages'), ('content_ops'), ('text_runs'), ('form_fields')) v(relation) UNION ALL SELECT 'broken', relation, 0, 'not a PDF file' FROM (VALUES ('pages'), ('content_ops'), ('text_runs'), ('form_fields')) v(relation)")
def pdf_status(spark, d):
    broken = spark.createDataFrame([("broken", bytearray(b"no header"))], "path string, content binary")
    every = _rich(spark, d).select(F.col("path").cast("string").alias("path"), "content").unionByName(broken)
    found = pdf.status(every).where("relation <> 'objects'")
    return found.withColumn("error", F.when(F.col("error").isNotNull(), "not a PDF file"))


# --- annotations out and in -------------------------------------------------------------------------

_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT {_D}, '<xfdf xmlns=\"http://ns.adobe.com/xfdf/\"><annots>' || string_agg('<' || k || ' page=\"' || (page_no - 1) || '\" rect=\"10.00,20.00,' || (110 + page_no) || '.00,60.00\" title=\"A' || page_no || '\"><contents>' || {_ESC.format('substr(text, 1, 20)')} || '</contents></' || k || '>', '' ORDER BY page_no) || '</annots></xfdf>' AS xfdf FROM (SELECT *, CASE WHEN page_no % 2 = 1 THEN 'text' ELSE 'highlight' END AS k FROM {_P}) GROUP BY doc")
def annotations_xfdf_out(spark, d):
    return annotations.to_xfdf(_part("annotations")(spark, d))


@query(f"SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INT) AS seq, type, contents, author, uri, llx, lly, urx, ury FROM ({_ANNOTS}) WHERE page_no <= 3 AND type = 'Text'")
def annotations_xfdf_in(spark, d):
    out = annotations.to_xfdf(_part("annotations")(spark, d), ["Text"], 1, 3)
    return annotations.from_xfdf(out)


@query(f"SELECT doc_id, page_no, type, CASE WHEN author = 'A1' THEN 'first' ELSE author END AS author, CASE WHEN page_no = 2 THEN 5.0 ELSE llx END AS llx, CASE WHEN page_no = 2 THEN 5.0 + urx - llx ELSE urx END AS urx FROM ({_ANNOTS}) WHERE NOT (type = 'Text' AND page_no > 2)")
def annotations_edited(spark, d):
    kept = annotations.deleted(_part("annotations")(spark, d), ["Text"], 3)
    moved = annotations.moved(kept, F.col("page_no") == 2, 5.0, 5.0)
    return pdf_parts.rename_author(moved, "A1", "first").select("doc_id", "page_no", "type", "author", "llx", "urx")


@query(f"SELECT {_D}, page_no, 'page ' || page_no AS text, 72.0 AS x, 720.0 AS y FROM {_P} UNION ALL SELECT CAST(doc AS VARCHAR), page_no, regexp_replace(substr(text, 1, 20), '[\\r\\n]+', ' ', 'g'), 10.0, 50.0 FROM {_P} WHERE page_no % 2 = 0")
def annotations_flattened(spark, d):
    files = _rich(spark, d)
    return annotations.flattened(pdf.text_runs(files), pdf_parts.part(files, "annotations"), ["Highlight"]).select("doc_id", "page_no", "text", "x", "y")


# --- sinks ------------------------------------------------------------------------------------------


@query(f"SELECT {_D}, '<TaggedDocument><Document title=\"doc ' || doc || '\">' || string_agg('<P>' || {_ESC.format('substr(text, 1, 10)')} || '</P>', '' ORDER BY page_no) || '</Document></TaggedDocument>' AS xml FROM {_P} GROUP BY doc")
def export_tagged_xml(spark, d):
    return export.tagged_xml(_part("structure")(spark, d))


@query(f"SELECT {_D}, '<ul><li><a href=\"#page1\">T1</a>' || coalesce(string_agg('<ul><li><a href=\"#page' || page_no || '\">T' || page_no || '</a></li></ul>', '' ORDER BY page_no) FILTER (page_no > 1), '') || '</li></ul>' AS html FROM {_P} GROUP BY doc")
def export_bookmarks_html(spark, d):
    return export.bookmarks_html(_part("outlines")(spark, d))


@query(f"SELECT {_D}, '<html><body>' || string_agg('<div class=\"page\" id=\"page' || page_no || '\"><p>page ' || page_no || '</p></div>', '' ORDER BY page_no) || '</body></html>' AS html FROM {_P} GROUP BY doc")
def export_html(spark, d):
    return export.convert(_rich(spark, d), "html")


@query(f"SELECT {_D}, page_no, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"612\" height=\"792\"><text x=\"72\" y=\"72\" font-size=\"12\">page ' || page_no || '</text></svg>' AS svg FROM {_P}")
def export_svg(spark, d):
    return export.convert(_rich(spark, d), "svg")


_LINES = f"(SELECT doc, page_no, i, s[i] AS l FROM (SELECT doc, page_no, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc, page_no, string_split(text, chr(10)) AS s FROM {_P})) WHERE s[i] <> '')"


@query(f"SELECT {_D}, page_no, l AS text, 72.0 AS x, 720.0 - 14.4 * (i - 1) AS y, 12.0 AS size FROM {_LINES}")
def svg_text(spark, d):
    made = export.convert(_files(spark, d), "svg")
    return export.svg_runs(made, ["doc_id", "page_no"]).where("text <> ''").select("doc_id", "page_no", "text", "x", F.round("y", 3).alias("y"), "size")


_TEXT = f"SELECT {_D}, page_no, string_agg(l, chr(13) || chr(10) ORDER BY i) AS text FROM {_LINES} GROUP BY doc, page_no"


@query(_TEXT)
def pdf_rewritten_text(spark, d):
    """Files with object and cross-reference streams."""
    return pdf.page_text(pdf.text_runs(pdf_write.rewritten(_files(spark, d), packed=True)))


@query(_TEXT)
def pdf_encrypted_text(spark, d):
    sealed = pdf_write.rewritten(_files(spark, d), encryption="aes-128", new_password="open", owner="own")
    return pdf.page_text(pdf.text_runs(sealed, password="open"))


@query(f"SELECT {_D}, CAST(NULL AS VARCHAR) AS right_password, 'the password does not fit' AS wrong_password FROM {_DOCS}")
def pdf_passwords(spark, d):
    sealed = pdf_write.rewritten(_files(spark, d), packed=True, encryption="rc4-128", new_password="open")
    right, wrong = (pdf.files(sealed, password=p).select("doc_id", F.col("error").alias(n)) for p, n in (("open", "right_password"), ("shut", "wrong_password")))
    return right.join(wrong, "doc_id")


@query(_TEXT)
def pdf_recovered_text(spark, d):
    """Files whose end with the cross-reference is lost."""
    cut = _files(spark, d).select("path", F.expr("substring(content, 1, length(content) - 120)").alias("content"))
    return pdf.page_text(pdf.text_runs(cut))


@query(f"SELECT {_D}, 2 AS revisions, 'New title' AS title, false AS recovered, CAST(n AS INT) AS n_pages FROM {_DOCS}")
def pdf_incremental(spark, d):
    later = pdf_write.with_info(_files(spark, d), {"Title": "New title"})
    return pdf.files(later).select("doc_id", "revisions", F.col("info")["Title"].alias("title"), "recovered", "n_pages")


def _no_images(f, objects) -> None:
    """Images become empty forms."""
    for n, x in objects.items():
        if isinstance(x, Stream) and x.info.get("Subtype") == "Image":
            objects[n] = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 0, 0]}, b"")


def _turned(f, objects) -> None:
    """Pages are turned and cropped."""
    for x in objects.values():
        if isinstance(x, dict) and x.get("Type") == "Page":
            x["Rotate"], x["MediaBox"] = 90, [10, 10, 310, 410]


@query(f"SELECT {_D}, page_no, 10.0 AS llx, 10.0 AS lly, 310.0 AS urx, 410.0 AS ury, 90 AS rotate FROM {_P}")
def pdf_pages_edited(spark, d):
    return pdf.pages(pdf_write.edited(_rich(spark, d), _turned))


@query(f"SELECT {_D}, CAST(0 AS BIGINT) AS images, CAST(n AS BIGINT) AS runs FROM {_DOCS}")
def pdf_images_deleted(spark, d):
    files = pdf_write.edited(_rich(spark, d), _no_images)
    runs = pdf.text_runs(files).groupBy("doc_id").agg(F.count("*").alias("runs"))
    images = pdf_parts.part(files, "images").groupBy("doc_id").agg(F.count("*").alias("n"))
    return runs.join(images, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("images"), "runs")


def _wide_text(doc: int, text: str) -> bytes:
    """One page of text in two-byte codes that a ToUnicode map turns into characters: each code is one more than its character."""
    more = sorted({ord(c) for c in text if not 32 <= ord(c) < 127})
    each = b" ".join(b"<%04X> <%04X>" % (c + 1, c) for c in more)
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0021> <007F> <0020> endbfrange %d beginbfchar %s endbfchar endcmap" % (len(more), each)
    shown = b"".join((ord(c) + 1).to_bytes(2, "big") for c in text)
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Wide"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(5, 0)}
    page = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(4, 0)}}, "Contents": Ref(6, 0)}
    body = b"BT /F1 12 Tf 72 720 Td <" + shown.hex().encode() + b"> Tj ET"
    return pdf_write.save({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: page, 4: font, 5: Stream({}, cmap), 6: Stream({}, body)}, {"Root": Ref(1, 0)}, packed=True)


@query(r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(regexp_replace(text, '[^\x{20}-\x{D7FF}]+', ' ', 'g'), 1, 200) AS text FROM documents WHERE length(text) > 0")
def pdf_unicode_text(spark, d):
    rows = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.substring(F.regexp_replace("text", r"[^\x{20}-\x{D7FF}]+", " "), 1, 200).alias("text"))

    def run(batches):
        for b in batches:
            made = [_wide_text(n, t) for n, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], names=["path", "content"])

    return pdf.text_runs(rows.mapInArrow(run, "path long, content binary")).select("doc_id", "text")


# --- search with boxes ------------------------------------------------------------------------------


@query(f"SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i, p0) AS INT) AS match_no, 'the' AS match, 72.0 + 6 * p0 AS llx, 720.0 - 14.4 * (i - 1) AS lly, 72.0 + 6 * (p0 + 3) AS urx, 732.0 - 14.4 * (i - 1) AS ury FROM (SELECT {_D}, page_no, i, unnest(list_filter(range(0, length(l)), lambda p: substr(l, CAST(p + 1 AS INT), 3) = 'the')) AS p0 FROM {_LINES})")
def search_placed(spark, d):
    found = search.placed(pdf.text_runs(_files(spark, d)), "the")
    return found.select("doc_id", "page_no", "match_no", "match", *[F.round(c, 3).alias(c) for c in ("llx", "lly", "urx", "ury")])


@query(f"SELECT {_D}, page_no, CAST(i AS INT) AS line_no, l AS text FROM {_LINES}")
def search_without_shadows(spark, d):
    runs = pdf.text_runs(_files(spark, d)).where("text <> ''")
    shadows = runs.withColumns({"x": F.col("x") + 1.0, "y": F.col("y") - 1.0, "seq": (F.col("seq") + 100_000).cast("int")})
    return search.without_shadows(runs.unionByName(shadows)).select("doc_id", "page_no", F.round((720.0 - F.col("y")) / 14.4 + 1).cast("int").alias("line_no"), "text")


@query(f"SELECT {_D}, page_no FROM {_P} WHERE page_no * 150 <= 612")
def search_on_page(spark, d):
    points = _pages(spark, d).select(F.col("doc").cast("string").alias("doc_id"), "page_no", (F.col("page_no") * 150.0).alias("x"), F.lit(300.0).alias("y"))
    return search.on_page(points, pdf.pages(_files(spark, d))).select("doc_id", "page_no")
