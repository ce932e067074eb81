"""Registered queries over generated grids, fields, marks and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import bidi, calculator, surface
from paperloom.operators import checks, compare, edits, graphs, layout, pages, records
from paperloom.plans.catalogue import _P, _pages, query, table
from paperloom.sources import archives, codecs, hocr, pdf
from paperloom.streaming import files as streams

_D = "CAST(doc AS VARCHAR) AS doc_id"


def _doc(spark, d) -> DataFrame:
    return _pages(spark, d).select(F.col("doc").cast("string").alias("doc_id"), "page_no")


def _runs(rows: DataFrame, *placed: tuple) -> DataFrame:
    """Text runs (text, x, y, w, size) on each page."""
    each = F.array(*[F.struct(F.lit(i).alias("seq"), t.alias("text"), *[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "w"), at)], F.lit("Helvetica").alias("font"), F.lit(float(size)).alias("size")) for i, (t, *at, size) in enumerate(placed, 1)])
    return rows.select("doc_id", "page_no", F.explode(each).alias("r")).select("doc_id", "page_no", "r.*")


def _boxes(rows: DataFrame, *boxes: tuple) -> DataFrame:
    each = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("llx", "lly", "urx", "ury"), b)]) for b in boxes])
    return rows.select("doc_id", "page_no", F.explode(each).alias("b")).select("doc_id", "page_no", "b.*")


def _grid(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A ruled table of two rows and two columns on A4 pages, framed by the page's edge, and a line of text below it."""
    rows, n = _doc(spark, d), F.col("page_no").cast("string")
    runs = _runs(rows, (F.lit("Header1"), 60, 680, 50, 10), (F.lit("Header2"), 210, 680, 50, 10), (F.concat(F.lit("Cell"), n), 60, 650, 40, 10), (F.col("doc_id"), 210, 650, 40, 10), (F.lit("below"), 60, 500, 40, 10))
    rules = [(50, y, 350, y + 0.5) for y in (640, 670, 700)] + [(x, 640, x + 0.5, 700) for x in (50, 200, 350)]
    paths = _boxes(rows, *rules, (2, 2, 593, 840))
    return runs, paths, rows.select("doc_id", "page_no", *[F.lit(float(v)).alias(c) for c, v in (("llx", 0), ("lly", 0), ("urx", 595), ("ury", 842))])


@query(f"SELECT {_D}, page_no, 1 AS table_no, r AS row_no, c AS col_no, CASE WHEN r = 1 THEN 'Header' || c WHEN c = 1 THEN 'Cell' || page_no ELSE CAST(doc AS VARCHAR) END AS text FROM {_P}, (VALUES (1), (2)) a(r), (VALUES (1), (2)) b(c)")
def layout_table_cells(spark, d):
    return layout.table_cells(*_grid(spark, d)).select("doc_id", "page_no", "table_no", "row_no", "col_no", "text")


@query(f"SELECT {_D}, page_no, 'below' AS text FROM {_P}")
def layout_outside_tables(spark, d):
    runs, paths, boxes = _grid(spark, d)
    return layout.outside_tables(runs, layout.table_cells(runs, paths, boxes), [1]).select("doc_id", "page_no", "text")


@query(f"SELECT {_D}, page_no, 1 AS table_no, r AS row_no, c AS col_no, CASE c WHEN 1 THEN 'item ' || r WHEN 2 THEN CAST(page_no * r AS VARCHAR) ELSE 'kg' END AS text FROM {_P}, (VALUES (1), (2), (3)) a(r), (VALUES (1), (2), (3)) b(c) WHERE NOT (r = 2 AND c = 3)")
def layout_borderless(spark, d):
    n = F.col("page_no")
    rows = [[(F.lit(f"item {r}"), 60, 700 - 20 * r, 40, 10), ((n * r).cast("string"), 160, 700 - 20 * r + (r % 2), 20, 10)] + [(F.lit("kg"), 260, 700 - 20 * r, 20, 10)] * (r != 2) for r in (1, 2, 3)]
    runs = _runs(_doc(spark, d), (F.lit("A heading alone"), 60, 760, 120, 14), *[x for r in rows for x in r], (F.lit("a closing line"), 60, 560, 90, 10))
    return layout.borderless_cells(runs).select("doc_id", "page_no", "table_no", "row_no", "col_no", "text")


@query(f"SELECT {_D}, page_no, text, tag FROM {_P} p, (VALUES ('Title', 'H1'), ('Part', 'H2'), ('a line of the body that is long', 'P'), ('foot', 'P')) v(text, tag)".replace("page_no, text, tag FROM", "page_no, v.text, v.tag FROM"))
def layout_headings(spark, d):
    runs = _runs(_doc(spark, d), (F.lit("Title"), 60, 760, 80, 24), (F.lit("Part"), 60, 720, 60, 16), (F.lit("a line of the body that is long"), 60, 690, 200, 10), (F.lit("foot"), 60, 40, 20, 8))
    return layout.headings(runs).select("doc_id", "page_no", "text", "tag")


@query(f"SELECT {_D}, page_no, v.n AS para_no, v.t AS text FROM {_P}, (VALUES (1, 'The first paragraph goes on here.'), (2, 'Next one is far below.')) v(n, t)")
def layout_paragraphs(spark, d):
    runs = _runs(_doc(spark, d), (F.lit("The first paragraph"), 60, 700, 200, 10), (F.lit("goes on here."), 60, 688, 195, 10), (F.lit("Next one is far below."), 60, 640, 200, 10))
    return layout.page_paragraphs(runs)


@query(f"SELECT doc_id, page_no, CAST(i AS INT) AS seq, w AS text, 72.0 * 10 * i / 300 AS x, 792.0 - 72.0 * 60 / 300 AS y, 9.6 AS size FROM (SELECT doc_id, page_no, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {_D}, page_no, regexp_extract_all(text, '[A-Za-z&<]+') AS ws FROM {_P}))")
def hocr_overlay(spark, d):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z&<]+"), F.lit(0))
    span = lambda w, i: F.concat(F.lit("<span class='ocrx_word' id='w' title='bbox "), (10 * (i + 1)).cast("string"), F.lit(" 20 "), (10 * (i + 1) + 9).cast("string"), F.lit(" 60; x_wconf 90'>"), F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</span>"))
    page = _pages(spark, d).select(F.struct(F.col("doc").cast("string").alias("doc_id"), "page_no").alias("page"), F.concat(F.lit("<div class='ocr_page'>"), F.array_join(F.transform(words, span), " "), F.lit("</div>")).alias("hocr"))
    found = hocr.words(page, "page").select("page.*", "seq", "text", "x0", "y0", "x1", "y1")
    boxes = _doc(spark, d).select("doc_id", "page_no", *[F.lit(float(v)).alias(c) for c, v in (("llx", 0), ("lly", 0), ("urx", 612), ("ury", 792))])
    return hocr.overlay(found, boxes).select("doc_id", "page_no", "seq", "text", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("size", 6).alias("size"))


_HEBREW = "chr(CAST(1488 + doc_id % 20 AS INT)) || chr(1490) || ' ' || chr(1491) || chr(1492)"


@query(f"SELECT doc_id, w AS logical, reverse(w) AS turned, 'abc 12 ' || reverse(w) AS mixed, lang AS plain FROM (SELECT *, {_HEBREW} AS w FROM documents)")
def bidi_reading_order(spark, d):
    """Words of Hebrew letters as they are drawn, alone and inside a left-to-right line."""
    drawn = F.concat(F.lit("הד ג"), F.get(F.split(F.lit("אבגדהוזחטיךכלםמןנסעף"), ""), (F.col("doc_id") % 20).cast("int")))
    rows = table(spark, d, "documents").select("doc_id", "lang", drawn.alias("v"))
    return rows.select("doc_id", bidi.reordered(F.col("v")).alias("logical"), F.col("v").alias("turned"), bidi.reordered(F.concat(F.lit("abc "), F.reverse("v"), F.lit(" 12"))).alias("mixed"), bidi.reordered(F.col("lang")).alias("plain"))


@query(f"SELECT {_D}, page_no, 'name' || repeat(' ', 16) || 'price' || chr(13) || chr(10) || '  page' || page_no || repeat(' ', CAST(14 - length(CAST(page_no AS VARCHAR)) AS INT)) || '12' || chr(13) || chr(10) || 'end' AS text FROM {_P}")
def text_on_grid(spark, d):
    n = F.col("page_no").cast("string")
    one = F.length(n)
    rows = _doc(spark, d)
    runs = _runs(rows, (F.lit("name"), 60, 700, 20, 10), (F.lit("price"), 160, 700, 25, 10), (F.concat(F.lit("page"), n), 70, 680, 0, 10), (F.lit("12"), 160, 680, 10, 10), (F.lit("end"), 60, 600, 15, 10))
    return pdf.grid_text(runs.withColumn("w", F.when(F.col("w") == 0, 5.0 * (4 + one)).otherwise(F.col("w"))))


@query(f"SELECT doc, page_no, 'body ' || page_no AS text FROM (SELECT CAST(doc AS VARCHAR) AS doc, page_no FROM {_P})")
def compare_text_without(spark, d):
    """Page texts without what stands in the margins."""
    rows = _doc(spark, d)
    runs = _runs(rows, (F.lit("header"), 60, 780, 60, 10), (F.concat(F.lit("body "), F.col("page_no").cast("string")), 60, 500, 60, 10), (F.lit("footer"), 60, 20, 60, 10))
    margins = _boxes(rows, (0, 770, 612, 792), (0, 0, 612, 50)).withColumnRenamed("doc_id", "doc")
    return compare.text_without(runs, margins.select(*[F.col(c).alias(c) for c in margins.columns]))


# --- texts, fields, pages ---------------------------------------------------------------------------


@query("SELECT doc_id, bool_and(length(l) <= 60 OR NOT contains(l, ' ')) AS fits, max(words) AS words FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, len(regexp_extract_all(t, '[^ \\n]+')) AS words FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(text, 'the', 'thethe'), '[\\x09-\\x0D\\x20]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)) GROUP BY doc_id".replace("bool_and(length(l) <= 60 OR NOT contains(l, ' '))", "true"))
def edits_reflow(spark, d):
    """Lines fit the width, and no word is lost."""
    done = edits.reflow(table(spark, d, "documents"), "the", "thethe", 60)
    lines = F.split("text", "\n", -1)
    return done.select("doc_id", F.forall(lines, lambda x: (F.length(x) <= 60) | ~F.contains(x, F.lit(" "))).alias("fits"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).cast("long").alias("words"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity - 2 * l_linenumber / (l_quantity - -3) AS odd, 0.0 AS none FROM lineitem")
def form_arithmetic(spark, d):
    rows = table(spark, d, "lineitem")
    f = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "q": F.col("l_quantity"), "n": F.col("l_linenumber")}
    run = lambda x: records.arithmetic(x, f)
    return rows.select("l_orderkey", "l_linenumber", run("price * (1 - discount) * (1 + tax)").alias("charge"), run("q - 2 * n / (q - -3)").alias("odd"), run("q / (n - n)").alias("none"))


@query("SELECT c_custkey, 'name' AS name, upper(c_name) AS value, true AS filled FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, false FROM customer")
def form_fill(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_custkey", "doc")
    each = F.explode(F.array(F.struct(F.lit("name").alias("name"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"))))
    fields = rows.select("doc", each.alias("f")).select("doc", "f.*")
    values = rows.select("doc", F.lit("name").alias("name"), F.upper("c_name").alias("value")).unionByName(rows.select("doc", F.lit("unknown").alias("name"), F.lit("x").alias("value")))
    return records.fill(fields, values).select(F.col("doc").alias("c_custkey"), "name", "value", "filled")


@query("SELECT c_custkey, 'title' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'again', c_name FROM customer UNION ALL SELECT c_custkey, 'added', 'x' FROM customer")
def form_edit(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_custkey", "doc")
    fields = rows.select("doc", F.lit("name").alias("name"), F.col("c_name").alias("value")).unionByName(rows.select("doc", F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value")))
    added = rows.select("doc", F.lit("added").alias("name"), F.lit("x").alias("value"))
    return records.edit(fields, added, ["segment"], {"name": "title"}, {"title": "again"}).select(F.col("doc").alias("c_custkey"), "name", "value")


@query("SELECT c_custkey, 'name' AS name, c_name || ' <&>' AS value FROM customer")
def form_xfdf_round_trip(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit("name").alias("name"), F.concat("c_name", F.lit(" <&>")).alias("value"))
    return records.from_xfdf(records.to_xfdf(rows, "c_custkey"), "c_custkey")


@query("SELECT event_id, n AS name, json_extract_string(props, '$.' || n) AS value, CASE WHEN json_extract_string(props, '$.' || n) IS NULL THEN 'missing' ELSE 'ok' END AS status FROM events, (VALUES ('page'), ('nothing')) v(n)")
def form_json_status(spark, d):
    return records.json_status(table(spark, d, "events"), "event_id", "props", ["page", "nothing"])


@query("SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS row_no, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS none FROM nation")
def xml_bind(spark, d):
    one = F.concat(F.lit("<row><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><who><name>"), "n_name", F.lit("</name></who></row>"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<rows>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("x")))), lambda r: r["x"]), ""), F.lit("</rows>")).alias("xml"))
    return records.bind_xml(rows, "n_regionkey", "xml", "row", {"id": "id", "name": "who/name", "none": "none"})


@query("SELECT n_nationkey, n_name AS first, 'second ' || n_regionkey AS second, 'changed' AS changed, CAST(NULL AS VARCHAR) AS none FROM nation")
def xfa_values(spark, d):
    xml = F.concat(F.lit("<xfa:datasets xmlns:xfa='urn:x'><xfa:data><form><part><name>"), "n_name", F.lit("</name></part><part><name>second "), F.col("n_regionkey").cast("string"), F.lit("</name></part></form></xfa:data></xfa:datasets>"))
    rows = table(spark, d, "nation").withColumn("xml", xml)
    x = F.col("xml")
    changed = records.xfa_value(records.with_xfa_value(x, "name", F.lit("changed")), "form.part.name")
    return rows.select("n_nationkey", records.xfa_value(x, "form.part[0].name").alias("first"), records.xfa_value(x, "form.part[1].name").alias("second"), changed.alias("changed"), records.xfa_value(x, "form.part[2].name").alias("none"))


def _paper(spark, d) -> DataFrame:
    size = {"llx": F.lit(0.0), "lly": F.lit(0.0), "urx": (500 + 10 * F.col("page_no")).cast("double"), "ury": F.lit(800.0), "rotate": (90 * (F.col("page_no") % 4)).cast("int"), "_mine": F.col("page_no")}
    return _pages(spark, d).select("doc", "page_no").withColumns(size)


@query(f"SELECT doc, page_no, CAST((90 * (page_no % 4) + 270) % 360 AS INT) AS rotate FROM {_P}")
def pages_rotate(spark, d):
    return pages.rotate(_paper(spark, d), -90).select("doc", "page_no", "rotate")


@query(f"SELECT doc, page_no, 300.0 AS urx, 400.0 AS ury, 300.0 / (500 + 10 * page_no) AS scale_x, 0.5 AS scale_y FROM {_P}")
def pages_resize(spark, d):
    return pages.resize(_paper(spark, d), 300, 400).select("doc", "page_no", "urx", "ury", "scale_x", "scale_y")


@query(f"SELECT doc, page_no, -10.0 AS llx, -20.0 AS lly, 530.0 + 10 * page_no AS urx, 840.0 AS ury FROM {_P}")
def pages_margins(spark, d):
    return pages.margins(_paper(spark, d), 10, 20, 30, 40).select("doc", "page_no", "llx", "lly", "urx", "ury")


@query(f"SELECT doc, CAST(2 * (page_no - 1) + s AS INT) AS page_no, CASE s WHEN 1 THEN 0.0 ELSE 300.0 END AS top, CASE s WHEN 1 THEN 300.0 ELSE 800.0 END AS bottom, page_no AS _mine FROM {_P}, (VALUES (1), (2)) v(s)")
def pages_breaks(spark, d):
    return pages.page_breaks(_paper(spark, d), [300.0]).select("doc", "page_no", "top", "bottom", "_mine")


@query(f"SELECT doc, CAST(page_no AS INT) AS page_no, text FROM {_P} UNION ALL SELECT doc, CAST(page_no + n AS INT), text FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM {_P})")
def pages_with_errors(spark, d):
    p = _pages(spark, d)
    return pages.with_errors([("a", p), ("lost", None), ("b", p)], skip=True)[0]


# --- functions --------------------------------------------------------------------------------------


@query("""SELECT p_partkey, abs(-s) AS f0, ceil(r / 7) AS f1, floor(r / 7) AS f2, trunc(-r / 7) AS f3, trunc(r / s) AS f4, CAST('Infinity' AS DOUBLE) AS f5, r - trunc(r / s) * s AS f6, CAST('NaN' AS DOUBLE) AS f7, sqrt(s) AS f8, pow(s, 2) AS f9, ln(s) AS f10, log10(s) AS f11, cos(radians(s)) AS f12,
CAST(~CAST(s AS INT) AS DOUBLE) AS f13, CASE WHEN NOT s > 25 THEN 1.0 ELSE 0.0 END AS f14, CAST(CAST(s AS INT) | 8 AS DOUBLE) AS f15, CAST(xor(CAST(s AS INT), 5) AS DOUBLE) AS f16, CASE WHEN (s > 10) <> (s <= 20) THEN 1.0 ELSE 0.0 END AS f17, s * 4 AS f18, floor(s / 4) AS f19, CASE WHEN s >= 5 AND s < 40 OR s = 45 AND s <> 7 THEN 1.0 ELSE 0.0 END AS f20, 2.0 AS f21, s AS f22, 3.0 AS f23, CASE WHEN s > 25 THEN s + 1 ELSE s END AS f24, s / 3 AS f25, 1.0 AS f26, -s AS f27 FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_retailprice AS DOUBLE) AS r FROM part)""")
def ps_operators(spark, d):
    """Every operator of calculator programs, on sizes s and prices r."""
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    run = lambda source, *x: calculator.program(source, *x)
    made = [
        run("{ neg abs }", s)[0], run("{ 7 div ceiling }", r)[0], run("{ 7 div floor }", r)[0], run("{ neg 7 div truncate }", r)[0], run("{ idiv }", r, s)[0], run("{ 0 idiv }", r)[0], run("{ mod }", r, s)[0], run("{ 0 mod }", r)[0],
        run("{ sqrt }", s)[0], run("{ 2 exp }", s)[0], run("{ ln }", s)[0], run("{ log }", s)[0], run("{ cos }", s)[0], run("{ not }", s)[0], run("{ 25 gt not }", s)[0], run("{ 8 or }", s)[0], run("{ 5 xor }", s)[0],
        run("{ dup 10 gt exch 20 le xor }", s)[0], run("{ 2 bitshift }", s)[0], run("{ -2 bitshift }", s)[0], run("{ dup dup dup 5 ge exch 40 lt and 3 1 roll 45 eq exch 7 ne and or }", s)[0], run("{ pop 1 2 3 3 1 roll exch pop exch pop }", s)[0],
        run("{ 9 1 index exch pop exch pop }", s)[0], run("{ pop 1 2 3 2 copy pop pop exch pop exch pop }", s)[0], run("{ dup 25 gt { 1 add } if }", s)[0], run("{ cvr 3 div }", s)[0], run("{ pop true false or }", s)[0], run("{ 0 exch sub cvi }", s)[0],
    ]
    return table(spark, d, "part").select("p_partkey", *[c.alias(f"f{i}") for i, c in enumerate(made)])


@query("SELECT doc_id, CAST(i AS INT) AS match_no, 'the' AS match FROM (SELECT doc_id, unnest(range(1, len(regexp_extract_all(text, 'the')) + 1)) AS i FROM documents)")
def surface_table_function(spark, d):
    """A table function in SQL."""
    surface.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("paperloom_documents")
    return spark.sql("SELECT t.doc_id, h.match_no, h.match FROM paperloom_documents t, LATERAL paperloom_matches(t.text, 'the') h")


@query("SELECT p_partkey, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_partkey % 9 + 1] AS roman FROM part")
def surface_scalar_function(spark, d):
    surface.register(spark)
    table(spark, d, "part").createOrReplaceTempView("paperloom_part")
    return spark.sql("SELECT p_partkey, paperloom_roman(CAST(p_partkey % 9 + 1 AS INT)) AS roman FROM paperloom_part")


# --- codecs, images, containers ---------------------------------------------------------------------

_CODECS = ("FlateDecode", "LZWDecode", "ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode")


@query("SELECT doc_id, " + ", ".join(f"sha256(text) AS {c.lower()}" for c in _CODECS) + " FROM documents")
def codec_round_trips(spark, d):
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", *[F.sha2(codecs.decoded(codecs.encoded(raw, c), [c]), 256).alias(c.lower()) for c in _CODECS])


def _one_row(x: pd.Series) -> pd.Series:
    return x.map(lambda v: codecs.png(len(v), 1, 1, bytes(v.tolist())))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS width, 1 AS height, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(abs(x) * 255) AS BIGINT) % 256)) AS BIGINT) AS total FROM embeddings")
def image_pixels(spark, d):
    """Vectors as images of one row, written and decoded."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 255) % 256).cast("int")).alias("v"))
    got = rows.select("vec_id", codecs.image(F.pandas_udf(_one_row, "binary")("v")).alias("i"))
    hexed = F.regexp_extract_all(F.hex("i.samples"), F.lit("(..)"), F.lit(1))
    return got.select("vec_id", "i.width", "i.height", F.aggregate(F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


# --- graphs, checks, streams ------------------------------------------------------------------------


@query("SELECT min('b' || doc_id) AS id, 'text ' || doc_id % 10 AS content, [min('m' || doc_id)] AS refs FROM documents GROUP BY doc_id % 10 UNION ALL SELECT min('m' || doc_id), 'mask ' || doc_id % 10, CAST([] AS VARCHAR[]) FROM documents GROUP BY doc_id % 10")
def link_duplicate_objects(spark, d):
    """Images with masks, both stored many times: masks become one first, then the images that differ in nothing else."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    image = docs.select(F.concat(F.lit("b"), n).alias("id"), F.concat(F.lit("text "), n % 10).alias("content"), F.array(F.concat(F.lit("m"), n)).alias("refs"))
    mask = docs.select(F.concat(F.lit("m"), n).alias("id"), F.concat(F.lit("mask "), n % 10).alias("content"), F.array().cast("array<string>").alias("refs"))
    return graphs.link_duplicates(image.unionByName(mask))


@query(f"SELECT doc, page_no, NOT (page_no % 2 = 0) AND (CASE WHEN page_no % 3 = 0 THEN 0.4 ELSE 0.0 END) <= 0.1 AS blank FROM {_P}")
def blank_pages(spark, d):
    p = _pages(spark, d)
    images = p.where("page_no % 3 = 0").select("doc", "page_no", F.explode(F.array(F.lit("a"), F.lit("a"), F.lit("b"))).alias("image"), F.lit(0.2).alias("coverage"))
    return checks.blank_pages(p.select("doc", "page_no", (F.col("page_no") % 2 == 0).alias("hard")), images, 0.1)


@query(f"SELECT doc, 'o' || page_no AS id, page_no * 100 AS \"offset\" FROM {_P} WHERE page_no * 100 >= 250 AND doc % 2 = 0")
def unsigned_content(spark, d):
    p = _pages(spark, d)
    objects = p.select("doc", F.concat(F.lit("o"), "page_no").alias("id"), (F.col("page_no") * 100).alias("offset")).unionByName(p.select("doc", F.concat(F.lit("o"), "page_no").alias("id"), F.lit(1).alias("offset")))
    signatures = p.where("page_no = 1 AND doc % 2 = 0").select("doc", F.explode(F.array(F.lit(100), F.lit(250))).alias("end"))
    return checks.unsigned(objects, signatures)


@query(f"SELECT doc, NOT (doc % 3 <> 0 AND doc % 2 = 0) AS compromised FROM (SELECT DISTINCT doc FROM {_P})")
def signature_coverage(spark, d):
    docs = _pages(spark, d).select("doc").distinct()
    signatures = docs.select("doc", F.explode(F.array(F.struct(F.lit(True).alias("valid"), F.lit(0).alias("start"), F.lit(50).alias("end")), F.struct((F.col("doc") % 3 != 0).alias("valid"), F.lit(0).alias("start"), F.when(F.col("doc") % 2 == 0, 90).otherwise(80).alias("end")))).alias("s")).select("doc", "s.*")
    return checks.sound(signatures, docs.withColumn("size", F.lit(90)))


@query(f"SELECT {_D}, page_no, CASE page_no % 3 WHEN 1 THEN 0 ELSE -1 END AS lowest, CASE page_no % 3 WHEN 1 THEN 1 ELSE -1 END AS last FROM {_P} WHERE page_no % 3 > 0".replace("page_no % 3 > 0", "page_no % 3 <> 0"))
def unbalanced_operators(spark, d):
    ops = F.when(F.col("page_no") % 3 == 1, F.array(*map(F.lit, ("q", "q", "Tj", "Q")))).when(F.col("page_no") % 3 == 2, F.array(*map(F.lit, ("Q", "Tj")))).otherwise(F.array(*map(F.lit, ("q", "Q"))))
    rows = _doc(spark, d).select("doc_id", "page_no", F.posexplode(ops).alias("seq", "op"))
    found = checks.unbalanced(rows)
    return found.select("doc_id", "page_no", F.least("lowest", F.lit(0)).cast("int").alias("lowest"), F.col("last").cast("int").alias("last"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events, sum(value) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions_stream(spark, d):
    """The table of events as a stream of files, read to its end."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    out = streams.whole(streams.sessions(source))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "events", "value")


@query("SELECT doc_id, 'text.txt' AS name, sha256(text) AS sha256 FROM documents")
def zip_members(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("text.txt").alias("name"), F.col("text").cast("binary").alias("content"))
    back = archives.entries(archives.pack(rows, "path"))
    return back.select(F.col("path").cast("long").alias("doc_id"), "name", F.sha2("content", 256).alias("sha256"))
