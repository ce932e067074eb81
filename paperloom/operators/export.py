"""Documents out of relations: HTML, SVG, XML of the structure, bookmarks, and back; one document or page is one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources import pdf


def escape(c: Column) -> Column:
    """Text for XML and HTML; null is empty."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def unescape(c: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _joined(df: DataFrame, keys: list[str], order: list[str], piece: Column, into: str, between: str = "") -> DataFrame:
    """(keys, into): the pieces of a group in order."""
    rows = df.select(*keys, F.struct(*order, piece.alias("_piece")).alias("_r"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda x: x["_piece"]), between).alias(into))


def html(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", column: str = "text") -> DataFrame:
    """(doc, html): a division for each page, a paragraph for each line."""
    lines = F.split(F.coalesce(F.col(column), F.lit("")), r"\r\n|\n|\r", -1)
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))), "")
    one = F.concat(F.lit('<div class="page" id="page'), F.col(page).cast("string"), F.lit('">'), body, F.lit("</div>"))
    return _joined(pages, [doc], [page], one, "html").select(doc, F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html"))


def _plain(c: Column) -> Column:
    """A number without needless zeros."""
    return F.regexp_replace(F.format_string("%.3f", c.cast("double")), r"\.?0+$", "")


def svg(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, svg): the text of each page at its places, from runs and page boxes."""
    box = pages.select("doc_id", "page_no", (F.col("urx") - F.col("llx")).alias("_w"), (F.col("ury") - F.col("lly")).alias("_h"), F.col("llx").alias("_x"), F.col("ury").alias("_top"))
    placed = runs.join(box, ["doc_id", "page_no"])
    piece = F.concat(F.lit('<text x="'), _plain(F.col("x") - F.col("_x")), F.lit('" y="'), _plain(F.col("_top") - F.col("y")), F.lit('" font-size="'), _plain(F.col("size")), F.lit('">'), escape(F.col("text")), F.lit("</text>"))
    body = _joined(placed, ["doc_id", "page_no"], ["seq"], piece, "_body")
    size = F.concat(F.lit('width="'), _plain(F.col("_w")), F.lit('" height="'), _plain(F.col("_h")), F.lit('"'))
    return box.join(body, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" '), size, F.lit(">"), F.coalesce("_body", F.lit("")), F.lit("</svg>")).alias("svg"))


_NUMBER = r'%s="([-0-9.]+)"'
_TEXT = r"<text\b([^>]*)>([^<]*)</text>"


def svg_runs(df: DataFrame, keys: list[str], column: str = "svg") -> DataFrame:
    """(keys, seq, text, x, y, size): the text elements of SVG, y from the page's lower edge."""
    height = F.regexp_extract(F.regexp_extract(column, r"<svg\b[^>]*>", 0), _NUMBER % "height", 1).cast("double")
    rows = df.select(*keys, height.alias("_h"), F.posexplode(F.regexp_extract_all(F.col(column), F.lit(_TEXT), F.lit(0))).alias("_i", "_e"))
    number = lambda n: F.regexp_extract("_e", r"\b" + _NUMBER % n, 1).cast("double")
    return rows.select(*keys, (F.col("_i") + 1).alias("seq"), unescape(F.regexp_extract("_e", _TEXT, 2)).alias("text"), number("x").alias("x"), (F.col("_h") - number("y")).alias("y"), number("font-size").alias("size"))


def _nested(df: DataFrame, doc: str, order: str, level: str, opened: Column, closed: Column, into: str) -> DataFrame:
    """(doc, into): elements in document order, each closed before the next of its level or above."""
    rows = df.select(doc, F.struct(F.col(order).alias("o"), F.col(level).alias("level"), opened.alias("a"), closed.alias("z")).alias("_r"))
    groups = rows.groupBy(doc).agg(F.array_sort(F.collect_list("_r")).alias("_r"))

    def close(acc: Column, down_to: Column) -> Column:
        """The end tags of the elements of a level or deeper, the last first."""
        gone = F.filter(acc["stack"], lambda e: e["level"] >= down_to)
        return F.array_join(F.transform(F.reverse(gone), lambda e: e["z"]), "")

    def step(acc: Column, x: Column) -> Column:
        kept = F.filter(acc["stack"], lambda e: e["level"] < x["level"])
        return F.struct(F.concat(acc["out"], close(acc, x["level"]), x["a"]).alias("out"), F.array_append(kept, F.struct(x["level"].alias("level"), x["z"].alias("z"))).alias("stack"))

    start = F.struct(F.lit("").alias("out"), F.array().cast("array<struct<level:int,z:string>>").alias("stack"))
    whole = F.aggregate("_r", start, step, lambda acc: F.concat(acc["out"], close(acc, F.lit(-1))))
    return groups.select(doc, whole.alias(into))


def tagged_xml(structure: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, xml): the structure elements (id in document order, level, type, title, alt, actual) as nested elements."""
    name = F.when(F.col("type").rlike("^[A-Za-z_][A-Za-z0-9_.-]*$"), F.col("type")).otherwise("Element")
    attribute = lambda c, n: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {n}="'), escape(F.col(c)), F.lit('"'))).otherwise("")
    opened = F.concat(F.lit("<"), name, attribute("title", "title"), attribute("alt", "alt"), F.lit(">"), escape(F.col("actual")))
    out = _nested(structure, doc, "id", "level", opened, F.concat(F.lit("</"), name, F.lit(">")), "xml")
    return out.select(doc, F.concat(F.lit("<TaggedDocument>"), "xml", F.lit("</TaggedDocument>")).alias("xml"))


def bookmarks_html(outlines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, html): the outline (id in document order, level, title, page_no) as nested lists."""
    opened = F.concat(F.lit('<ul><li><a href="#page'), F.coalesce(F.col("page_no").cast("string"), F.lit("")), F.lit('">'), escape(F.col("title")), F.lit("</a>"))
    return _nested(outlines, doc, "id", "level", opened, F.lit("</li></ul>"), "html")


def convert(files: DataFrame, to: str, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    """(doc_id[, page_no], text, html or svg) of page files; an unknown target raises."""
    runs = lambda: pdf.text_runs(files, key, content, password)
    made: dict[str, Callable[[], DataFrame]] = {
        "text": lambda: pdf.document_text(pdf.page_text(runs())),
        "html": lambda: html(pdf.page_text(runs())),
        "svg": lambda: svg(runs(), pdf.pages(files, key, content, password)),
    }
    if to not in made:
        raise ValueError(f"no conversion to {to}: one of {', '.join(made)}")
    return made[to]()
