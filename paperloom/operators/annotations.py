"""Annotations as rows: XML out and in, edits, flattening and stamps.

A row is (doc_id, page_no, seq, type, contents, author, uri, llx, lly, urx, ury), as the page files give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .export import escape, unescape

_BOX = ("llx", "lly", "urx", "ury")


def _chosen(df: DataFrame, types: list[str] | None, first: int, last: int) -> DataFrame:
    out = df.where(F.col("page_no").between(first, last))
    return out.where(F.col("type").isin(types)) if types else out


def to_xfdf(annotations: DataFrame, types: list[str] | None = None, first: int = 1, last: int = 1 << 30, doc: str = "doc_id") -> DataFrame:
    """(doc, xfdf): annotations of some types on a range of pages, by page and order; pages count from 0 there."""
    box = F.concat_ws(",", *[F.format_string("%.2f", F.col(c).cast("double")) for c in _BOX])
    name = F.lower("type")
    put = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f' {n}="'), escape(c), F.lit('"'))).otherwise("")
    one = F.concat(F.lit("<"), name, F.lit(' page="'), (F.col("page_no") - 1).cast("string"), F.lit('" rect="'), box, F.lit('"'), put("title", F.col("author")), put("uri", F.col("uri")), F.lit("><contents>"), escape(F.col("contents")), F.lit("</contents></"), name, F.lit(">"))
    rows = _chosen(annotations, types, first, last).select(doc, F.struct("page_no", "seq", one.alias("x")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "")
    return rows.groupBy(doc).agg(F.concat(F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>'), body, F.lit("</annots></xfdf>")).alias("xfdf"))


#: Types by their names in lower case (fixed values).
TYPES = "Text Link FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink Popup FileAttachment Redact Watermark".split()
_ELEMENT = r"<([a-z]+) page=\"([0-9]+)\" rect=\"([^\"]*)\"([^>]*)><contents>([^<]*)</contents>"


def from_xfdf(df: DataFrame, types: list[str] | None = None, doc: str = "doc_id", column: str = "xfdf") -> DataFrame:
    """Annotation rows of XML, those of some types if they are named; seq counts from 1 in a document."""
    rows = df.select(doc, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(_ELEMENT), F.lit(0))).alias("i", "x"))
    part = lambda k: F.regexp_extract("x", _ELEMENT, k)
    given = lambda n: F.when(part(4).rlike(f' {n}="'), unescape(F.regexp_extract(part(4), f' {n}="([^"]*)"', 1)))
    kind = F.coalesce(F.create_map(*[F.lit(v) for t in TYPES for v in (t.lower(), t)])[part(1)], part(1))
    box = F.split(part(3), ",")
    out = rows.select(doc, (part(2).cast("int") + 1).alias("page_no"), (F.col("i") + 1).alias("seq"), kind.alias("type"), unescape(part(5)).alias("contents"), given("title").alias("author"), given("uri").alias("uri"), *[F.get(box, i).cast("double").alias(c) for i, c in enumerate(_BOX)])
    return out.where(F.col("type").isin(types)) if types else out


def deleted(annotations: DataFrame, types: list[str] | None = None, first: int = 1, last: int = 1 << 30) -> DataFrame:
    """The annotations but for those of some types on a range of pages."""
    gone = F.col("page_no").between(first, last)
    return annotations.where(~(gone & F.col("type").isin(types) if types else gone))


def modified(annotations: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The annotations with other values in the rows that the condition names."""
    return annotations.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def flattened(runs: DataFrame, annotations: DataFrame, types: list[str] | None = None, size: float = 10.0) -> DataFrame:
    """Text runs with the contents of annotations drawn as runs after them, in the upper left of their boxes."""
    last = runs.groupBy("doc_id", "page_no").agg(F.max("seq").alias("_last"))
    drawn = _chosen(annotations, types, 1, 1 << 30).where("contents IS NOT NULL").join(last, ["doc_id", "page_no"], "left")
    text = F.regexp_replace("contents", "[\r\n]+", " ")
    return runs.unionByName(drawn.select("doc_id", "page_no", (F.coalesce("_last", F.lit(0)) + F.col("seq")).cast("int").alias("seq"), text.alias("text"), F.col("llx").alias("x"), (F.col("ury") - size).alias("y"), (F.col("urx") - F.col("llx")).alias("w"), F.lit("Helvetica").alias("font"), F.lit(float(size)).alias("size")))


def stamps(annotations: DataFrame) -> DataFrame:
    return annotations.where("type = 'Stamp'")


def moved(annotations: DataFrame, where: Column, x: float, y: float) -> DataFrame:
    """The annotations with the lower left corner of those that the condition names at a point; their sizes stay."""
    return modified(annotations, where, urx=F.col("urx") - F.col("llx") + x, ury=F.col("ury") - F.col("lly") + y, llx=F.lit(float(x)), lly=F.lit(float(y)))
