"""HTML rows to text, links and elements by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.strings import decode_entities

#: Elements that end a line of text (fixed values).
BLOCKS = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "blockquote", "pre", "title")


def text(html: Column) -> Column:
    """Text without comments, scripts and styles; block elements break lines, white space is folded."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<script\b.*?</script\s*>", "")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", "")
    t = F.regexp_replace(t, r"[ \t\r\n]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return decode_entities(F.regexp_replace(t, r"^[ \n]+|[ \n]+$", ""))


def links(df: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, link_no, href): values of quoted href attributes of a elements, in order."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    return df.select(key, F.posexplode(found).alias("i", "href")).select(key, (F.col("i") + 1).alias("link_no"), "href")


def elements(df: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, name, n): start tags of each element name."""
    names = F.regexp_extract_all(F.col(column), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return df.select(key, F.explode(F.transform(names, F.lower)).alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)), F.lit(""))
