"""Recognised words of hOCR pages as text runs, so that they are searched and exported like drawn text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.export import unescape

_WORD = r"<span\b[^>]*class=['\"]ocrx_word['\"][^>]*>(?:<[^>]*>)*[^<]*"
_BOX = r"bbox ([0-9]+) ([0-9]+) ([0-9]+) ([0-9]+)"


def words(df: DataFrame, key: str = "doc_id", column: str = "hocr") -> DataFrame:
    """(key, seq, text, x0, y0, x1, y1): the words of a page in pixels from its upper left; empty ones are left out."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(_WORD), F.lit(0))).alias("i", "w"))
    side = lambda k: F.regexp_extract("w", _BOX, k).cast("int")
    text = F.trim(unescape(F.regexp_extract("w", r"([^<>]*)$", 1)))
    return rows.select(key, (F.col("i") + 1).alias("seq"), text.alias("text"), *[side(k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"), 1)]).where("text <> ''")


def overlay(words_: DataFrame, pages: DataFrame, dpi: float = 300.0) -> DataFrame:
    """(doc_id, page_no, seq, text, x, y, w, font, size): words (doc_id, page_no, ...) as invisible runs on their pages, in points from the lower left."""
    point = 72.0 / dpi
    box = pages.select("doc_id", "page_no", F.col("llx").alias("_x"), F.col("ury").alias("_top"))
    placed = words_.join(box, ["doc_id", "page_no"])
    return placed.select(
        "doc_id", "page_no", "seq", "text", (F.col("_x") + F.col("x0") * point).alias("x"), (F.col("_top") - F.col("y1") * point).alias("y"),
        ((F.col("x1") - F.col("x0")) * point).alias("w"), F.lit("hidden").alias("font"), ((F.col("y1") - F.col("y0")) * point).alias("size"),
    )
