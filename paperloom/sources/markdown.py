"""Markdown and plain text to blocks by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, block_no, kind, level, text): headings, list items, quotes, rules, code and paragraphs, in order.

    Fences part code from the rest; other text is parted at empty lines and at lines that are blocks of their own.
    """
    parts = F.split(F.coalesce(F.col(column), F.lit("")), r"(?m)^```[^\n]*$\n?", -1)
    single = r"(?m)^(#{1,6} [^\n]*|[ ]*(?:[-*+]|[0-9]+[.)]) [^\n]*|>[^\n]*|(?:---|\*\*\*|___)[ ]*)$"
    apart = lambda x: F.filter(F.split(F.regexp_replace(x, single, "\n$1\n"), r"\n[ \t]*\n+", -1), lambda b: F.trim(F.replace(b, F.lit("\n"), F.lit(" "))) != "")
    made = F.flatten(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.array(F.struct(F.lit(True).alias("code"), x.alias("b")))).otherwise(F.transform(apart(x), lambda b: F.struct(F.lit(False).alias("code"), F.regexp_replace(b, r"^\n+|\n+$", "").alias("b"))))))
    rows = df.select(key, F.posexplode(made).alias("i", "r")).select(key, (F.col("i") + 1).alias("block_no"), F.col("r.code").alias("code"), F.col("r.b").alias("b"))
    kind, text, level = _kind(F.col("code"), F.col("b"))
    return rows.select(key, "block_no", kind.alias("kind"), level.alias("level"), text.alias("text"))


def _kind(code: Column, b: Column) -> tuple[Column, Column, Column]:
    head, item, quote, rule = r"^(#{1,6}) (.*)$", r"^( *)(?:[-*+]|[0-9]+[.)]) (.*)$", r"^> ?(.*)$", r"^(?:---|\*\*\*|___) *$"
    kind = F.when(code, "code").when(b.rlike(head), "heading").when(b.rlike(rule), "rule").when(b.rlike(item), "item").when(b.rlike(quote), "quote").otherwise("paragraph")
    text = F.when(code, b).when(b.rlike(head), F.regexp_extract(b, head, 2)).when(b.rlike(rule), "").when(b.rlike(item), F.regexp_extract(b, item, 2)).when(b.rlike(quote), F.regexp_extract(b, quote, 1)).otherwise(b)
    level = F.when(code, 0).when(b.rlike(head), F.length(F.regexp_extract(b, head, 1))).when(b.rlike(item), F.floor(F.length(F.regexp_extract(b, item, 1)) / 2).cast("int") + 1).otherwise(0)
    return kind, text, level


def plain(text: Column) -> Column:
    """Inline marks removed: links keep their text, emphasis and code their content."""
    t = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(\*\*|__)(.+?)\1", "$2")
    t = F.regexp_replace(t, r"(?<![A-Za-z0-9])[*_](.+?)[*_](?![A-Za-z0-9])", "$1")
    return F.regexp_replace(t, r"`([^`]*)`", "$1")
