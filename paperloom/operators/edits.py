"""Text edits: replace, redact, wrap and paginate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import literal, spans


def replace_all(text: Column, phrase: str, new: str) -> Column:
    return F.replace(text, F.lit(phrase), F.lit(new))


def replace_first(text: Column, phrase: str, new: str) -> Column:
    from paperloom.functions.strings import replace

    return replace(text, phrase, new)


def replace_text(text: Column, phrase: str, new: str, first_in_document: bool = False, first_on_page: bool = False) -> Column:
    """Replaces all, unless both settings say first."""
    return replace_first(text, phrase, new) if first_in_document and first_on_page else replace_all(text, phrase, new)


def redact(text: Column, pattern: str, mark: str = "█") -> Column:
    """Matches covered by a mark for each character."""
    s = spans(text, pattern)

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.repeat(F.lit(mark), x["end"] - x["start"]))
        return F.struct(x["end"].alias("at"), F.array_append(acc["out"], piece).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.coalesce(F.aggregate(s, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))), text)


def redact_phrase(text: Column, phrase: str) -> Column:
    return redact(text, literal(phrase))


def lines(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line_no, line): lines of a text, from 1."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\r\n|\r|\n", -1)).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def lines_per_page(height: float, size: float) -> int:
    return max(1, int(height / (1.2 * size)))


def paginate(df: DataFrame, height: float = 700.0, size: float = 12.0, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, page_no, text): pages of as many lines as fit; an empty text has one empty page.  No shuffle: pages come from slices of a row's lines."""
    n = lines_per_page(height, size)
    parts = F.split(F.coalesce(F.col(column), F.lit("")), "\r\n|\r|\n", -1)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / n).cast("int")), lambda p: F.array_join(F.slice(parts, p * n + 1, n), "\n"))
    return df.select(key, F.posexplode(cut).alias("p", "text")).select(key, (F.col("p") + 1).alias("page_no"), "text")


def wrap(df: DataFrame, width: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line_no, line): pieces of ``width`` characters of each line; empty lines stay."""
    each = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "\n", -1), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(x, i * width + 1, F.lit(width))))
    return df.select(key, F.posexplode(F.flatten(each)).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def wrap_words(df: DataFrame, width: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text): lines broken at single spaces so that none is longer than the width, but for longer words."""

    def add(acc: Column, w: Column) -> Column:
        fits = (F.length(acc["line"]) + 1 + F.length(w) <= width) & acc["begun"]
        line = F.when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w)
        done = F.when(fits | ~acc["begun"], acc["done"]).otherwise(F.concat(acc["done"], acc["line"], F.lit("\n")))
        return F.struct(done.alias("done"), line.alias("line"), F.lit(True).alias("begun"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"), F.lit(False).alias("begun"))
    flow = lambda x: F.aggregate(F.split(x, " ", -1), start, add, lambda a: F.concat(a["done"], a["line"]))
    return df.select(key, F.array_join(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "\n", -1), flow), "\n").alias(column))


def reflow(df: DataFrame, phrase: str, new: str, width: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text) with a phrase replaced and its paragraphs, which single line ends do not part, broken anew to the width."""
    parts = F.split(replace_all(F.coalesce(F.col(column), F.lit("")), phrase, new), r"\n[ \t]*\n", -1)
    flat = F.array_join(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), "\n")
    return wrap_words(df.select(key, flat.alias(column)), width, key, column).select(key, F.replace(column, F.lit("\n\n"), F.lit("\n")).alias(column))
