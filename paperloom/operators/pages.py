"""Page algebra: pages are rows (doc, page_no from 1, ...), documents are sets of them.

Every operator works within a document, so all of them scale with the number of documents.  Renumbering
is a window over one document's pages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def renumber(df: DataFrame, *order: str | Column, doc: str = "doc") -> DataFrame:
    """page_no from 1 in the given order; the operators' own columns, which begin with _paperloom_, go."""
    out = df.withColumn("page_no", F.row_number().over(W.partitionBy(doc).orderBy(*order)))
    return out.drop(*[c for c in df.columns if c.startswith("_paperloom_")])


def page_count(df: DataFrame) -> Column:
    return F.count("*").over(W.partitionBy("doc"))


def concat(parts: list[DataFrame]) -> DataFrame:
    """The pages of the same document in each part, one part after the other."""
    tagged = [p.withColumn("_paperloom_part", F.lit(i)) for i, p in enumerate(parts)]
    return renumber(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), "_paperloom_part", "page_no")


def merge(df: DataFrame, into: Column, order: Column) -> DataFrame:
    """Documents joined to the document ``into``, in the given order."""
    return renumber(df.withColumn("_paperloom_order", order).withColumn("doc", into), "_paperloom_order", "page_no")


def blank_between(first: DataFrame, blank: list[str], second: DataFrame, column: str = "text") -> DataFrame:
    """First, blank, second, for documents that are in both; blank holds the texts of the pages that stand between."""
    docs = first.select("doc").distinct().join(second.select("doc").distinct(), "doc")
    between = docs.select("doc", F.posexplode(F.array(*[F.lit(t) for t in blank])).alias("_paperloom_i", column)).select("doc", (F.col("_paperloom_i") + 1).alias("page_no"), column)
    return concat([first, between, second])


def extract_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Pages start..end, clamped to the document."""
    n = page_count(df)
    out = df.withColumn("_paperloom_n", n).where(F.col("page_no").between(max(start, 1), F.least(F.lit(end), F.col("_paperloom_n"))))
    return renumber(out, "page_no")


def extract_set(df: DataFrame, pages: list[int]) -> DataFrame:
    """The listed pages in source order; repeats and numbers out of range are ignored."""
    return renumber(df.where(F.col("page_no").isin(sorted(set(pages)))), "page_no")


def append_range(df: DataFrame, source: DataFrame, start: int, end: int) -> DataFrame:
    return concat([df, extract_range(source, start, end)])


def insert_after(df: DataFrame, page: int, source: DataFrame) -> DataFrame:
    """The source's pages after page ``page``, clamped to 0..n; 0 puts them first."""
    sized = df.withColumn("_paperloom_n", page_count(df))
    at = F.least(F.lit(max(page, 0)), F.col("_paperloom_n"))
    head = sized.where(F.col("page_no") <= at).drop("_paperloom_n").withColumn("_paperloom_part", F.lit(0))
    tail = sized.where(F.col("page_no") > at).drop("_paperloom_n").withColumn("_paperloom_part", F.lit(2))
    return renumber(head.unionByName(source.withColumn("_paperloom_part", F.lit(1)), allowMissingColumns=True).unionByName(tail, allowMissingColumns=True), "_paperloom_part", "page_no")


def delete(df: DataFrame, pages: list[int], strict: bool = True) -> DataFrame:
    """The other pages.  With strict, a number out of a document's range fails the query."""
    gone = sorted(set(pages))
    if strict and gone:
        bad = (F.lit(gone[0]) < 1) | (F.lit(gone[-1]) > F.col("_paperloom_n"))
        df = df.withColumn("_paperloom_n", page_count(df)).where(F.when(bad, F.raise_error(F.lit("a page number is out of range"))).otherwise(F.lit(True)))
    return renumber(df.where(~F.col("page_no").isin(gone)), "page_no")


def split_first(df: DataFrame, n: int) -> DataFrame:
    return extract_range(df, 1, n)


def split_to_end(df: DataFrame, start: int) -> DataFrame:
    return renumber(df.where(F.col("page_no") >= start), "page_no")


def split_single(df: DataFrame) -> DataFrame:
    """A document for each page: part is its number."""
    return df.withColumn("part", F.col("page_no")).withColumn("page_no", F.lit(1))


def split_bulks(df: DataFrame, bulks: list[tuple[int, int]]) -> DataFrame:
    """A part for each pair first..last; pairs may overlap.  An empty list or a pair with first > last raises."""
    if not bulks or any(len(b) < 2 or b[0] > b[1] for b in bulks):
        raise ValueError("bulks need pairs of a first and a last page")
    parts = F.array(*[F.struct(F.lit(i + 1).alias("part"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(bulks)])
    fits = F.filter(parts, lambda x: F.col("page_no").between(x["lo"], x["hi"]))
    out = df.select("*", F.explode(fits).alias("_paperloom_b")).withColumn("part", F.col("_paperloom_b.part"))
    return out.withColumn("page_no", F.row_number().over(W.partitionBy("doc", "part").orderBy("page_no"))).drop("_paperloom_b")


def booklet(df: DataFrame) -> DataFrame:
    """(doc, sheet, side, position, page_no): pages padded to a multiple of four; numbers past the end are null."""
    docs = df.groupBy("doc").agg(F.count("*").cast("int").alias("n")).withColumn("padded", (F.ceil(F.col("n") / 4) * 4).cast("int"))
    sheets = docs.select("doc", "n", "padded", F.explode(F.sequence(F.lit(0), (F.col("padded") / 4).cast("int") - 1)).alias("sheet"))
    p, k = F.col("padded"), F.col("sheet")
    slot = lambda side, place, c: F.struct(F.lit(side).alias("side"), F.lit(place).alias("position"), c.cast("int").alias("p"))
    slots = F.array(slot("front", 1, p - 2 * k), slot("front", 2, 2 * k + 1), slot("back", 1, 2 * k + 2), slot("back", 2, p - 2 * k - 1))
    return sheets.select("doc", "n", "sheet", F.explode(slots).alias("s")).select("doc", "sheet", "s.side", "s.position", F.when(F.col("s.p") <= F.col("n"), F.col("s.p")).alias("page_no"))


def n_up(df: DataFrame, x: int, y: int) -> DataFrame:
    """(…, sheet, row, col): x by y pages on a sheet, rows from the top."""
    if x < 1 or y < 1:
        raise ValueError("a grid needs a row and a column")
    at = F.col("page_no") - 1
    return df.withColumns({"sheet": F.floor(at / (x * y)).cast("int"), "row": F.floor((at % (x * y)) / x).cast("int"), "col": (at % x).cast("int")})


def rotate(df: DataFrame, degrees: int) -> DataFrame:
    """Adds a turn to ``rotate``, kept in 0..359."""
    return df.withColumn("rotate", F.pmod(F.coalesce("rotate", F.lit(0)) + degrees, F.lit(360)).cast("int"))


def resize(df: DataFrame, width: float, height: float) -> DataFrame:
    """Scales the pages' boxes (llx, lly, urx, ury) to a size."""
    return df.withColumns({"scale_x": F.lit(float(width)) / (F.col("urx") - F.col("llx")), "scale_y": F.lit(float(height)) / (F.col("ury") - F.col("lly")), "llx": F.lit(0.0), "lly": F.lit(0.0), "urx": F.lit(float(width)), "ury": F.lit(float(height))})


def margins(df: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Boxes grown by margins."""
    return df.withColumns({"llx": F.col("llx") - left, "lly": F.col("lly") - bottom, "urx": F.col("urx") + right, "ury": F.col("ury") + top})


def page_breaks(df: DataFrame, breaks: list[float]) -> DataFrame:
    """Pages cut at heights from the top: a row for each strip (top, bottom)."""
    height = F.col("ury") - F.col("lly")
    cuts = F.array(F.lit(0.0), *[F.least(F.lit(float(b)), height) for b in sorted(breaks)], height)
    strips = F.filter(F.transform(F.slice(cuts, 1, len(breaks) + 1), lambda c, i: F.struct(c.alias("top"), F.element_at(cuts, i + 2).alias("bottom"))), lambda s: s["bottom"] > s["top"])
    out = df.select("*", F.posexplode(strips).alias("_paperloom_strip", "_paperloom_s"))
    return renumber(out.withColumns({"top": F.col("_paperloom_s.top"), "bottom": F.col("_paperloom_s.bottom")}), "page_no", "_paperloom_strip")


def with_errors(parts: list[tuple[str, DataFrame | None]], skip: bool = False) -> tuple[DataFrame, list[str]]:
    """Concatenation of named parts of which some could not be read: stops at the first, or skips and lists them."""
    bad = [n for n, p in parts if p is None]
    if bad and not skip:
        raise ValueError(f"{bad[0]} cannot be read")
    return concat([p for _, p in parts if p is not None]), bad


def labels(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with ``label``: the last range (doc, start from 0, style, prefix, first) that starts at or before the page."""
    starts = ranges.select("doc", (F.col("start") + 1).alias("page_no"), F.struct("start", "style", "prefix", "first").alias("range"), F.lit(0).alias("_paperloom_kind"))
    both = df.withColumn("_paperloom_kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    last = F.last("range", ignorenulls=True).over(W.partitionBy("doc").orderBy("page_no", "_paperloom_kind").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("r", last).where("_paperloom_kind = 1")
    n = F.col("page_no") - 1 - F.col("r.start") + F.col("r.first")
    return out.withColumn("label", label(F.col("r.style"), F.col("r.prefix"), n)).drop("range", "r", "_paperloom_kind")


def label(style: Column, prefix: Column, n: Column) -> Column:
    from paperloom.functions.numbering import alpha, roman

    body = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", alpha(n)).when(style == "a", F.lower(alpha(n))).otherwise("")
    return F.when(style.isNotNull(), F.concat(F.coalesce(prefix, F.lit("")), body))


def attempt(operation: Callable[..., DataFrame], *args, **options) -> tuple[bool, DataFrame | None]:
    """(whether it worked, pages): an operation whose arguments are refused gives no pages instead of an error.

    The result is counted once, so that errors of the data show here too.
    """
    try:
        out = operation(*args, **options)
        out.count()
    except (ValueError, PySparkException):
        return False, None
    return True, out
