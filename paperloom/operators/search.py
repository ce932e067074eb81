"""Phrase and regular-expression search over text columns.

Patterns are Java regular expressions; ``^`` and ``$`` match at line ends, and a pattern that does not
parse matches nothing.  Null text has no matches.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NBSP = "\u00a0"


def literal(phrase: str) -> str:
    """The pattern of a phrase: n spaces match n plain or no-break spaces and one more no-break space; white space with a line break matches any white space."""
    out = []
    for part in re.split(r"(\s+)", phrase.rstrip("\r")):
        if part and part.isspace():
            out.append(r"\s+" if re.search(r"[\r\n]", part) else f"[ {NBSP}]{{{len(part)}}}{NBSP}?")
        elif part:
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}#-])", r"\\\1", part))
    return "".join(out)


def pattern(text: str, regex: bool = False, case_sensitive: bool = True, whole_word: bool = False) -> str:
    """The Java pattern of a search.  Whole words put boundaries around the pattern without a group, so an alternation binds loosely."""
    p = text if regex else literal(text)
    if whole_word:
        p = rf"\b{p}\b"
    return ("(?m)" if case_sensitive else "(?mi)") + p


def parses(spark: SparkSession, p: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(p)
    except Exception:
        return False
    return True


def _safe(p: str) -> str:
    """The pattern, or one that never matches in place of one that does not parse."""
    spark = SparkSession.getActiveSession()
    return p if spark is None or parses(spark, p) else r"(?!)"


def count(text: Column, p: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_safe(p))), F.lit(0))


def hits(df: DataFrame, p: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, hits) of the rows with a match: the pattern is tested before it is counted."""
    return df.where(F.col(column).rlike(_safe(p))).select(key, count(F.col(column), p).alias("hits"))


def multi(df: DataFrame, patterns: dict[str, str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pattern, hits): all patterns in one scan, a row for each that matches."""
    each = F.array(*[F.struct(F.lit(n).alias("pattern"), count(F.col(column), p).alias("hits")) for n, p in patterns.items()])
    return df.select(key, F.explode(each).alias("m")).select(key, "m.*").where("hits > 0")


def spans(text: Column, p: str) -> Column:
    """array<struct<match_no, start, end, match>> of the matches of a text."""
    p = _safe(p)
    matches = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.transform(F.split(text, p, -1), F.length)
    numbered = F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("gap"), i.alias("i")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match_no:int,start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct((x["i"] + 1).alias("match_no"), start.alias("start"), end.alias("end"), x["m"].alias("match"))).alias("out"))

    return F.when(text.rlike(p), F.aggregate(numbered, empty, step, lambda a: a["out"]))


def fragments(df: DataFrame, p: str, key: str | list[str] = "doc_id", column: str = "text") -> DataFrame:
    """(key, match_no, start, end, match): a row for each match."""
    keys = [key] if isinstance(key, str) else key
    return df.select(*keys, F.explode(spans(F.col(column), p)).alias("s")).select(*keys, "s.*")


def joined(df: DataFrame, doc: str = "doc", page: str = "page_no", column: str = "text", separator: str = "\r\n") -> DataFrame:
    """(doc, pages, text): the pages of a document in order, joined; pages holds (page_no, start, size)."""
    rows = df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(column), F.lit("")).alias("t")))).alias("r"))
    size = len(separator)
    marks = F.aggregate(
        "r",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page_no:int,start:int,size:int>>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["t"]) + size).alias("at"), F.array_append(a["out"], F.struct(x["p"].cast("int").alias("page_no"), a["at"].alias("start"), F.length(x["t"]).alias("size"))).alias("out")),
        lambda a: a["out"],
    )
    return rows.select(doc, marks.alias("pages"), F.array_join(F.transform("r", lambda x: x["t"]), separator).alias("text"))


def across_pages(df: DataFrame, p: str, doc: str = "doc", page: str = "page_no", column: str = "text") -> DataFrame:
    """(doc, match_no, first_page, last_page, match): matches over the joined pages of a document, mapped back."""
    found = joined(df, doc, page, column).select(doc, "pages", F.explode(spans(F.col("text"), p)).alias("s"))
    at = lambda c: F.element_at(F.filter("pages", lambda x: x["start"] <= c), -1)["page_no"]
    return found.select(doc, "s.match_no", at(F.col("s.start")).alias("first_page"), at(F.col("s.end") - 1).alias("last_page"), "s.match")


def in_boxes(rows: DataFrame, boxes: DataFrame, keep: bool = True) -> DataFrame:
    """Rows (doc, page_no, x, y, ...) whose point lies in a box (doc, page_no, llx, lly, urx, ury), or lies in none."""
    b = boxes.select(F.col("doc").alias("_d"), F.col("page_no").alias("_p"), "llx", "lly", "urx", "ury")
    on = (F.col("doc") == F.col("_d")) & (F.col("page_no") == F.col("_p")) & F.col("x").between(F.col("llx"), F.col("urx")) & F.col("y").between(F.col("lly"), F.col("ury"))
    return rows.join(b, on, "left_semi" if keep else "left_anti")


def placed(runs: DataFrame, p: str) -> DataFrame:
    """(doc_id, page_no, match_no, match, llx, lly, urx, ury): matches on the lines of pages, with their boxes.

    A line is the runs of one height and its text their texts, with a space where a gap is wider than a fifth of
    the size.  A match's box begins and ends in proportion within the runs that hold its ends.
    """
    line = W.partitionBy("doc_id", "page_no", "y").orderBy("x", "seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(line)
    spaced = runs.withColumn("_space", F.when(gap > F.col("size") * 0.2, 1).otherwise(0))
    rows = spaced.groupBy("doc_id", "page_no", "y").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "text", "w", "size", "_space"))).alias("r"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,x:double,w:double,size:double>>").alias("out"))

    def place(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["_space"]
        end = start + F.length(r["text"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), r["x"].alias("x"), r["w"].alias("w"), r["size"].alias("size"))).alias("out"))

    text = F.array_join(F.transform("r", lambda r: F.concat(F.when(r["_space"] == 1, " ").otherwise(""), r["text"])), "")
    lines = rows.select("doc_id", "page_no", "y", text.alias("_t"), F.aggregate("r", empty, place, lambda a: a["out"]).alias("_runs"))
    hits_ = lines.select("doc_id", "page_no", "y", "_runs", F.explode(spans(F.col("_t"), p)).alias("s"))
    own = F.filter("_runs", lambda r: (r["end"] > F.col("s.start")) & (r["start"] < F.col("s.end")))
    part = lambda r, at: r["x"] + r["w"] * (F.least(F.greatest(at, r["start"]), r["end"]) - r["start"]) / (r["end"] - r["start"])
    boxed = hits_.withColumn("_own", own).select("doc_id", "page_no", "y", "s", F.array_min(F.transform("_own", lambda r: part(r, F.col("s.start")))).alias("llx"), F.array_max(F.transform("_own", lambda r: part(r, F.col("s.end")))).alias("urx"), F.array_max(F.transform("_own", lambda r: r["size"])).alias("_size"))
    number = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy(F.desc("y"), "s.start"))
    return boxed.select("doc_id", "page_no", number.alias("match_no"), F.col("s.match").alias("match"), "llx", F.col("y").alias("lly"), "urx", (F.col("y") + F.col("_size")).alias("ury"))


def on_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, x, y, ...) whose point lies on their page's box."""
    box = pages.select("doc_id", "page_no", F.col("llx").alias("_a"), F.col("lly").alias("_b"), F.col("urx").alias("_c"), F.col("ury").alias("_d"))
    inside = F.col("x").between(F.col("_a"), F.col("_c")) & F.col("y").between(F.col("_b"), F.col("_d"))
    return rows.join(box, ["doc_id", "page_no"]).where(inside).drop("_a", "_b", "_c", "_d")


def _first_of_place(u: pd.Series, v: pd.Series, seq: pd.Series) -> pd.Series:
    """For lists of places in steps, whether no place that is kept before one lies within a step of it.

    Places that are kept are known by their cell of one step, so each is compared with those of nine cells.
    """

    def one(xs, ys, order):
        cells, kept = {}, [True] * len(xs)
        for i in sorted(range(len(xs)), key=lambda i: (order[i] is None, order[i])):
            x, y = xs[i], ys[i]
            if x is None or y is None or not (math.isfinite(x) and math.isfinite(y)):
                continue
            a, b = math.floor(x), math.floor(y)
            if any(abs(x - p) <= 1 and abs(y - q) <= 1 for j in (a, a - 1, a + 1) for k in (b, b - 1, b + 1) for p, q in cells.get((j, k), ())):
                kept[i] = False
            else:
                cells.setdefault((a, b), []).append((x, y))
        return kept

    return pd.Series([one(x.tolist(), y.tolist(), s.tolist()) for x, y, s in zip(u, v, seq)])


def without_shadows(runs: DataFrame, offset: float = 0.2) -> DataFrame:
    """Text runs but for those that repeat a text of their page at nearly its place (within ``offset`` sizes): shadows and bold by double printing.

    Of equal runs the one that is drawn first stays, whatever is drawn between them.
    """
    rows = runs.groupBy("doc_id", "page_no", "text", "size").agg(F.collect_list(F.struct(*runs.columns)).alias("_r"))
    step = F.when(F.col("size").isNotNull(), F.greatest(F.abs("size") * offset, F.lit(1e-9)))
    kept = F.pandas_udf(_first_of_place, "array<boolean>")(F.transform("_r", lambda r: r["x"] / step), F.transform("_r", lambda r: r["y"] / step), F.transform("_r", lambda r: r["seq"]))
    marked = rows.withColumn("_k", kept).select(F.filter(F.arrays_zip("_r", "_k"), lambda z: z["_k"]).alias("_z"))
    return marked.select(F.inline(F.transform("_z", lambda z: z["_r"])))
