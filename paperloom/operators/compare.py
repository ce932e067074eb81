"""Comparison of page texts and of samples.

A diff is an array of (op, text) with op in equal, delete, insert.  Common ends go first; what is left is
solved by the greedy shortest-edit-script search from both ends, then neighbouring runs are merged, a
common part of a delete and an insert moves into the equal runs beside them, and single edits between
equal runs slide to the left where that swallows one.  Deletes come before inserts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import batches

DIFF = "array<struct<op:string,text:string>>"
EQUAL, DELETE, INSERT = "equal", "delete", "insert"


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that both begin with: a binary search, so each step compares one prefix."""
    n = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftleft", F.lit(1), 30 - i))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def _middle(a: str, b: str) -> tuple[int, int] | None:
    """A point on a shortest edit path, met from both ends; None where nothing is in common."""
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    front, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = front.get(k + 1, 0) if k == -d or (k != d and front.get(k - 1, -1) < front.get(k + 1, -1)) else front.get(k - 1, 0) + 1
            y = x - k
            while x < n and 0 <= y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            front[k] = x
            if delta % 2 and abs(delta - k) < d and x + back.get(delta - k, -1) >= n:
                return x, y
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, 0) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back.get(k - 1, 0) + 1
            y = x - k
            while x < n and 0 <= y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if delta % 2 == 0 and abs(delta - k) <= d and x + front.get(delta - k, -1) >= n:
                return n - x, m - y
    return None


def _solve(a: str, b: str) -> Iterator[tuple[str, str]]:
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        if p:
            yield EQUAL, a[:p]
            a, b = a[p:], b[p:]
        s = 0
        while s < min(len(a), len(b)) and a[-1 - s] == b[-1 - s]:
            s += 1
        if s:
            todo.append((a[len(a) - s :], b[len(b) - s :]))
            a, b = a[: len(a) - s], b[: len(b) - s]
        if not a or not b:
            if a:
                yield DELETE, a
            if b:
                yield INSERT, b
            continue
        longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
        at = longer.find(shorter)
        if at >= 0:  # one holds the other
            op = DELETE if longer is a else INSERT
            yield from ((o, t) for o, t in ((op, longer[:at]), (EQUAL, shorter), (op, longer[at + len(shorter) :])) if t)
            continue
        cut = _middle(a, b)
        if cut is None or cut in ((0, 0), (len(a), len(b))):
            yield DELETE, a
            yield INSERT, b
        else:
            todo += [(a[cut[0] :], b[cut[1] :]), (a[: cut[0]], b[: cut[1]])]


def _merge(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Runs of edits between equal runs as one delete and one insert, their common ends moved to the equal runs."""
    out: list[tuple[str, str]] = []
    gone = new = ""

    def put(op: str, text: str) -> None:
        if text and out and out[-1][0] == op:
            out[-1] = op, out[-1][1] + text
        elif text:
            out.append((op, text))

    for op, text in [*ops, (EQUAL, "")]:
        if op == DELETE:
            gone += text
        elif op == INSERT:
            new += text
        else:
            if gone and new:
                p = 0
                while p < min(len(gone), len(new)) and gone[p] == new[p]:
                    p += 1
                put(EQUAL, gone[:p])
                gone, new = gone[p:], new[p:]
                s = 0
                while s < min(len(gone), len(new)) and gone[-1 - s] == new[-1 - s]:
                    s += 1
                if s:
                    text, gone, new = gone[len(gone) - s :] + text, gone[: len(gone) - s], new[: len(new) - s]
            put(DELETE, gone)
            put(INSERT, new)
            put(EQUAL, text)
            gone = new = ""
    return out


def _moved(kind: str, left: str, edit: str, right: str) -> list[tuple[str, str]] | None:
    """The edit moved over a whole equal run beside it, which the text around it allows; None where it stays."""
    around, n = left + edit + right, len(edit)
    if len(left) <= n and around[n : n + len(left)] == left:
        return [(kind, around[:n]), (EQUAL, around[n:])]
    if len(right) <= n and edit[: len(right)] == right:
        return [(EQUAL, around[:-n]), (kind, around[-n:])]
    return None


def _slide(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Single edits between two equal runs stand where one run is gone, if they can be moved there."""
    done: list[tuple[str, str]] = []
    for x in ops:
        done.append(x)
        while len(done) > 2 and done[-1][0] == done[-3][0] == EQUAL != done[-2][0]:
            two = _moved(done[-2][0], done[-3][1], done[-2][1], done[-1][1])
            if two is None:
                break
            done[-3:] = two
    return done


def diff_text(a: str | None, b: str | None) -> list[tuple[str, str]]:
    """The normalised diff of two texts; null is empty."""
    ops = list(_solve(a or "", b or ""))
    while True:
        again = _slide(_merge(ops))
        if again == ops:
            return ops
        ops = again


def _diffs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "text": t} for o, t in diff_text(x, y)] for x, y in zip(a, b)])


def diff(a: str | Column, b: str | Column) -> Column:
    """The normalised diff of two text columns, in Arrow batches."""
    batches.bounded()
    return F.pandas_udf(_diffs, DIFF)(a, b)


def rebuild(ops: Column, op: str) -> Column:
    """The source (with delete) or the destination (with insert) of a diff."""
    return F.array_join(F.transform(F.filter(ops, lambda x: x["op"].isin(EQUAL, op)), lambda x: x["text"]), "")


def pair_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, page_no, source, destination): page n with page n; a missing page is empty."""
    left = a.select("doc", "page_no", F.col("text").alias("source"))
    right = b.select("doc", "page_no", F.col("text").alias("destination"))
    return left.join(right, ["doc", "page_no"], "full").select("doc", "page_no", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "destination")])


def text_without(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc, page_no, text): the lines of pages without the runs whose centres lie in excluded boxes (doc, page_no, llx, lly, urx, ury)."""
    from paperloom.operators.search import in_boxes
    from paperloom.sources.pdf import page_text

    centres = runs.withColumnRenamed("doc_id", "doc").withColumns({"_x": F.col("x"), "_y": F.col("y"), "x": F.col("x") + F.col("w") / 2, "y": F.col("y") + F.col("size") / 2})
    kept = in_boxes(centres, boxes, keep=False).withColumns({"x": F.col("_x"), "y": F.col("_y")}).withColumnRenamed("doc", "doc_id")
    return page_text(kept.drop("_x", "_y")).withColumnRenamed("doc_id", "doc")


def flat(df: DataFrame) -> DataFrame:
    """(doc, text): pages in order, joined without a separator."""
    rows = df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))).alias("r"))
    return rows.select("doc", F.array_join(F.transform("r", lambda x: x["t"]), "").alias("text"))


def statistics(ops: Column) -> list[Column]:
    """Characters in all of the source and changed, and numbers of changed runs."""
    of = lambda op: F.filter(ops, lambda x: x["op"] == op)
    chars = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + F.length(y["text"]))
    return [chars(F.filter(ops, lambda x: x["op"] != INSERT)).alias("total_chars"), chars(of(DELETE)).alias("deleted_chars"), chars(of(INSERT)).alias("inserted_chars"), F.size(of(DELETE)).alias("deletions"), F.size(of(INSERT)).alias("insertions")]


def summed(df: DataFrame) -> DataFrame:
    """Statistics of pages, and a row with a null page_no for each document."""
    names = ["total_chars", "deleted_chars", "inserted_chars", "deletions", "insertions"]
    both = df.select("doc", "page_no", *names).unionByName(df.groupBy("doc").agg(*[F.sum(n).alias(n) for n in names]).withColumn("page_no", F.lit(None).cast("int")).select("doc", "page_no", *[F.col(n).cast("int").alias(n) for n in names]))
    return both


def affixes(df: DataFrame) -> DataFrame:
    """Pairs (doc, page_no, source, destination) with the sizes of their common ends and of the middles between."""
    p = common_prefix(F.col("source"), F.col("destination"))
    out = df.withColumn("prefix", p)
    rest = lambda c: F.substring(F.col(c), F.col("prefix") + 1, F.length(c))
    out = out.withColumn("suffix", common_suffix(rest("source"), rest("destination")))
    return out.select("doc", "page_no", "prefix", "suffix", (F.length("source") - F.col("prefix") - F.col("suffix")).alias("source_middle"), (F.length("destination") - F.col("prefix") - F.col("suffix")).alias("destination_middle"))


def markdown(ops: Column) -> Column:
    """A diff as Markdown: deletes struck out, inserts bold."""
    mark = lambda x: F.when(x["op"] == DELETE, F.concat(F.lit("~~"), x["text"], F.lit("~~"))).when(x["op"] == INSERT, F.concat(F.lit("**"), x["text"], F.lit("**"))).otherwise(x["text"])
    return F.array_join(F.transform(ops, mark), "")


def html(ops: Column) -> Column:
    """A diff as HTML with del and ins elements."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = lambda x: F.when(x["op"] == DELETE, F.concat(F.lit("<del>"), esc(x["text"]), F.lit("</del>"))).when(x["op"] == INSERT, F.concat(F.lit("<ins>"), esc(x["text"]), F.lit("</ins>"))).otherwise(F.concat(F.lit("<span>"), esc(x["text"]), F.lit("</span>")))
    return F.array_join(F.transform(ops, mark), "")


def sample(x: Column) -> Column:
    """A number of 0..1 in single precision on the scale of 255, rounded down; the product is rounded to single precision as well."""
    v = x.cast("float") * F.lit(255).cast("float")
    return F.when(F.abs(v) < 1 << 24, F.floor(v).cast("double")).otherwise(v.cast("double"))  # larger ones are whole, or no numbers


def pixel_diff(a: Column, b: Column, threshold: float) -> Column:
    """For each sample of a (0..255): 0 the same, 1 different.  The difference must exceed threshold % of 255; samples beyond the other's end are the same."""
    limit = int(threshold / 100 * 255 + 0.5)
    return F.transform(a, lambda x, i: F.when(F.abs(x - F.get(b, i)) > limit, 1).otherwise(0))


def _tokens(text: str | None, spaces: str) -> list[str]:
    import re

    return re.findall(r"\S+|\s" if spaces == "parse" else r"\S+" if spaces == "ignore" else r"\S+|\s+", text or "")


def side_by_side(a: str | Column, b: str | Column, spaces: str = "normal") -> Column:
    """A diff of words: white space counts as it stands, is left out (ignore), or counts mark by mark (parse)."""
    batches.bounded()

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = _tokens(p, spaces), _tokens(q, spaces)
            names = {t: chr(0xE000 + i if i < 0x1900 else 0x10000 + i) for i, t in enumerate(dict.fromkeys([*p, *q]))}
            back = {c: t for t, c in names.items()}
            join = " " if spaces == "ignore" else ""
            ops = diff_text("".join(names[t] for t in p), "".join(names[t] for t in q))
            out.append([{"op": o, "text": join.join(back[c] for c in t)} for o, t in ops])
        return pd.Series(out)

    return F.pandas_udf(run, DIFF)(a, b)


def json(ops: Column) -> Column:
    """A diff as a JSON array."""
    return F.to_json(ops)
