"""Tables and paragraphs from placed text; one page is one unit of work, and its size is bounded by the page.

Rules are thin boxes.  Collinear rules merge, crossing ones form a lattice, its positions cluster to
boundaries, and a text belongs to the cell that holds its centre.  Paragraphs come from lines by
gaps, indents and short lines; blocks are read in the order of recursive cuts.
"""

from __future__ import annotations

import bisect
import statistics
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import batches

#: Tolerances in points (fixed values): distance and gap of collinear rules, positions of one boundary, thickness of a rule, lower edges of one level.
ALIGN, GAP, EDGE, THIN, LEVEL = 0.6, 1.5, 6.0, 3.0, 2.0


class Run(NamedTuple):
    text: str
    x: float
    y: float
    w: float
    size: float


def _placed(runs: DataFrame) -> tuple[DataFrame, list]:
    """Text runs with the columns of a Run; those without a text or a place are on no page."""
    whole = runs.where(F.expr("text IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"))
    return whole, [F.col("text").cast("string").alias("text"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in Run._fields[1:]]]


def _down(runs: list[tuple]) -> list[Run]:
    """Runs from the top, then from the left."""
    return sorted((Run(*r) for r in runs), key=lambda r: (-r.y, r.x))


def _merged(rules: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(position, from, to) with collinear neighbours as one."""
    out: list[list[float]] = []
    for p, a, b in sorted(rules):
        near = [r for r in out if p - r[0] <= ALIGN and a <= r[2] + GAP and b >= r[1] - GAP]
        if near:
            near[-1][1], near[-1][2] = min(a, near[-1][1]), max(b, near[-1][2])
        else:
            out.append([p, a, b])
    return [tuple(r) for r in out]


def boundaries(values: list[float]) -> list[float]:
    """Means of sorted values that chain within the edge tolerance."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= EDGE:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [sum(g) / len(g) for g in groups]


def lattices(boxes: list[tuple[float, float, float, float]], width: float, height: float) -> list[tuple[list[float], list[float]]]:
    """(column edges, row edges from the top) of each ruled table on a page."""
    h, v = [], []
    for llx, lly, urx, ury in boxes:
        if urx - llx >= 0.98 * width and ury - lly >= 0.98 * height:
            continue  # a frame of the page
        if ury - lly <= THIN and urx - llx > THIN:
            h.append(((lly + ury) / 2, llx, urx))
        elif urx - llx <= THIN and ury - lly > THIN:
            v.append(((llx + urx) / 2, lly, ury))
        elif urx - llx > THIN:
            h += [(lly, llx, urx), (ury, llx, urx)]
            v += [(llx, lly, ury), (urx, lly, ury)]
    h, v = _merged(h), _merged(v)
    up = list(range(len(h) + len(v)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    v.sort()
    xs = [x for x, _, _ in v]
    for i, (y, a, b) in enumerate(h):
        for j in range(bisect.bisect_left(xs, a - GAP), bisect.bisect_right(xs, b + GAP)):
            if v[j][1] - GAP <= y <= v[j][2] + GAP:
                up[root(i)] = root(len(h) + j)
    out = []
    for r in sorted({root(i) for i in range(len(up))}):
        ys = boundaries([h[i][0] for i in range(len(h)) if root(i) == r])
        xs = boundaries([v[j][0] for j in range(len(v)) if root(len(h) + j) == r])
        if len(xs) > 1 and len(ys) > 1:
            out.append((xs, ys[::-1]))
    return sorted(out, key=lambda t: (-t[1][0], t[0][0]))


def _cells(runs: list[tuple], boxes: list[tuple]) -> list[tuple]:
    rows = []
    wide, high = (max((b[k] for b in boxes if b[k] is not None), default=d) for k, d in ((4, 612.0), (5, 792.0)))
    centres = [(r.x + r.w / 2, r.y + r.size / 2, r.text) for r in _down(runs)]
    for t, (xs, ys) in enumerate(lattices([b[:4] for b in boxes], wide, high), 1):
        texts: dict[tuple[int, int], list[str]] = {}
        down = [-y for y in ys]
        for cx, cy, text in centres:
            texts.setdefault((bisect.bisect_right(down, -cy) - 1, bisect.bisect_right(xs, cx) - 1), []).append(text)
        for i in range(len(ys) - 1):
            for j in range(len(xs) - 1):
                rows.append((t, i + 1, j + 1, " ".join(texts.get((i, j), ())), xs[j], ys[i + 1], xs[j + 1], ys[i]))
    return rows


_TABLE = "table_no int, row_no int, col_no int, text string, llx double, lly double, urx double, ury double"


def table_cells(runs: DataFrame, paths: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, text, box) of ruled tables, from text runs, path boxes and the pages' boxes (without them: 612 x 792)."""
    size = [F.lit(None).cast("double").alias(c) for c in ("page_width", "page_height")]
    if pages is not None:
        paths = paths.join(pages.select("doc_id", "page_no", (F.col("urx") - F.col("llx")).alias("page_width"), (F.col("ury") - F.col("lly")).alias("page_height")), ["doc_id", "page_no"])
        size = ["page_width", "page_height"]
    boxes = [F.col(c).cast("double").alias(c) for c in ("llx", "lly", "urx", "ury")]
    return batches.per_page([_placed(runs), (paths, [*boxes, *size])], _TABLE, _cells)


def _cuts(blocks: list[tuple], across: bool) -> list[list[tuple]]:
    """Blocks (llx, lly, urx, ury, …) parted at gaps from the top, or from the left; touching extents stay together."""
    lo, hi, sign = (1, 3, -1) if across else (0, 2, 1)
    parts: list[list[tuple]] = []
    edge = None
    for b in sorted(blocks, key=lambda b: -b[hi] if across else b[lo]):
        start, end = (-b[hi], -b[lo]) if across else (b[lo], b[hi])
        if edge is None or start > edge:
            parts.append([])
        parts[-1].append(b)
        edge = end if edge is None else max(edge, end)
    return parts


def reading_order(blocks: list[tuple]) -> list[tuple]:
    """Blocks by recursive cuts: gaps across the page first, then down it; what cannot be cut, by its lower edge from the top, then from the left."""
    for across in (True, False):
        parts = _cuts(blocks, across)
        if len(parts) > 1:
            return [b for p in parts for b in reading_order(p)]
    return _level(sorted(blocks, key=lambda b: (-b[1], b[0])))


def _level(blocks: list[tuple]) -> list[tuple]:
    """Blocks from the top, those whose lower edges are within the tolerance of the first of their level from the left."""
    out: list[list[tuple]] = []
    for b in blocks:
        if out and out[-1][0][1] - b[1] <= LEVEL:
            out[-1].append(b)
        else:
            out.append([b])
    return [b for level in out for b in sorted(level, key=lambda b: b[0])]


def paragraphs(lines: list[tuple[float, float, float, float, str]], size: float) -> list[str]:
    """Texts of paragraphs from lines (x, y, right, size, text) of one block, from the top.

    A line begins a paragraph if it is far below the last, or begins with a capital or a number and is
    indented, numbered, or follows a short line.
    """
    out: list[list[str]] = []
    last = None
    right = max((x[2] for x in lines), default=0.0)
    left = min((x[0] for x in lines), default=0.0)
    for x in lines:
        text = x[4].strip()
        lead = text[:1].isupper() or text[:1].isdigit()
        numbered = text[:1].isdigit() and text.lstrip("0123456789")[:1] in (".", ")")
        fresh = last is None or last[1] - x[1] > 1.8 * size or (lead and (x[0] - left > size or numbered or right - last[2] > 3.5 * size))
        if fresh:
            out.append([])
        out[-1].append(text)
        last = x
    return [" ".join(p) for p in out]


def page_paragraphs(runs: DataFrame) -> DataFrame:
    """(doc_id, page_no, para_no, text) of text runs."""

    def page(rows: list[tuple]) -> list[tuple]:
        lines: list[list] = []
        for x in _down(rows):
            if lines and abs(lines[-1][1] - x.y) <= min(max(2.0, 0.01 * abs(x.y)), x.size / 2) and x.x - lines[-1][2] <= 3 * x.size:
                gap = " " if x.x - lines[-1][2] > 0.2 * x.size else ""
                lines[-1][2], lines[-1][4] = x.x + x.w, lines[-1][4] + gap + x.text
            else:
                lines.append([x.x, x.y, x.x + x.w, x.size, x.text])
        size = statistics.median(x[3] for x in lines) if lines else 12.0
        blocks = [(x[0], x[1] - 0.6 * size, x[2], x[1] + size, x) for x in lines]
        return list(enumerate((t for c in _cuts(blocks, False) for t in paragraphs([b[4] for b in reading_order(c)], size)), 1))

    return batches.per_page([_placed(runs)], "para_no int, text string", page)


#: A text line's tolerance in points and the gap between cells in sizes (fixed values) of tables without rules, and their least rows.
LINE, CELL, ROWS = 2.0, 0.5, 2


def _flow_lines(runs: list[tuple]) -> list[list[list]]:
    """Lines of cells [x1, x2, y, top, texts] from the top: runs parted by more than half a size."""
    lines: list[list] = []
    for r in _down([r for r in runs if r[0].strip()]):
        if not lines or abs(lines[-1][0].y - r.y) > LINE:
            lines.append([])
        lines[-1].append(r)
    out = []
    for line in lines:
        size = max(r.size if r.size > 0 else 12.0 for r in line)
        cells: list[list] = []
        for r in sorted(line, key=lambda r: r.x):
            if not cells or r.x - cells[-1][1] > CELL * size:
                cells.append([r.x, r.x + r.w, r.y, r.y + r.size, []])
            c = cells[-1]
            c[1], c[2], c[3] = max(c[1], r.x + r.w), min(c[2], r.y), max(c[3], r.y + r.size)
            c[4].append(r.text)
        out.append(cells)
    return out


def _bridged(columns: list[tuple[float, float]], cells: list[list]) -> list[tuple[float, float]]:
    """The columns widened by cells: overlapping extents are one."""
    out: list[list[float]] = []
    for a, b in sorted([*columns, *((c[0], c[1]) for c in cells)]):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def flow_tables(runs: list[tuple]) -> list[tuple[list[tuple[float, float]], list[list[list]]]]:
    """(columns, rows of cells) of tables that alignment alone shows: lines of two cells or more, at least half of them in known columns.

    A line with fewer than half as many cells as there are columns continues the row above it.
    """
    meets = lambda c, columns: any(c[1] > a and c[0] < b for a, b in columns)
    found, columns, rows = [], [], []

    def close():
        if len(rows) >= ROWS:
            found.append((columns, rows))

    for cells in [*_flow_lines(runs), []]:
        sparse = bool(rows) and len(cells) >= 2 and 2 * len(cells) < len(columns)
        if len(cells) < 2 or (rows and not sparse and 2 * sum(meets(c, columns) for c in cells) < len(cells)):
            close()
            columns, rows = [], []
            if len(cells) < 2:
                continue
        if sparse:
            rows[-1] += cells
        else:
            rows.append(list(cells))
        columns = _bridged(columns, cells)
    return found


def borderless_cells(runs: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, text, llx, lly, urx, ury) of tables without rules, from text runs."""

    def page(rows_: list[tuple]) -> list[tuple]:
        out = []
        for t, (columns, rows) in enumerate(flow_tables(rows_), 1):
            for i, row in enumerate(rows, 1):
                bottom, top = min(c[2] for c in row), max(c[3] for c in row)
                for j, (a, b) in enumerate(columns, 1):
                    inside = sorted((c for c in row if c[1] > a and c[0] < b), key=lambda c: (-c[3], c[0]))
                    if inside:
                        out.append((t, i, j, " ".join(x for c in inside for x in c[4]).strip(), min(c[0] for c in inside), bottom, max(c[1] for c in inside), top))
        return out

    return batches.per_page([_placed(runs)], _TABLE, page)


def outside_tables(rows: DataFrame, cells: DataFrame, tables: list[int] | None = None) -> DataFrame:
    """Text runs or path boxes that no cell of the tables (all, or those of some numbers) holds: a page without its tables."""
    cells = cells.select(*[F.col(c).alias(c) for c in cells.columns])
    chosen = cells.where(F.col("table_no").isin(tables)) if tables else cells
    box = chosen.groupBy("doc_id", "page_no", "table_no").agg(F.min("llx").alias("_a"), F.min("lly").alias("_b"), F.max("urx").alias("_c"), F.max("ury").alias("_d")).withColumnsRenamed({"doc_id": "_doc", "page_no": "_page"}).drop("table_no")
    x, y = (F.col("x") + F.col("w") / 2, F.col("y") + F.col("size") / 2) if "x" in rows.columns else ((F.col("llx") + F.col("urx")) / 2, (F.col("lly") + F.col("ury")) / 2)
    inside = (F.col("doc_id") == F.col("_doc")) & (F.col("page_no") == F.col("_page")) & x.between(F.col("_a"), F.col("_c")) & y.between(F.col("_b"), F.col("_d"))
    return rows.join(box, inside, "left_anti")


def headings(runs: DataFrame) -> DataFrame:
    """Text runs with ``tag``: the size that most characters of a document have is P, larger sizes are H1 to H6 from the largest."""
    sizes = runs.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("_chars"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("_chars", -F.col("size"))).alias("_body"))
    large = sizes.join(body, "doc_id").where("size > _body").withColumn("_rank", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.desc("size"))))
    ranked = large.select("doc_id", "size", F.least(F.col("_rank"), F.lit(6)).alias("_rank"))
    return runs.join(ranked, ["doc_id", "size"], "left").withColumn("tag", F.when(F.col("_rank").isNull(), "P").otherwise(F.concat(F.lit("H"), F.col("_rank").cast("string")))).drop("_rank")
