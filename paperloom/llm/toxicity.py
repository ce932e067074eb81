"""Toxicity by cumulative-link ordinal regression: P(grade <= k) = s(t_k - w.x), one w for all ordered thresholds t.

Features are hashed: words of letters (A-Z in lower case) and their first four and five bytes, present
or not.  The model is fitted on a bounded sample of the labelled rows, those of least hash of their id
(``SAMPLE``); features that at least ``LEAST_DF`` of its texts have and that toxic texts have twice as
often or half as often as the others are kept, the ``FEATURES`` most significant.  Labels say toxic or
not; toxic training texts get grades 1 to 3 by thirds of their number of distinct markers, features
that toxic texts have eight times as often.  The result is the expected grade (severity).

Null and empty texts have no features.  Rows without a label, with a null label or without a text are
not learned from; an id with contradicting labels is toxic; without both kinds of labels, as with empty
tables, the severity of all is 0 and nothing is rejected.  Repeated rows repeat.  Of several texts under
one id that of least hash is learned from, and each is graded.  Columns with the names of the added ones are replaced; other
columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import counts, shared
from .counts import U
from .frames import slices
from .tokens import LETTERS, word_hashes

#: FEATURES must be below 2**16.
SAMPLE, FEATURES, LEAST_DF, GRADES = 20_000, 5_000, 5, 4
_PREFIXES = (4, 5)
_PIECE = 2 << 20


def _all(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and prefix; the lowest bit of a feature is 0, and shorter words' prefixes are 0."""
    h, _, _, at = word_hashes(col, LETTERS, _PREFIXES)
    return np.repeat(np.repeat(np.arange(len(at) - 1), np.diff(at)), h.shape[1]), h.ravel() & ~U(1)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct features of each row."""
    row, f = _all(col)
    row, f = row[f != 0], f[f != 0]
    order = np.lexsort((f, row))
    row, f = row[order], f[order]
    first = np.concatenate([[True], (f[1:] != f[:-1]) | (row[1:] != row[:-1])]) if len(f) else np.zeros(0, bool)
    return row[first], f[first]


def _match(col: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct features of each row that are in the sorted array."""
    row, f = _all(col)
    pos = np.minimum(np.searchsorted(known, f), len(known) - 1)
    keep = known[pos] == f
    code = np.unique(row[keep] * np.int64(len(known)) + pos[keep])
    return code // len(known), code % len(known)


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, rows: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """P(grade = k) for each row."""
        s = np.bincount(row, weights=self.weights[col], minlength=rows) if len(row) else np.zeros(rows)
        upto = _sigmoid(self.thresholds[None, :] - s[:, None])
        return np.diff(np.concatenate([np.zeros((rows, 1)), upto, np.ones((rows, 1))], axis=1), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_ordinal(rows: int, row: np.ndarray, col: np.ndarray, grade: np.ndarray, size: int, grades: int, penalty: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient steps with adaptive rates; thresholds rise by the exponential of free gaps."""
    share = np.clip(np.array([(grade <= k).mean() for k in range(grades - 1)]), 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:size], p[size] + np.concatenate([[0.0], np.cumsum(np.exp(p[size + 1 :]))])
        s = np.bincount(row, weights=w[col], minlength=rows)
        high = np.where(grade < grades - 1, _sigmoid(t[np.minimum(grade, grades - 2)] - s), 1.0)
        low = np.where(grade > 0, _sigmoid(t[np.maximum(grade - 1, 0)] - s), 0.0)
        chance = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / chance, low * (1 - low) / chance
        ds = (dh - dl) / rows
        dt = np.array([(-dh[grade == k].sum() + dl[grade == k + 1].sum()) / rows for k in range(grades - 1)])
        grad = np.concatenate([np.bincount(col, weights=ds[row], minlength=size) + penalty * w, [dt.sum()], [dt[k:].sum() * np.exp(p[size + k]) for k in range(1, grades - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], p[size] + np.concatenate([[0.0], np.cumsum(np.exp(p[size + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, column: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    """The model of labelled documents; None without both kinds of labels."""
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("toxic")).where("k IS NOT NULL AND toxic IS NOT NULL")
    chosen = marked.groupBy("k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    # SAMPLE rows of two numbers at most: every worker can hold them, and no text is moved to find its label
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "k").groupBy("k").agg(F.first("toxic").alias("toxic"), F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    rows = shared.write_table(rows, shared.run_folder(docs.sparkSession, "toxicity"), "sample")

    def tally(batches):
        held, size = [], 0

        def flush():
            f, n = np.unique(np.concatenate(held), return_counts=True)
            toxic = (f & U(1)).astype(bool)
            return pa.RecordBatch.from_arrays([pa.array((f >> U(1)).astype(np.int64)), pa.array(np.where(toxic, n, 0)), pa.array(np.where(toxic, 0, n))], names=["f", "pos", "neg"])

        for whole in batches:
            for b in slices(whole, "t", _PIECE):
                row, f = features(b.column("t"))
                held.append(f | (np.array(b.column("toxic"))[row] > 0).astype(U))
                size += len(f)
                if size > counts.FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    total = rows.select("k", "toxic").groupBy().agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = total.pos, total.n - total.pos
    if not pos or not neg:
        return None
    table = rows.mapInArrow(shared.tidy(tally), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DF)
    a, b = (F.col("a") + 0.5) / (pos + 1), (F.col("b") + 0.5) / (neg + 1)
    mean = (F.col("a") + F.col("b") + 1) / (pos + neg + 2)
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg))
    best = table.select("f", (a / b).alias("ratio"), z.alias("z")).where(((F.col("ratio") >= 2) | (F.col("ratio") <= 0.5)) & (F.col("z") >= 3)).orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    if not best:
        return None
    known = np.array([r.f for r in best], np.int64).astype(U) << U(1)
    order = np.argsort(known)
    known, marker = known[order], np.array([r.ratio >= 8 for r in best])[order]

    def rows_of(batches):
        for whole in batches:
            for b in slices(whole, "t", _PIECE):
                row, col = _match(b.column("t"), known)
                own = [x.astype("<u2").tobytes() for x in np.split(col, np.searchsorted(row, np.arange(1, len(b))))]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("toxic"), pa.array(own, pa.binary())], names=["k", "toxic", "cols"])

    got = rows.mapInArrow(shared.tidy(rows_of), "k long, toxic int, cols binary").toArrow()  # SAMPLE rows, FEATURES numbers of two bytes each at most
    sample = sorted(zip(*(got.column(c).to_pylist() for c in ("k", "cols", "toxic"))))
    size = np.array([len(cols) // 2 for _, cols, _ in sample])
    row, col = np.repeat(np.arange(len(sample)), size), np.frombuffer(b"".join(cols for _, cols, _ in sample), "<u2").astype(np.int64)
    toxic = np.array([t > 0 for _, _, t in sample])
    marks = np.bincount(row, weights=marker[col], minlength=len(sample)) if len(col) else np.zeros(len(sample))
    third = np.quantile(marks[toxic], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    grade = np.where(toxic, 1 + (marks > third[0]).astype(int) + (marks > third[1]), 0)
    weights, thresholds = fit_ordinal(len(sample), row, col, grade, len(known), GRADES)
    return Model(known, weights, thresholds)


def grade(docs: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """docs with severity (expected grade), p_toxic, grade (the likeliest) and rejected (p_toxic over a half)."""
    added = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
    shared.fewer_rows_per_batch(docs.sparkSession)
    kept = [c for c in docs.columns if c not in [a.name for a in added]]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches):
        for whole in batches:
            for b in slices(whole, column, _PIECE):
                n = len(b)
                if model is None:
                    p = np.tile(np.eye(GRADES)[0], (n, 1))
                else:
                    p = model.probabilities(n, *_match(b.column(column), model.known))
                toxic = 1 - p[:, 0]
                cols = [pa.array(p @ np.arange(GRADES)), pa.array(toxic), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic > 0.5)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + cols, names=schema.names)

    return docs.select(*[docs[f"`{c}`"] for c in kept]).mapInArrow(shared.tidy(run), schema)
