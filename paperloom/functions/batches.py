"""Arrow batches of a bounded size, and pages as rows of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that a Python worker is sent; what it makes of them is several times that.
BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession | None = None) -> None:
    """Bounds the session's Arrow batches by bytes, unless they are smaller already: a number of rows bounds no memory."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT))
        if now <= 0 or now > BYTES:
            spark.conf.set(_LIMIT, BYTES)


def _lists(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The structs of each row as tuples."""
    values = column.flatten()
    rows = list(zip(*(f.to_pylist() for f in values.flatten())))
    at = 0
    for n in column.value_lengths().to_pylist():
        yield rows[at : at + (n or 0)]
        at += n or 0


def per_page(parts: list[tuple[DataFrame, list[Column]]], schema: str, page: Callable[..., list[tuple]]) -> DataFrame:
    """(doc_id, page_no, schema) of what a function makes of each page's rows of one or more relations, as lists of tuples.

    A page is one row, so that a worker has many in a batch and no call of its own for each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded(parts[0][0].sparkSession)
    names = [f"_{i}" for i in range(len(parts))]
    each = [df.select("doc_id", "page_no", F.struct(*columns).alias(n)) for n, (df, columns) in zip(names, parts)]
    rows = each[0]
    for one in each[1:]:
        rows = rows.unionByName(one, allowMissingColumns=True)
    pages = rows.groupBy("doc_id", "page_no").agg(*[F.collect_list(n).alias(n) for n in names])
    pages = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), *names)
    whole = f"doc_id string, page_no int, {schema}"
    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], whole).schema)

    def run(batches):
        for b in batches:
            out = []
            for doc, number, *lists in zip(b.column("doc_id").to_pylist(), b.column("page_no").to_pylist(), *(_lists(b.column(n)) for n in names)):
                out += [(doc, number, *r) for r in page(*lists)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return pages.mapInArrow(run, whole)
