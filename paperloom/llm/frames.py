"""Small helpers around mapInArrow for operators on one text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import shared


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; one longer row stands alone."""
    col = batch.column(column)
    size, lo, n = 0, 0, len(col)
    for i, v in enumerate(col):
        b = v.as_buffer().size if v.is_valid else 0
        if size and size + b > most:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += b
    if lo < n:
        yield batch.slice(lo, n - lo)


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable], most: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """df with the given columns added by one pass over whole texts.

    ``make()`` runs once in a task and gives a function from a list of texts (null: empty) to one
    list or Arrow array for each field.  A column of df with the name of an added one is replaced.
    """
    shared.fewer_rows_per_batch(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = "_text_of_row"
    inner = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{column}`"].alias(source))
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [x.type for x in to_arrow_schema(T.StructType(fields))]

    def run(batches):
        work = make()
        for whole in batches:
            for b in slices(whole, source, most):
                got = work([x or "" for x in b.column(source).to_pylist()])
                cols = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + cols, names=kept + names)

    return inner.mapInArrow(shared.tidy(run), schema)
