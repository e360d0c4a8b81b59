"""Row-wise Python work in Arrow batches that carries the other columns along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Rows of text that a task holds at once, at most; the session's setting counts where it is lower.
BATCH_ROWS = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c):
    """The column with A-Z lower-cased and every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def append(df: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]], make: Callable[[], Callable]) -> DataFrame:
    """df with a column for each of fields, in a pass without a shuffle.

    make() is called once in each task and gives a function from the inputs' values (lists) to the fields' values
    (lists). A column of df named as one of fields is replaced. The session's Arrow batches are cut to BATCH_ROWS, as
    rows of these tables are whole texts.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(size)) <= BATCH_ROWS:
        df.sparkSession.conf.set(size, BATCH_ROWS)
    names = {n for n, _ in fields}
    use = [df[c].alias(f"__in{i}") for i, c in enumerate(inputs)]
    keep = [c for c in df.columns if c not in names]
    wide = df.select(*[F.col(f"`{c}`") for c in keep], *use)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    k, types = len(keep), [t for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn, kinds = make(), [to_arrow_type(t) for t in types]
        for batch in batches:
            if batch.num_rows:
                made = fn(*[batch.column(k + i).to_pylist() for i in range(batch.num_columns - k)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:k], *[pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)]],
                    names=[*batch.schema.names[:k], *[f.name for f in schema.fields[k:]]],
                )

    return wide.mapInArrow(run, schema)
