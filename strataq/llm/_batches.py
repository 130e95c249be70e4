"""Run a Python function over (id, text) rows in small Arrow batches.

Memory in a worker is bounded by ``rows`` texts of one slice, whatever the
partition holds. The id column keeps its type; no other input column is read,
so extra columns with any name cannot clash with the outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 256
SLICE_CHARS = 4_000_000


def slices(texts: list[str], rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Half-open row ranges of at most ``rows`` rows and about ``chars`` characters."""
    start = used = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= rows or used + len(t) > chars):
            yield start, i
            start, used = i, 0
        used += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, id_col: str, text_col: str, out: T.StructType, make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """``make()`` runs once per partition; what it returns maps texts to one list per ``out`` field.

    Null texts arrive as "". The result has the id column and the fields of ``out``.
    """
    source = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text of the batch"))
    schema = T.StructType([source.schema[0], *out.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                columns = f(texts[a:b])
                ids = batch.column(0).slice(a, b - a).cast(arrow[0].type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=x.type) for c, x in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return source.mapInArrow(run, schema)


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside the columns ``more`` of it: columns of ``df`` cannot clash with those of an operator. ``select("row.*")`` undoes it."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
