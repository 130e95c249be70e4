"""Structured Streaming forms: parsers are plain projections and run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import totals
from ..sources.formats import parse


def parsed_stream(stream: DataFrame, form: str, line: str = "value") -> DataFrame:
    return parse(stream, line, form)


def metrics_stream(stream: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", by: str = "engine") -> DataFrame:
    """Totals per window and engine; late rows count until the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), by).agg(*totals())
