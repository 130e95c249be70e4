"""Line archives: templates, lines and variables as three tables, or patterns and lines as two; written, searched and restored.

A template archive keeps each distinct template once, each line as the id of its
template, and its variables in one row per (line, place), so equal places of one
template lie together in columns. A pattern archive keeps each distinct line
once and the id of each line. Both give back all lines exactly, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_seen
from ..operators.templates import render, with_template
from .archive import LEVELS, CorruptArchive


def _store(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVELS[mode])).parquet(path)


def write_templates(df: DataFrame, path: str, order: str, line: str = "line", form: str = "numbers", mode: str = "fast") -> None:
    """``order``: unique whole numbers. Lines without a template of their own (raw) are templates without variables."""
    spark = df.sparkSession
    rows = with_template(df.select(F.col(order).cast("long").alias("line_no"), F.col(line).alias("line")), "line", form)
    _store(first_seen(rows, ["template", "raw"], "line_no", "template_id").select("template_id", "template", "raw", "n"), f"{path}/templates", mode)
    ids = spark.read.parquet(f"{path}/templates")
    known = rows.join(ids.select("template", "raw", "template_id"), (rows["template"].eqNullSafe(ids["template"])) & (rows["raw"].eqNullSafe(ids["raw"])), "left").select("line_no", "template_id", "variables")
    _store(known.select("line_no", "template_id").sortWithinPartitions("line_no"), f"{path}/lines", mode)
    held = known.select("template_id", "line_no", F.posexplode("variables").alias("place", "value"))
    _store(held.repartition("template_id", "place", F.floor(F.col("line_no") / 65536)).sortWithinPartitions("template_id", "place", "line_no"), f"{path}/vars", mode)


def read_templates(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """line_no and line; ``where`` may test line_no and template_id before variables are read."""
    lines, templates, held = (spark.read.parquet(f"{path}/{t}") for t in ("lines", "templates", "vars"))
    lines = lines.where(where) if where is not None else lines
    values = held.join(lines.select("line_no"), "line_no", "left_semi") if where is not None else held
    variables = values.groupBy("line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("variables"))
    rows = lines.join(templates.select("template_id", "template", "raw"), "template_id", "left").join(variables, "line_no", "left")
    nothing = F.array().cast("array<string>")
    return rows.select("line_no", F.when(F.col("raw"), F.col("template")).otherwise(render(F.col("template"), F.coalesce("variables", nothing))).alias("line"))


def write_patterns(df: DataFrame, path: str, order: str, line: str = "line", mode: str = "fast") -> None:
    rows = df.select(F.col(order).cast("long").alias("line_no"), F.col(line).alias("line"))
    _store(first_seen(rows, ["line"], "line_no", "pattern_id").select("pattern_id", "line", "n"), f"{path}/patterns", mode)
    patterns = df.sparkSession.read.parquet(f"{path}/patterns")
    known = rows.join(patterns.select(F.col("line").alias("pattern"), "pattern_id"), F.col("line").eqNullSafe(F.col("pattern")), "left")
    _store(known.select("line_no", "pattern_id").sortWithinPartitions("line_no"), f"{path}/lines", mode)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    lines, patterns = spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/patterns")
    return lines.join(patterns.select("pattern_id", "line"), "pattern_id", "left").select("line_no", "line")


def grep_patterns(spark: SparkSession, path: str, query: str) -> DataFrame:
    """line_no and line of the lines that hold the query: each distinct line is tested once."""
    found = spark.read.parquet(f"{path}/patterns").where(F.col("line").contains(query)).select("pattern_id", "line")
    return spark.read.parquet(f"{path}/lines").join(found, "pattern_id").select("line_no", "line")


def verify_lines(given: DataFrame, restored: DataFrame, order: str, line: str = "line") -> int:
    """How many lines came back; raises CorruptArchive if one is missing, new or changed."""
    both = given.select(F.col(order).cast("long").alias("line_no"), F.struct(F.col(line)).alias("a")).join(restored.select("line_no", F.struct("line").alias("b")), "line_no", "full_outer")
    n, wrong = both.agg(F.count(F.lit(1)), F.count(F.when(F.col("a").isNull() | F.col("b").isNull() | ~F.col("a")[line].eqNullSafe(F.col("b")["line"]), 1))).first()
    if wrong:
        raise CorruptArchive(f"{wrong} of {n} lines differ")
    return n
