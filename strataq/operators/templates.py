"""Templates and variables of text lines, dictionaries of them, and rendering back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_seen

HOLE = "\x00"
#: What becomes a hole, per line format; explicit classes only, so that regex dialects agree.
HOLES = {
    "numbers": '("[^"]*"|[0-9]+)',
    "nginx": r'(^[^ ]+|\[[^\]]*\]|"[^"]*"|[0-9]+)',
    "apache": r"([^ ]+)",
    "syslog": r'(\[[^\]]*\]|"[^"]*"|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(?:Z|[+-][0-9:]+)?|[A-Z][a-z]{2} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{1,3}(?:[.][0-9]{1,3}){3}|[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}|[0-9]+)',
    "sql": r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|0[xX][0-9a-fA-F]+|[+-]?[0-9]+(?:[.][0-9]+)?|[Nn][Uu][Ll][Ll])""",
    "k8s": r'("(?:[^"\\]|\\.)*"|-?[0-9]+(?:[.][0-9]+)?)',
}


def template(line: Column, form: str = "numbers") -> Column:
    return F.regexp_replace(line, HOLES[form], HOLE)


def variables(line: Column, form: str = "numbers") -> Column:
    return F.regexp_extract_all(line, F.lit(HOLES[form]))


def render(template: Column, variables: Column) -> Column:
    """The line again: fixed parts and variables in turn."""
    parts = F.split(template, HOLE, -1)
    return F.array_join(F.zip_with(parts, F.concat(variables, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def with_template(df: DataFrame, line: str = "line", form: str = "numbers") -> DataFrame:
    """``df`` with template and variables. A line that holds the hole character stays whole, as raw."""
    raw = F.contains(F.col(line), F.lit(HOLE))
    return df.withColumns({"raw": raw, "template": F.when(raw, F.col(line)).otherwise(template(F.col(line), form)), "variables": F.when(raw, F.array().cast("array<string>")).otherwise(variables(F.col(line), form))})


def rendered() -> Column:
    return F.when(F.col("raw"), F.col("template")).otherwise(render(F.col("template"), F.col("variables")))


def dictionary(df: DataFrame, order: str, key: str = "template", name: str = "template_id") -> DataFrame:
    return first_seen(df, [key], order, name)


def variable_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per variable: kept columns, place, value."""
    return df.select(*keep, F.posexplode("variables").alias("place", "value"))
