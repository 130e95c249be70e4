"""The query language: text -> predicate -> Column, and the greps built on it.

Forms: ``word`` (substring in any column), ``"quoted text"``, ``name=value``,
``name!=value``, ``name>value`` (also >=, <, <=), ``regex:pattern`` and
``name~pattern``. Values are cast to the type of the column, so the comparison
reaches the Parquet scan; a value that does not fit matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encode import SUFFIX, iso_seconds

WHOLE, REAL = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
MODES = ("contains", "equals", "regex", "compat")


@dataclass(frozen=True)
class Predicate:
    kind: str  # contains, regex, compare
    value: str
    column: str | None = None
    operator: str = "="


def parse(query: str) -> Predicate:
    query = query.strip()
    if query.startswith("regex:"):
        return Predicate("regex", query[6:])
    if len(query) >= 2 and query[0] == query[-1] == '"':
        return Predicate("contains", query[1:-1])
    if m := re.fullmatch(r"([A-Za-z_][\w.]*)\s*(>=|<=|!=|=|>|<|~)\s*(.*)", query, re.S):
        value = m[3].strip().strip('"')
        return Predicate("regex" if m[2] == "~" else "compare", value, m[1], m[2])
    return Predicate("contains", query)


def typed(value: str, kind: str) -> Column:
    """The literal in the type of a column; null if it does not fit. Folded by the optimizer."""
    return F.lit(value) if kind == "string" else F.lit(value).try_cast(kind)


def compare(c: Column, operator: str, value: Column) -> Column:
    return {"=": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[operator]


def text_of(c: Column, kind: str) -> Column:
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def any_column(df: DataFrame, query: str, mode: str = "contains", profile: dict[str, str] | None = None) -> Column:
    """One predicate over all columns. Modes: contains and equals by caller's choice; compat decides by the encoding of each column.

    compat needs ``profile`` (column -> mode of encoding_profile): whole numbers compare
    equal, numbered strings by number behind the prefix, times by second, dictionary
    columns as whole values, others by substring; float columns never match.
    """
    tests: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if mode == "regex":
            if kind == "string":
                tests.append(c.rlike(query))
        elif mode == "equals" or mode == "contains" and kind in (*WHOLE, *REAL):
            if kind == "string":
                tests.append(c == query)
            elif fits(query, kind):
                tests.append(c == typed(query, kind))
        elif mode == "contains":
            if kind == "string" or kind.startswith(("array", "map", "struct")):
                tests.append(text_of(c, kind).contains(query))
        else:
            tests += compat_test(c, kind, query, (profile or {}).get(name, "raw"))
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests), F.lit(False)) if tests else F.lit(False)


def fits(value: str, kind: str) -> bool:
    """Whether a column of this type can equal the value at all: decides at plan time which columns are read."""
    try:
        if kind in WHOLE:
            int(value)
        elif kind in REAL:
            float(value)
        else:
            return kind == "string" or kind.startswith(("timestamp", "date", "decimal", "boolean"))
    except ValueError:
        return False
    return True


def compat_test(c: Column, kind: str, query: str, encoding: str) -> list[Column]:
    if encoding == "delta_int":
        return [c == typed(query, kind)] if fits(query, kind) else []
    if encoding == "suffix":
        m = re.match(SUFFIX, query)
        return [(F.regexp_extract(c, SUFFIX, 1) == m[1]) & (F.regexp_extract(c, SUFFIX, 2).cast("decimal(38,0)") == int(m[2]))] if m else []
    if encoding == "iso":
        return [iso_seconds(c) == iso_seconds(F.lit(query))]
    if encoding in ("dict1", "dict2"):
        return [c == query]
    if encoding in ("float64", "empty"):
        return []
    return [text_of(c, kind).contains(query)]


def where(df: DataFrame, query: str) -> DataFrame:
    """Rows that match a query of the language above."""
    p = parse(query)
    if p.column is None:
        return df.where(any_column(df, p.value, "regex" if p.kind == "regex" else "contains"))
    kinds = dict(df.dtypes)
    if p.column not in kinds:
        raise ValueError(f"no column {p.column}")
    c = F.col(f"`{p.column}`")
    return df.where(c.rlike(p.value) if p.kind == "regex" else compare(c, p.operator, typed(p.value, kinds[p.column])))


def search(df: DataFrame, query: str, mode: str = "contains", row_id: str | None = None, profile: dict[str, str] | None = None) -> DataFrame:
    """Matching rows; only the row ids in order if ``row_id`` is named. An unknown mode raises."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    found = df.where(any_column(df, query, mode, profile))
    return found.select(row_id).orderBy(row_id) if row_id else found


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("__at", "line")).select(key, (F.col("__at") + 1).alias("line_no"), "line")


def grep(df: DataFrame, key: str, text: str, query: str, limit: int | None = None, ignore_case: bool = True) -> DataFrame:
    """Lines that hold the query. Whole texts are tested before they are cut into lines."""
    test = lambda c: F.lower(c).contains(query.lower()) if ignore_case else c.contains(query)
    found = lines(df.where(test(F.col(text))), key, text).where(test(F.col("line")))
    return found.orderBy(key, "line_no").limit(limit) if limit else found


def occurrences(c: Column, query: str) -> Column:
    """Non-overlapping, case-sensitive."""
    size = len(query)
    return ((F.length(c) - F.length(F.replace(c, F.lit(query), F.lit("")))) / size).cast("long") if size else F.lit(0).cast("long")


def grep_context(df: DataFrame, key: str, text: str, query: str, around: int) -> DataFrame:
    """Hit lines and ``around`` lines on each side, within a text."""
    hit = F.col("line").contains(query)
    window = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    rows = lines(df.where(F.col(text).contains(query)), key, text).withColumn("hit", hit)
    return rows.withColumn("near", F.max("hit").over(window)).where("near").select(key, "line_no", "line", "hit")


def matches_json(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """One JSON object per hit line: offset, id and payload."""
    return grep(df, key, text, query, ignore_case=False).select(F.to_json(F.struct(F.col("line_no").alias("offset"), F.col(key).alias("id"), F.col("line").alias("payload"))).alias("json"))


def quality(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """true_positive, false_positive, false_negative, exact of two sets of ids."""
    both = found.select(key).distinct().withColumn("__f", F.lit(1)).join(truth.select(key).distinct().withColumn("__t", F.lit(1)), key, "full_outer")
    count = lambda test: F.count(F.when(test, 1))
    f, t = F.col("__f").isNotNull(), F.col("__t").isNotNull()
    return both.agg(count(f & t).alias("true_positive"), count(f & ~t).alias("false_positive"), count(~f & t).alias("false_negative")).withColumn("exact", (F.col("false_positive") == 0) & (F.col("false_negative") == 0))
