"""Column statistics: zone maps, cardinality, chosen encodings, entropy, deltas, sizes, file facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.encode import IPV4, SUFFIX, is_iso
from .ordered import with_previous


def _unpivot(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row of column__field values to one row per column."""
    items = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}__{f}`").alias(f) for f in fields)) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def as_text(column: str, kind: str) -> Column:
    """One text form for bounds of any type; doubles with two decimals."""
    c = F.col(f"`{column}`")
    return F.round(c, 2).cast("decimal(18,2)").cast("string") if kind in ("double", "float") else c.cast("string")


WHOLE, REAL = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
#: Bound columns of a zone map, each exact for its types.
BOUNDS = ("low_long", "high_long", "low_double", "high_double", "low_text", "high_text")


def bound_type(kind: str) -> str | None:
    """Which bound columns a column type fills: long, double, text, or none for types without order."""
    if kind.startswith(("map", "variant", "array", "struct", "binary")):
        return None
    return "long" if kind in WHOLE else "double" if kind in REAL else "text"


def zone_map(df: DataFrame) -> DataFrame:
    """column, type, n, nulls and exact bounds (BOUNDS) of every column, in one pass.

    Whole numbers have long bounds, floats double ones, strings, times, booleans
    and decimals their text; the others of a row are null, all of them for types
    without order.
    """
    aggregates = []
    for c, kind in df.dtypes:
        v, own = F.col(f"`{c}`"), bound_type(kind)
        aggregates += [F.count(F.lit(1)).alias(f"{c}__n"), F.count(F.when(v.isNull(), 1)).alias(f"{c}__nulls"), F.lit(kind).alias(f"{c}__type")]
        for name in BOUNDS:
            side, form = name.split("_")
            form = {"text": "string", "long": "bigint"}.get(form, form)
            bound = (F.min if side == "low" else F.max)(v).cast(form) if name.endswith(f"_{own}") else F.lit(None).cast(form)
            aggregates.append(bound.alias(f"{c}__{name}"))
    return _unpivot(df.agg(*aggregates), df.columns, ["type", "n", "nulls", *BOUNDS])


def may_hold(zone: dict, value: str) -> bool:
    """Whether a column with this zone (a row of ``zone_map``) can equal ``value``; false only if its bounds rule that out."""
    if zone["n"] == zone["nulls"]:
        return False
    own = bound_type(zone["type"])
    if own not in ("long", "double") or zone[f"low_{own}"] is None:
        return True
    try:
        number = int(value) if own == "long" else float(value)
    except ValueError:
        return False
    low, high = zone[f"low_{own}"], zone[f"high_{own}"]
    return number != number or high != high or low <= number <= high  # NaN orders above all


#: Values that a task holds while distinct ones are counted.
CELLS = 1 << 19


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many distinct values each column has, exactly; null is no value. Runs at once: one number per column.

    All columns are folded together as (column, value). Values are dealt out by
    hash to as many tasks as keep one near CELLS values, first together with a
    part of the row's hash, so that a frequent value is folded in many tasks,
    then alone.
    """
    if not columns:
        return {}
    # Floats as their text, which is one to one: Spark compares others of their forms (zeros, NaN) in another exchange.
    values = {c: (F.col(f"`{c}`") + F.lit(0.0).cast(kind)).cast("string") if kind in REAL else F.col(f"`{c}`") for c, kind in df.dtypes if c in columns}
    kinds = dict(df.select(*(v.alias(c) for c, v in values.items())).dtypes)
    slots = list(dict.fromkeys(kinds[c] for c in columns))
    key = ["column", *(f"v{j}" for j in range(len(slots)))]
    parts = max(1, -(-df.count() * len(columns) // CELLS))
    cells = F.array(*(F.struct(F.lit(k).alias("column"), *((values[c] if kinds[c] == slot else F.lit(None).cast(slot)).alias(f"v{j}") for j, slot in enumerate(slots))) for k, c in enumerate(columns)))
    rows = df.select(F.pmod(F.xxhash64(*values.values()), F.lit(parts)).alias("part"), F.explode(cells).alias("x")).select("part", "x.*").where(reduce(or_, (F.col(v).isNotNull() for v in key[1:])))
    folded = rows.repartition(parts, "part", *key).distinct().select(*key).repartition(parts, *key).distinct()
    found = {r["column"]: r["n"] for r in folded.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(k, 0) for k, c in enumerate(columns)}


def distinct_values(df: DataFrame, columns: list[str], approximate: bool) -> Callable[[str], Column]:
    """The number of distinct values of a column, for use among the aggregates of ``df``."""
    if approximate:
        return lambda c: F.approx_count_distinct(F.col(f"`{c}`"))
    found = distinct_counts(df, columns)
    return lambda c: F.lit(found[c]).cast("long")


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, n, distinct, constant; null is no value."""
    distinct = distinct_values(df, df.columns, approximate)
    aggregates = [a for c in df.columns for a in (F.count(f"`{c}`").alias(f"{c}__n"), distinct(c).alias(f"{c}__distinct"), (F.min(f"`{c}`") == F.max(f"`{c}`")).alias(f"{c}__constant"))]
    return _unpivot(df.agg(*aggregates), df.columns, ["n", "distinct", "constant"])


def encoding_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column and mode: the encoding that the values of a column allow.

    empty, float64, delta_int, suffix (eight values or more, one prefix, a number
    behind, which is a run without gaps or repeats), iso, dict1, dict2, raw, complex.
    """
    distinct_of = distinct_values(df, [c for c, kind in df.dtypes if kind == "string"], approximate)
    aggregates = []
    for c, kind in df.dtypes:
        v = F.col(f"`{c}`")
        some = F.count(v)
        if kind in ("tinyint", "smallint", "int", "bigint"):
            mode = F.when(some == 0, "empty").otherwise("delta_int")
        elif kind in ("float", "double"):
            mode = F.when(some == 0, "empty").otherwise("float64")
        elif kind == "string":
            distinct = distinct_of(c)
            prefix, digits = F.regexp_extract(v, SUFFIX, 1), F.regexp_extract(v, SUFFIX, 2).try_cast("long")
            numbered = (some >= 8) & (F.count(F.when(v.rlike("[0-9]$"), 1)) == some) & (F.min(prefix) == F.max(prefix)) & (F.max(digits) - F.min(digits) == some - 1) & (distinct == some)
            mode = (
                F.when(some == 0, "empty").when(F.coalesce(numbered, F.lit(False)), "suffix").when(F.min(is_iso(v)), "iso").when((distinct < 256) & (some > 10), "dict1").when((distinct < 65536) & (some > 10), "dict2").otherwise("raw")
            )
        else:
            mode = F.when(some == 0, "empty").otherwise("complex")
        aggregates.append(mode.alias(f"{c}__mode"))
    return _unpivot(df.agg(*aggregates), df.columns, ["mode"])


def byte_counts(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """The columns ``by`` and ``counts``, 256 numbers: how often each byte is in the texts of a group.

    Tasks count whole batches with numpy and hand on one row per group and batch, never one per byte.
    """
    by = by or []
    kept = df.select(*by).schema.fields
    schema = T.StructType([*kept, T.StructField("part", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            sums: dict[tuple, np.ndarray] = {}
            for key, raw in zip(keys, batch.column(len(by)), strict=True):
                if raw.is_valid:
                    found = np.bincount(np.frombuffer(raw.as_buffer(), np.uint8), minlength=256)
                    sums[key] = sums[key] + found if key in sums else found
            columns = [pa.array([k[i] for k in sums], arrow.field(i).type) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in sums.values()], arrow.field(len(by)).type)], schema=arrow)

    parts = df.select(*by, F.encode(text, "UTF-8").alias("raw")).mapInArrow(run, schema)
    return parts.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.get("part", F.lit(k))), F.lit(0)) for k in range(256))).alias("counts"))


def byte_entropy(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """Bits per byte of all texts of a group; groups without a byte are left out."""
    by = by or []
    some = F.filter("counts", lambda n: n > 0)
    sums = byte_counts(df, text, by).select(*by, F.aggregate(some, F.lit(0).cast("long"), lambda s, n: s + n).alias("n_bytes"), F.aggregate(some, F.lit(0.0), lambda s, n: s + n * F.log2(n)).alias("logs")).where("n_bytes > 0")
    return sums.select(*by, "n_bytes", F.round(F.log2("n_bytes") - F.col("logs") / F.col("n_bytes"), 6).alias("bits_per_byte"))


def unique_line_ratio(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    lines = df.select(*by, F.explode(F.split(text, "\n", -1)).alias("line")).groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n"))
    return lines.groupBy(*by).agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_unique")).withColumn("ratio", F.round(F.col("n_unique") / F.col("n_lines"), 6))


def delta_distribution(df: DataFrame, order: str, value: str) -> DataFrame:
    """Mean, median and largest absolute delta in ``order`` and the shares that fit one and two bytes."""
    deltas = with_previous(df.select(order, value), order, F.col(value), "__last").where(F.col("__last").isNotNull()).select((F.col(value) - F.col("__last")).alias("d"))
    fits = lambda bits: F.round(F.avg(F.col("d").between(-(1 << bits - 1), (1 << bits - 1) - 1).cast("int")), 6)
    return deltas.agg(F.round(F.avg(F.abs("d")), 6).alias("mean_abs"), F.round(F.median(F.abs("d")).cast("double"), 6).alias("median_abs"), F.max(F.abs("d")).cast("double").alias("max_abs"), fits(8).alias("int8_share"), fits(16).alias("int16_share"))


def column_bytes(df: DataFrame) -> DataFrame:
    """column, bytes of its text form, share of the total."""
    sums = df.agg(*(F.coalesce(F.sum(F.octet_length(as_text(c, kind))), F.lit(0)).alias(f"{c}__bytes") for c, kind in df.dtypes))
    total = sum((F.col(f"`{c}__bytes`") for c in df.columns), F.lit(0))
    return _unpivot(sums.withColumns({f"{c}__share": F.round(F.col(f"`{c}__bytes`") / total, 6) for c in df.columns}), df.columns, ["bytes", "share"])


def file_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Size, lines, newline mode, ASCII or UTF-8, first 16 bytes and SHA-256 of each text."""
    raw = F.encode(text, "UTF-8")
    newline = F.when(F.contains(text, F.lit("\r\n")), "crlf").when(F.contains(text, F.lit("\n")), "lf").otherwise("none")
    return df.select(key, F.octet_length(text).cast("long").alias("n_bytes"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), newline.alias("newline"), F.when(F.length(text) == F.octet_length(text), "ascii").otherwise("utf-8").alias("encoding"), F.hex(F.substring(raw, 1, 16)).alias("magic"), F.sha2(text, 256).alias("sha256"))


NUMBER, SAFE_NUMBER = "^-?[0-9]+$", "^(0|-?[1-9][0-9]*)$"
#: For the string columns of a format, in order of the tests: share of distinct values under which a dictionary pays, what counts as a number, whether addresses are packed.
SMART = {
    "syslog": (0.3, NUMBER, False),
    "sql": (0.2, SAFE_NUMBER, False),
    "vpcflow": (0.2, "^[0-9]+$", True),
    "github": (0.3, None, False),
}


def smart_modes(df: DataFrame, form: str) -> DataFrame:
    """column and mode of each column as text, by the rules of a format: constant, ipv4, dictionary (under 256 values), delta, raw, or empty.

    Numbers with leading zeros or beyond 18 digits, which a delta would not give back, stay raw. Nulls are no values.
    """
    share, number, addresses = SMART[form]
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    distinct_of = distinct_values(texts, df.columns, False)
    aggregates = []
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        n, distinct = F.count(v), distinct_of(c)
        all_are = lambda pattern: F.count(F.when(v.rlike(pattern), 1)) == F.count(v)  # noqa: B023, E731
        mode = F.when(n == 0, "empty").when((n > 1) & (F.min(v) == F.max(v)), "constant")
        if addresses:
            mode = mode.when(all_are(IPV4), "ipv4")
        mode = mode.when((distinct < 256) & (distinct < n * share), "dictionary")
        if number:
            mode = mode.when((n > 1) & all_are(number) & all_are(SAFE_NUMBER) & (F.max(F.length(v)) <= 18), "delta")
        aggregates.append(mode.otherwise("raw").alias(f"{c}__mode"))
    return _unpivot(df.agg(*aggregates), df.columns, ["mode"])
