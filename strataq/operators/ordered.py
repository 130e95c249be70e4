"""Order-dependent operators that do not put the whole table in one task.

Rows are split into ranges of a whole-number order column: quantiles of the
column (one aggregate pass), each cut evenly into as many parts as keep a range
near ROWS rows. So ranges hold about the same number of rows however the values
lie: dense, sparse or in clusters. Windows run inside the ranges; what crosses
an edge comes from one row per range, so the only window without partitions is
over the table of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUANTILES, ACCURACY = 1 << 16, 64, 4096
RANGE = None


def plan_ranges(df: DataFrame, order: str, rows: int = ROWS) -> tuple[list[int], list[int]]:
    """Lower ends of the quantiles of ``order`` (distinct, sorted) and the width of the parts of each."""
    points = [k / QUANTILES for k in range(QUANTILES + 1)]
    n, found = df.agg(F.count(order), F.percentile_approx(order, points, ACCURACY)).first()
    if not n:
        return [0], [1]
    ends = sorted({int(x) for x in found})
    parts = max(1, -(-n // (rows * QUANTILES)))
    # The last quantile has no upper end: its parts are as wide as if it ended a quantile later.
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(ends, [*ends[1:], 2 * ends[-1] - ends[0] + 1], strict=True)]
    return ends, widths


def ranges(df: DataFrame, order: str, width: int | None) -> DataFrame:
    """``df`` with ``__range``, which grows with ``order``: a struct of the lower end of the quantile and the part of it; of a fixed ``width`` if one is given."""
    if width:
        return df.withColumn("__range", F.struct(F.lit(0).cast("long").alias("low"), F.floor(F.col(order) / width).cast("long").alias("part")))
    ends, widths = plan_ranges(df, order)
    value = F.col(order).cast("long")

    def search(low: int, high: int) -> Column:
        """Balanced choices: a row makes log2(QUANTILES) comparisons."""
        if high - low == 1:
            return F.struct(F.lit(ends[low]).cast("long").alias("low"), F.floor((value - ends[low]) / widths[low]).cast("long").alias("part"))
        middle = (low + high) // 2
        return F.when(value < ends[middle], search(low, middle)).otherwise(search(middle, high))

    return df.withColumn("__range", F.when(value.isNotNull(), search(0, len(ends))))


def with_previous(df: DataFrame, order: str, value: Column, name: str, default=None, width: int | None = RANGE) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in ``order`` (unique whole numbers), ``default`` for the first."""
    rows = ranges(df, order, width).withColumn("__value", F.struct(value.alias("v")))
    edges = rows.groupBy("__range").agg(F.max_by("__value", order).alias("__edge"))
    edges = edges.select("__range", F.lag("__edge").over(Window.orderBy("__range")).alias("__edge"))
    inside = F.lag("__value").over(Window.partitionBy("__range").orderBy(order))
    out = rows.withColumn("__before", inside).join(edges, "__range", "left")
    before = F.coalesce("__before", "__edge")
    return out.withColumn(name, F.when(before.isNull(), F.lit(default)).otherwise(before["v"])).select(*df.columns, name)


def with_running_sum(df: DataFrame, order: str, value: Column, name: str, width: int | None = RANGE) -> DataFrame:
    """``df`` with ``name``: sum of ``value`` up to and with the row, in ``order``."""
    rows = ranges(df, order, width).withColumn("__value", value)
    sums = rows.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(sums, "__range").withColumn(name, F.col("__inside") + F.col("__offset")).select(*df.columns, name)


def runs(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row per run of equal neighbouring values: run_start, value, run_length."""
    rows = with_previous(df.select(order, value), order, F.col(value), "__last")
    # A leading run of nulls equals the null before the first row and counts as run 0.
    rows = rows.withColumn("__new", (~F.col(value).eqNullSafe(F.col("__last"))).cast("int"))
    rows = with_running_sum(rows, order, F.col("__new"), "__run")
    return rows.groupBy("__run").agg(F.min(order).alias("run_start"), F.min(value).alias("value"), F.count(F.lit(1)).alias("run_length")).drop("__run")


def rolling_mean(df: DataFrame, order: str, value: str, rows: int, name: str, width: int = ROWS) -> DataFrame:
    """Mean of the last ``rows`` rows in ``order`` (unique whole numbers, gaps are no matter).

    Rows get their rank first; a range of ranks needs at most ``rows`` rows of those before it.
    """
    width = max(width, rows)
    ranked = with_running_sum(df.select(order, value), order, F.lit(1).cast("long"), "__rank").withColumn("__rank", F.col("__rank") - 1)
    own = ranked.withColumns({"__part": F.floor(F.col("__rank") / width).cast("long"), "__own": F.lit(True)})
    spill = own.where(F.col("__rank") % width >= width - rows + 1).withColumns({"__part": F.col("__part") + 1, "__own": F.lit(False)}) if rows > 1 else own.limit(0)
    window = Window.partitionBy("__part").orderBy("__rank").rowsBetween(1 - rows, 0)
    return own.unionByName(spill).withColumn(name, F.avg(value).over(window)).where("__own").select(order, name)


def first_seen(df: DataFrame, key: list[str], order: str, name: str, start: int = 0) -> DataFrame:
    """Distinct ``key`` values with ids in first-seen order, ``first_row`` and ``n``.

    Ids are dense over the distinct keys: counts per range of ``first_row`` are added up, as above.
    """
    keys = df.groupBy(*key).agg(F.min(order).alias("first_row"), F.count(F.lit(1)).alias("n"))
    return with_running_sum(keys, "first_row", F.lit(1), name).withColumn(name, F.col(name) - 1 + start)
