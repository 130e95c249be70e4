"""Operation metrics: totals, rollups, key figures, rolling means, storage cost, netting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import rolling_mean

USD_PER_GB = 0.023
GIB, MIB = 1 << 30, 1 << 20


def totals() -> list[Column]:
    """Over an operation log with bytes_in, bytes_out, latency_ms and failed."""
    return [
        F.count(F.lit(1)).alias("operations"),
        F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"),
        F.sum(F.col("failed").cast("int")).cast("long").alias("errors"),
        F.avg("latency_ms").alias("mean_latency"),
        F.avg(F.when(F.col("latency_ms") > 0, F.col("bytes_in") / MIB / (F.col("latency_ms") / 1000))).alias("mean_mb_s"),
    ]


def key_figures(df: DataFrame) -> DataFrame:
    """Ratio, saved dollars, error rate, efficiency, yearly projection and return from totals."""
    ratio = F.when(F.col("bytes_out") > 0, F.col("bytes_in") / F.col("bytes_out")).otherwise(0.0)
    saved = (F.col("bytes_in") - F.col("bytes_out")) / GIB * USD_PER_GB
    return df.select(
        *[c for c in df.columns if c not in ("mean_latency", "mean_mb_s")],
        F.round(ratio, 4).alias("ratio"),
        F.round(saved, 6).alias("saved_usd"),
        F.round("mean_latency", 4).alias("mean_latency"),
        F.round("mean_mb_s", 4).alias("mean_mb_s"),
        F.round(F.col("errors") / F.greatest(F.col("operations"), F.lit(1)) * 100, 4).alias("error_rate"),
        F.round(F.least(F.lit(100.0), ratio / 50 * 100), 4).alias("efficiency"),
        F.round(saved * 365, 4).alias("yearly_usd"),
        F.round(saved * 15, 6).alias("roi_usd"),
    )


def rollup(df: DataFrame, *groupings: str) -> DataFrame:
    """Totals for each grouping on its own, in one pass (grouping sets)."""
    sets = [[F.col(g)] for g in groupings]
    return df.groupingSets(sets, *(F.col(g) for g in groupings)).agg(*totals())


def rolling_latency(df: DataFrame, order: str, rows: int = 1000) -> DataFrame:
    return rolling_mean(df, order, "latency_ms", rows, "rolling_ms")


def storage_cost(df: DataFrame, raw_bytes: Column, per_day: int = 1_000_000, days: int = 30) -> DataFrame:
    """Dollars a month for ``per_day`` rows of the mean size."""
    size = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(raw_bytes).alias("raw_bytes"))
    gib = F.col("raw_bytes") / F.col("n_rows") * per_day * days / GIB
    return size.select("n_rows", "raw_bytes", F.round(gib, 6).alias("gib_month"), F.round(gib * USD_PER_GB, 6).alias("usd_month"))


def compression(raw: Column, packed: Column, seconds: Column) -> list[Column]:
    return [F.round(raw / packed, 4).alias("ratio"), F.round(raw / MIB / seconds, 4).alias("mb_s")]


def random_share(random_bytes: Column, total: Column) -> Column:
    """Share of bytes that cannot compress."""
    return F.round(random_bytes / total, 6)


def netting(df: DataFrame, payer: str, payee: str, amount: str) -> DataFrame:
    """One row per unordered pair: low, high, n, gross and net from low to high."""
    low, high = F.least(payer, payee), F.greatest(payer, payee)
    money = F.col(amount).cast("decimal(38,4)")  # sums of money do not depend on their order
    signed = F.when(F.col(payer) == low, money).otherwise(-money)
    return df.where(F.col(payer) != F.col(payee)).groupBy(low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"), F.sum(money).cast("double").alias("gross"), F.sum(signed).cast("double").alias("net"))
