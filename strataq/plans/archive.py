"""Archives: Parquet with zstd, a manifest, zone maps and an optional token index; write, verify, read, search, restore.

A line table is stored as it is parsed; lines that a parser does not know keep
their text. The manifest names the format and holds row count, columns and an
order-free digest of all rows, which a read can verify.
"""

from __future__ import annotations

import json

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators import index as token_index_
from ..operators import profile
from ..operators.search import any_column, text_of

FORMAT_VERSION = 1
LEVELS = {"fast": 6, "max": 19}


class CorruptArchive(ValueError):
    pass


def _digest_parts(df: DataFrame) -> list[Column]:
    """Row count and the sums of two row hashes. Maps and variants enter as JSON."""
    cells = [F.to_json(f"`{c}`") if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in df.dtypes]
    hashed = lambda *more: F.coalesce(F.sum(F.xxhash64(*more, *cells).cast("decimal(20,0)")), F.lit(0)) if cells else F.lit(0)
    return [F.count(F.lit(1)).alias("rows"), hashed().alias("h"), hashed(F.lit("second")).alias("k")]


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest."""
    n, h, k = df.agg(*_digest_parts(df)).first()
    return n, f"{h}:{k}"


def _manifest(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(f"{path}/manifest").collect()
    if len(rows) != 1:
        raise CorruptArchive("no manifest")
    return json.loads(rows[0][0])


def write(df: DataFrame, path: str, mode: str = "fast", sort_by: list[str] | None = None, engine: str = "columnar", index: tuple[str, str, int] | None = None, verify: bool = True, reason: str | None = None) -> dict:
    """Writes ``df``; sorting by the usual filter keys lets row groups be skipped. ``index``: (key, text column, block size)."""
    spark = df.sparkSession
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    # The digest of what was given is taken while it is written: ``df`` is computed once.
    seen = Observation()
    out = out.observe(seen, *_digest_parts(df))
    out.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVELS[mode])).parquet(f"{path}/data")
    given = seen.get
    rows, digest = given["rows"], f"{given['h']}:{given['k']}"
    written = spark.read.schema(df.schema).parquet(f"{path}/data")
    manifest = {"version": FORMAT_VERSION, "engine": engine, "mode": mode, "rows": rows, "digest": digest, "columns": df.columns, "index": list(index) if index else None}
    if reason:
        manifest["reason"] = reason
    if df.columns:
        profile.zone_map(written).coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
    if index:
        key, text, size = index
        token_index_.token_index(written, key, text, size).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tokens")
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    if verify and fingerprint(written) != (rows, digest):
        raise CorruptArchive("what was written differs from what was given")
    return manifest


def write_lines(df: DataFrame, line: str, path: str, parser, **options) -> dict:
    """Parses and writes; if the parser does not fit the table, the raw lines are written instead, and the manifest says why. Failures of a job are raised."""
    try:
        parsed = parser(df)
    except (AnalysisException, ValueError) as e:
        return write(df.select(line), path, engine="raw", reason=f"{type(e).__name__}: {str(e)[:200]}", **options)
    return write(parsed, path, engine="parsed", **options)


def read(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """Raises CorruptArchive if manifest or columns are missing, or on request if the rows changed."""
    try:
        manifest = _manifest(spark, path)
        df = spark.read.parquet(f"{path}/data")
    except CorruptArchive:
        raise
    except Exception as e:
        raise CorruptArchive(f"unreadable archive: {type(e).__name__}") from e
    if df.columns != manifest["columns"]:
        raise CorruptArchive("columns differ from the manifest")
    if verify:
        try:
            found = fingerprint(df)
        except Exception as e:
            raise CorruptArchive(f"unreadable data: {type(e).__name__}") from e
        if found != (manifest["rows"], manifest["digest"]):
            raise CorruptArchive("rows differ from the manifest")
    return df


@dataclass(frozen=True)
class Plan:
    """What a search reads: the columns it tests, those whose zone rules the value out, and the blocks of the token index."""

    tested: tuple[str, ...]
    skipped: tuple[str, ...]
    blocks: int | None = None
    candidates: int | None = None


#: As many candidate blocks become ranges of the key, which reach the scan; more are joined.
MOST_RANGES = 64


def planned(spark: SparkSession, path: str, query: str, mode: str = "contains") -> tuple[DataFrame, Plan]:
    """The rows that match, in any column, and how they are found. Neither zones nor the index change which rows these are.

    Columns whose zone cannot hold the value are not tested. If there is a token
    index and the query is a word, the test of the indexed text is made in the
    candidate blocks only (and where the key is null); the other columns are
    tested in all rows.
    """
    df, manifest = read(spark, path), _manifest(spark, path)
    zones = {z["column"]: z.asDict() for z in spark.read.parquet(f"{path}/zones").collect()}  # one row per column
    exact = lambda z: mode in ("contains", "equals") and z is not None and profile.bound_type(z["type"]) in ("long", "double")
    skipped = tuple(c for c in df.columns if exact(zones.get(c)) and not profile.may_hold(zones[c], query))
    tested = tuple(c for c in df.columns if c not in skipped)
    test = lambda columns: any_column(df.select(*(f"`{c}`" for c in columns)), query, mode)
    index = manifest["index"]
    if not index or mode != "contains" or not token_index_.gate_applies(query):
        return df.where(test(tested)), Plan(tested, skipped)
    key, text, size = index
    tokens = spark.read.parquet(f"{path}/tokens").where("block_id IS NOT NULL")
    blocks = tokens.where(F.col("token").contains(query.lower())).select("block_id").distinct()
    total = tokens.agg(F.countDistinct("block_id")).first()[0]
    some = [r[0] for r in blocks.limit(MOST_RANGES + 1).collect()]
    others = test([c for c in tested if c != text])
    found = F.coalesce(text_of(F.col(f"`{text}`"), dict(df.dtypes)[text]).contains(query), F.lit(False)) & ~others
    k = F.col(f"`{key}`")
    if len(some) <= MOST_RANGES:
        near = k.isNull()
        for b in sorted(some):
            near = near | ((k >= b * size) & (k < (b + 1) * size))
        return df.where(others).unionByName(df.where(near).where(found)), Plan(tested, skipped, total, len(some))
    inside = df.withColumn("__block", F.floor(k / size).cast("long")).join(blocks.withColumnRenamed("block_id", "__candidate"), F.col("__block") == F.col("__candidate"), "left_semi").drop("__block")
    return df.where(others).unionByName(inside.where(found)).unionByName(df.where(k.isNull()).where(found)), Plan(tested, skipped, total, blocks.count())


def search(spark: SparkSession, path: str, query: str, mode: str = "contains") -> DataFrame:
    """Rows that match in any column."""
    return planned(spark, path, query, mode)[0]


def restore_jsonl(df: DataFrame) -> DataFrame:
    """One line per row without null keys."""
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("value"))


def restore(spark: SparkSession, path: str, out: str) -> None:
    restore_jsonl(read(spark, path, verify=True)).write.mode("overwrite").text(out)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing and extra: rows of one table that the other lacks, with repeats."""
    missing, extra = a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra"))
    return missing.join(extra)


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, digest, status: PASS, FAIL or MISSING of each manifest entry; ``files`` has name and digest."""
    joined = manifest.join(files.select("name", F.col("digest").alias("__found")), "name", "left")
    return joined.select("name", "digest", F.when(F.col("__found").isNull(), "MISSING").when(F.col("__found") == F.col("digest"), "PASS").otherwise("FAIL").alias("status"))
