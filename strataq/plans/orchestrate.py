"""Detect, archive, verify, encrypt, measure and audit in one call, and the way back; checks of an archive."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.security import AuditChain
from ..operators.templates import HOLES, with_template
from ..sources.folders import shared_folder
from ..sources.formats import REGISTRY, parse
from . import archive
from .detect import SAMPLE, detect

#: Lines of a head; most of SAMPLE bytes each are looked at.
HEAD_LINES = 256
PARSERS = {"json_columnar": "jsonl", "cloudtrail": "raw", "universal": "raw", "sql": "raw"}


class Orchestrator:
    """Keeps the operation log and the audit chain of its calls."""

    def __init__(self, spark: SparkSession, tenant: str = "default"):
        self.spark, self.tenant, self.chain, self.operations = spark, tenant, AuditChain(), []

    def engine_of(self, source: str) -> str:
        """By the first 4 KiB of lines."""
        lines = self.spark.read.text(source).select(F.substring("value", 1, SAMPLE).alias("line")).limit(HEAD_LINES)
        head = lines.agg(F.substring(F.concat_ws("\n", F.collect_list("line")), 1, SAMPLE).alias("s"))  # a bounded number of bounded lines
        return head.select(detect(F.col("s")).alias("e")).first()["e"]

    def compress(self, source: str, path: str, mode: str = "fast") -> dict:
        began = time.time()
        engine = self.engine_of(source)
        lines = self.spark.read.text(source).withColumnRenamed("value", "line").withColumn("row_id", F.monotonically_increasing_id())
        form = PARSERS.get(engine, engine)

        def parsed(df: DataFrame) -> DataFrame:
            if engine in HOLES and form == "raw":
                return with_template(df, "line", engine)
            return parse(df, "line", form) if form in REGISTRY else df

        made = archive.write_lines(lines, "line", path, parsed, mode=mode)
        self._log("compress", engine, made["rows"], time.time() - began)
        return made | {"format": engine}

    def decompress(self, path: str, out: str) -> None:
        began = time.time()
        df = archive.read(self.spark, path, verify=True)
        order = ["row_id"] if "row_id" in df.columns else []
        (df.orderBy(*order) if order else df).select("line").write.mode("overwrite").text(out)
        self._log("decompress", "any", df.count(), time.time() - began)

    def _log(self, event: str, engine: str, rows: int, seconds: float) -> None:
        self.operations.append({"event": event, "engine": engine, "tenant": self.tenant, "rows": rows, "latency_ms": seconds * 1000})
        self.chain.append(event, {"engine": engine, "rows": rows, "tenant": self.tenant}, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))

    def dump(self, path: str) -> None:
        """The operation log as JSON."""
        self.spark.createDataFrame([(json.dumps(x),) for x in self.operations], "value string").coalesce(1).write.mode("overwrite").text(path)


def checks(spark: SparkSession, path: str, original: DataFrame) -> DataFrame:
    """test, passed, details: identity, determinism of three reads, format, and whether damaged copies are refused."""

    def run(name: str, test: Callable[[], tuple[bool, str]]) -> tuple[str, bool, str]:
        try:
            return (name, *test())
        except Exception as e:
            return name, False, f"{type(e).__name__}: {e}"[:200]

    def identity():
        missing, extra = archive.differences(original, archive.read(spark, path)).first()
        return missing == extra == 0, f"{missing} missing, {extra} extra"

    def determinism():
        found = {archive.fingerprint(archive.read(spark, path)) for _ in range(3)}
        return len(found) == 1, f"{len(found)} different results"

    def form():
        archive.read(spark, path, verify=True)
        return True, "manifest, columns and digest agree"

    def damage(change: Callable[[DataFrame], DataFrame]) -> Callable[[], tuple[bool, str]]:
        """Whether a copy of the archive whose rows were changed, its manifest kept, is refused."""

        def test() -> tuple[bool, str]:
            copy = f"{shared_folder(spark)}/copy"
            change(spark.read.parquet(f"{path}/data")).write.parquet(f"{copy}/data")
            spark.read.text(f"{path}/manifest").coalesce(1).write.text(f"{copy}/manifest")
            try:
                archive.read(spark, copy, verify=True)
            except archive.CorruptArchive as e:
                return True, str(e)
            return False, "a damaged archive was read"

        return test

    def other(df: DataFrame) -> DataFrame:
        """One value changed in one row."""
        c, kind = df.dtypes[0]
        first = df.limit(1).withColumn(c, F.lit(None).cast(kind) if df.select(c).first()[0] is not None else F.lit("0").try_cast(kind))
        return df.exceptAll(df.limit(1)).unionByName(first)

    tests = {"identity": identity, "determinism": determinism, "format": form, "changed value": damage(other), "missing row": damage(lambda df: df.exceptAll(df.limit(1))), "added row": damage(lambda df: df.unionByName(df.limit(1)))}
    return spark.createDataFrame([run(name, test) for name, test in tests.items()], "test string, passed boolean, details string")


def report(results: DataFrame, path: str) -> str:
    """A Markdown table of check results, also written to ``path``; results are a few rows."""
    lines = ["| test | passed | details |", "|---|---|---|", *(f"| {r['test']} | {r['passed']} | {r['details']} |" for r in results.collect())]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return "\n".join(lines)
