"""Line formats as column expressions: one parser per format, kept in a registry.

``parse(df, line, form)`` adds the fields of a format and ``raw``, true where
the line does not match; such lines keep their text and are never lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMBINED = r'^([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]*)\] "([^"]*)" ([0-9-]+) ([0-9-]+)(?: "([^"]*)" "([^"]*)")?$'
VMWARE = r"^([^ ]+) ([^ ]+) ([^ :]+): (?:\[([^\]]*)\] )?(.*)$"
SYSLOG = r"^(?:<([0-9]+)>)?([A-Z][a-z]{2} +[0-9]{1,2} [0-9:]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}T[^ ]+) ([^ ]+) ([^ \[:]+)(?:\[([0-9]+)\])?: (.*)$"
#: Names of the 14 fields of a version 2 flow record.
FLOW = "version account interface source destination source_port destination_port protocol packets bytes start end action status".split()


@dataclass(frozen=True)
class FormatSpec:
    """name, a test of a sample, the parser, and what a match looks like."""

    name: str
    matches: Callable[[Column], Column]
    fields: Callable[[Column], dict[str, Column]]


MARK = "\x01"


def groups(pattern: str, names: list[str]) -> Callable[[Column], dict[str, Column]]:
    """The groups of a pattern that spans the line, from one match: the line becomes its groups between marks. Lines that hold the mark themselves do not match."""
    marked = MARK.join(f"${k + 1}" for k in range(len(names)))

    def fields(line: Column) -> dict[str, Column]:
        parts = F.split(F.when(~F.contains(line, F.lit(MARK)), F.regexp_replace(line, F.lit(pattern), F.lit(marked))), MARK, -1)
        return {n: F.when(F.size(parts) == len(names), F.get(parts, F.lit(k))) for k, n in enumerate(names)}

    return fields


def number(c: Column) -> Column:
    return c.try_cast("long")


def combined(line: Column) -> dict[str, Column]:
    """ip, ident, user, time, request, status, size, referer, agent; a dash for a number is -1, other text -2."""
    out = groups(COMBINED, ["ip", "ident", "user", "time", "request", "status", "size", "referer", "agent"])(line)
    for name in ("status", "size"):
        out[name] = F.when(out[name] == "-", -1).otherwise(F.when(out[name].isNotNull(), F.coalesce(number(out[name]), F.lit(-2))))
    return out


def flow(line: Column) -> dict[str, Column]:
    fields = F.split(F.btrim(line), " ")
    return {"fields": fields, "schema_id": F.size(fields), **{n: F.when(F.size(fields) == len(FLOW), F.get(fields, F.lit(k))) for k, n in enumerate(FLOW)}}


def paths(**names: str) -> Callable[[Column], dict[str, Column]]:
    return lambda line: {n: F.coalesce(F.get_json_object(line, p), F.lit("")) for n, p in names.items()}


def is_object(line: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(line), "$", "string").startswith("{"), F.lit(False))


REGISTRY: dict[str, FormatSpec] = {
    s.name: s
    for s in (
        FormatSpec("nginx", lambda c: c.rlike(COMBINED), combined),
        FormatSpec("apache", lambda c: c.rlike(COMBINED.replace("([^ ]+) ([^ ]+) \\[", "(-) (-) \\[", 1)), combined),
        FormatSpec("syslog", lambda c: c.rlike(SYSLOG), groups(SYSLOG, ["priority", "time", "host", "process", "pid", "message"])),
        FormatSpec("vmware", lambda c: c.rlike(VMWARE), groups(VMWARE, ["time", "host", "process", "meta", "message"])),
        FormatSpec("vpcflow", lambda c: F.size(F.split(F.btrim(c), " ")) == len(FLOW), flow),
        FormatSpec("k8s", is_object, paths(log="$.log", stream="$.stream", time="$.time")),
        FormatSpec("github", is_object, paths(type="$.type", public="$.public", created_at="$.created_at", repo="$.repo.name", actor="$.actor.login", org="$.org.login")),
        FormatSpec("jsonl", is_object, lambda c: {"value": F.when(is_object(c), F.try_parse_json(c))}),
        FormatSpec("raw", lambda c: F.lit(True), lambda c: {}),
    )
}


def parse(df: DataFrame, line: str, form: str) -> DataFrame:
    spec = REGISTRY[form]
    c = F.col(f"`{line}`")
    return df.withColumns({**spec.fields(c), "raw": ~F.coalesce(spec.matches(c), F.lit(False))})


TRAIL = T.StructType(
    [T.StructField("Records", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("eventName", "eventSource", "awsRegion", "sourceIPAddress", "eventTime", "eventID")] + [T.StructField("userIdentity", T.StructType([T.StructField("userName", T.StringType())]))])))]
)


def cloudtrail(df: DataFrame, document: str) -> DataFrame:
    """One row per record of each document, over the whole document."""
    return df.select(F.explode(F.from_json(document, TRAIL)["Records"]).alias("r")).select("r.eventName", "r.eventSource", "r.awsRegion", "r.sourceIPAddress", "r.eventTime", "r.eventID", F.col("r.userIdentity.userName").alias("userName"))


def jsonl(df: DataFrame, line: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Typed fields of JSON lines. Blank lines do not count. Lenient: bad lines and lines that are no object get ``bad``; strict: they raise."""
    rows = df.where(F.btrim(line) != "")
    if strict:
        checked = F.when(is_object(F.col(line)), F.col(line)).otherwise(F.raise_error(F.concat(F.lit("bad JSON line: "), F.col(line))))
        return rows.select(F.from_json(checked, schema).alias("x")).select("x.*")
    ok = is_object(F.col(line))
    return rows.select(F.from_json(F.when(ok, F.col(line)), schema).alias("x"), (~ok).alias("bad")).select("x.*", "bad")


def key_order(df: DataFrame, line: str, order: str) -> DataFrame:
    """Keys of all objects in first-seen order: key, place."""
    keys = df.select(F.col(order).alias("__at"), F.posexplode(F.json_object_keys(line)).alias("__k", "key"))
    # As many rows as there are keys: each with the first place where it was seen.
    first = keys.groupBy("key").agg(F.min(F.struct("__at", "__k")).alias("first"))
    return first.select("key", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("place"))


def read_lines(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """path, line_no (from 1 in each file) and line.

    dense: exact line numbers, from whole files; else ``row_id`` that grows along each file but has gaps.
    """
    if dense:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n", -1)).alias("n", "line"))
        return whole.select("path", (F.col("n") + 1).alias("line_no"), "line")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("line"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """digest and name of lines ``digest path``."""
    parts = F.split(F.btrim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.btrim("value") != "").select(F.get(parts, F.lit(0)).alias("digest"), F.element_at(F.split(F.get(parts, F.lit(1)), "/"), -1).alias("name"))
