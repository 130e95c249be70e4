"""The public functions: compress, search, commit, encrypt, audit."""

from __future__ import annotations

import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .operators.commit import Commitment, InclusionProof, commit_jsonl, commit_records, verify_disclosure, verify_inclusion
from .operators.security import AuditChain, seal, unseal
from .plans import archive

__all__ = ["AuditChain", "Commitment", "InclusionProof", "commit_jsonl", "commit_records", "compress", "compress_encrypted", "compress_records", "decompress", "decompress_encrypted", "explain_search", "inclusion_proof", "search", "secure_audit_log", "verify_disclosure", "verify_inclusion"]

LEAST, MOST = -(2**63), 2**63 - 1


def column_type(values: list) -> T.DataType:
    """Narrowest type for all values: whole numbers with floats widen, numbers beyond 64 bits and mixed values become text."""
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType() if all(LEAST <= v <= MOST for v in values if v is not None) else T.StringType()
    if kinds in ({float}, {int, float}):
        return T.DoubleType()
    return T.StringType()


def as_cell(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return value


def frame_schema(records: list[dict]) -> T.StructType:
    """Columns in first-seen order."""
    names = list(dict.fromkeys(k for r in records for k in r))
    return T.StructType([T.StructField(n, column_type([r.get(n) for r in records])) for n in names])


def frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records as rows; columns in first-seen order, ``row_id`` in front."""
    kinds = frame_schema(records)
    schema = T.StructType([T.StructField("row_id", T.LongType()), *kinds])
    return spark.createDataFrame([(i, *(as_cell(r.get(f.name), f.dataType) for f in kinds)) for i, r in enumerate(records)], schema)


def compress_records(spark: SparkSession, records: list[dict], path: str, mode: str = "fast") -> dict:
    return archive.write(frame(spark, records), path, mode, sort_by=["row_id"])


def compress(spark: SparkSession, source: str, path: str, mode: str = "fast") -> dict:
    """JSON lines at ``source`` (any path that Spark reads). Bad lines are left out and counted in the manifest's answer."""
    df = spark.read.option("columnNameOfCorruptRecord", "_bad").json(source)
    if "_bad" not in df.columns:
        return archive.write(df, path, mode) | {"malformed": 0}
    checked = df.cache()
    try:
        bad = checked.where(F.col("_bad").isNotNull()).count()
        return archive.write(checked.where(F.col("_bad").isNull()).drop("_bad"), path, mode) | {"malformed": bad}
    finally:
        checked.unpersist()


def decompress(spark: SparkSession, path: str) -> DataFrame:
    return archive.read(spark, path, verify=True)


def search(spark: SparkSession, path: str, query: str, mode: str = "contains") -> DataFrame:
    return archive.search(spark, path, query, mode)


def explain_search(spark: SparkSession, path: str, query: str, mode: str = "contains") -> archive.Plan:
    """Columns and blocks that a search tests and skips."""
    return archive.planned(spark, path, query, mode)[1]


def inclusion_proof(commitment: Commitment, name: str) -> InclusionProof:
    return commitment.proof(name)


def compress_encrypted(spark: SparkSession, records: list[dict], secret: str | None, tenant: str, with_root: bool = True) -> bytes:
    """One envelope for a bounded batch of records, packed in memory; its authenticated metadata carry the commitment root."""
    schema = frame_schema(records)
    columns = [[as_cell(r.get(f.name), f.dataType) for r in records] for f in schema]
    packed = io.BytesIO()
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema)), packed, compression="zstd", compression_level=archive.LEVELS["max"])
    data = len(records).to_bytes(8) + packed.getvalue()
    return seal(spark, data, secret, tenant, {"root": commit_records(records).root} if with_root else None)


def decompress_encrypted(spark: SparkSession, envelope: bytes, secret: str | None, tenant: str, return_meta: bool = False):
    data, meta = unseal(spark, envelope, secret, tenant)
    rows = pq.read_table(io.BytesIO(data[8:])).to_pylist() or [{}] * int.from_bytes(data[:8])
    records = [{k: v for k, v in r.items() if v is not None} for r in rows]
    return (records, meta) if return_meta else records


def secure_audit_log(events: list[tuple[str, str, dict]]) -> AuditChain:
    """A chain over (time, event, metadata)."""
    chain = AuditChain()
    for ts, event, meta in events:
        chain.append(event, meta, ts)
    return chain
