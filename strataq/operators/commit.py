"""Commitments: one leaf per column, a Merkle root over the leaves, proofs and disclosure.

A leaf is SHA-256 over a zero byte and three length-prefixed fields: column
name, exact zone as canonical JSON, values as canonical JSON. Values have to be
hashed in row order: rows are sorted in ranges, many tasks write their values
as packed pieces, and one task a column feeds the pieces to the digest.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import canonical_json


def length_prefix(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def prefixed(data: bytes) -> bytes:
    return length_prefix(len(data)) + data


def zone(values: list) -> dict:
    """type (of the first value), count, nulls and, if the values can be ordered, min and max; missing bounds prove nothing."""
    some = [v for v in values if v is not None]
    out = {"type": type(some[0]).__name__ if some else "null", "count": len(values), "nulls": len(values) - len(some)}
    try:
        if some:
            out |= {"min": min(some), "max": max(some)}
    except TypeError:
        pass
    return out


def leaf(name: str, values: list) -> tuple[dict, bytes]:
    z = zone(values)
    parts = [name.encode(), canonical_json(z).encode(), canonical_json(values).encode()]
    return z, hashlib.sha256(b"\0" + b"".join(map(prefixed, parts))).digest()


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\1" + left + right).digest()


def layers(leaves: list[bytes]) -> list[list[bytes]]:
    """From the leaves to the root; a node without a partner moves up unchanged."""
    out = [leaves or [hashlib.sha256(b"\0").digest()]]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([node(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    return out


@dataclass(frozen=True)
class InclusionProof:
    name: str
    leaf: str
    path: tuple[tuple[str, str], ...]  # (side of the sibling, its hash), from the bottom

    def as_dict(self) -> dict:
        return {"name": self.name, "leaf": self.leaf, "path": [list(x) for x in self.path]}

    @classmethod
    def from_dict(cls, data: dict) -> "InclusionProof":
        return cls(data["name"], data["leaf"], tuple((str(a), str(b)) for a, b in data["path"]))


@dataclass(frozen=True)
class Commitment:
    root: str
    leaves: tuple[tuple[str, str], ...]  # (column, hash) by name
    zones: dict

    def proof(self, name: str) -> InclusionProof:
        names = [n for n, _ in self.leaves]
        if name not in names:
            raise KeyError(name)
        at, path = names.index(name), []
        for level in layers([bytes.fromhex(h) for _, h in self.leaves])[:-1]:
            if (other := at ^ 1) < len(level):
                path.append(("left" if other < at else "right", level[other].hex()))
            at //= 2
        return InclusionProof(name, dict(self.leaves)[name], tuple(path))


def _commitment(found: dict[str, tuple[dict, bytes]]) -> Commitment:
    names = sorted(found)
    return Commitment(layers([found[n][1] for n in names])[-1][0].hex(), tuple((n, found[n][1].hex()) for n in names), {n: found[n][0] for n in names})


def commit_columns(columns: dict[str, list]) -> Commitment:
    return _commitment({n: leaf(n, v) for n, v in columns.items()})


def commit_records(records: list[dict]) -> Commitment:
    if not all(isinstance(r, dict) for r in records):
        raise TypeError("records are dicts")
    names = list(dict.fromkeys(k for r in records for k in r))
    return commit_columns({n: [r.get(n) for r in records] for n in names})


def commit_jsonl(data: bytes | str) -> Commitment:
    """Strict: a bad line raises, blank lines do not count."""
    text = data.decode() if isinstance(data, bytes) else data
    return commit_records([json.loads(line) for line in text.split("\n") if line.strip()])


#: Rows and bytes of JSON that a task sorts.
RANGE_ROWS, RANGE_BYTES = 1 << 19, 64 << 20


def column_leaves(df: DataFrame, order: str) -> DataFrame:
    """name and leaf (hex) of each column but ``order``: the order column only gives the order.

    A leaf is a hash over all values in row order, so the digest of a column is
    one task. Rows get their order in ranges of RANGE_ROWS rows or RANGE_BYTES
    bytes; there a batch of a column becomes a packed piece of JSON, and the task
    of a column sorts and unpacks pieces only, one at a time. What the hash needs
    in front (zone, length of the values as JSON) comes from aggregates over all
    rows before.
    """
    columns = [c for c in df.columns if c != order]
    zones = table_zones(df.select(*(F.col(f"`{c}`") for c in columns)))
    # to_json writes a null field as nothing; a one-element array keeps it.
    cells = df.select(F.col(f"`{order}`").alias("__order"), *(F.to_json(F.array(F.col(f"`{c}`"))).alias(f"cell{k}") for k, c in enumerate(columns)))

    def texts(column: pa.Array) -> bytes:
        """The values of a column of a batch as canonical JSON, with commas between."""
        return canonical_json([x[0] for x in json.loads(f"[{','.join(column.to_pylist())}]")])[1:-1].encode()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * len(columns)
        for batch in batches:
            for k in range(len(columns)) if batch.num_rows else ():
                sums[k] += len(texts(batch.column(k))) - batch.num_rows + 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array(sums, pa.int64())], ["k", "bytes"])

    found = cells.drop("__order").mapInArrow(sizes, "k int, bytes long").groupBy("k").agg(F.sum("bytes").alias("bytes")).collect() if columns else []  # one row per column
    measured = {columns[r["k"]]: r["bytes"] for r in found}
    heads = []
    for c in columns:
        z = canonical_json(zones[c]).encode()
        n = measured.get(c, 0) + max(zones[c]["count"] - 1, 0) + 2
        heads.append(b"\0" + prefixed(c.encode()) + prefixed(z) + length_prefix(n) + b"[")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece per column and batch; rows of one order value share a range, so its first value and its number in the range give its place."""
        for n, batch in enumerate(b for b in batches if b.num_rows):
            first = pa.concat_arrays([batch.column(0)[:1]] * len(columns))
            packed = pa.array([zlib.compress(texts(batch.column(k + 1)), 1) for k in range(len(columns))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), first, pa.array([n] * len(columns), pa.int64()), packed], ["k", "first", "n", "packed"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([columns[k]]), pa.array([(state.update(b"]"), state.hexdigest())[1]])], ["name", "leaf"])
        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # sorted by column: one run each
                if own != k:
                    if k is not None:
                        yield done()
                    k, state = own, hashlib.sha256(heads[own])
                else:
                    state.update(b",")
                state.update(zlib.decompress(packed.as_py()))
        if k is not None:
            yield done()

    if zones and all(z["count"] for z in zones.values()):
        n_ranges = max(-(-zones[columns[0]]["count"] // RANGE_ROWS), -(-sum(measured.values()) // RANGE_BYTES))
        made = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("first", df.schema[order].dataType), T.StructField("n", T.LongType()), T.StructField("packed", T.BinaryType())])
        parts = cells.repartitionByRange(n_ranges, "__order").sortWithinPartitions("__order").mapInArrow(pieces, made)
        return parts.repartitionById(len(columns), F.col("k")).sortWithinPartitions("k", "first", "n").select("k", "packed").mapInArrow(digest, "name string, leaf string")
    empty = [(c, hashlib.sha256(head + b"]").hexdigest()) for c, head in zip(columns, heads, strict=True)]
    return df.sparkSession.createDataFrame(empty, "name string, leaf string")


#: How the types of a table are named in a zone: those of the values in JSON.
ZONE_TYPES = {"string": "str", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "bool", "date": "str", "timestamp": "str", "timestamp_ntz": "str"}


def table_zones(df: DataFrame) -> dict[str, dict]:
    """The zone of each column, as ``zone`` of its values in JSON; bounds for types with an order there."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for k, (c, kind) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        ordered = kind in ZONE_TYPES
        cell = F.to_json(F.array(v))
        low, high = (F.to_json(F.array(f(v))) for f in (F.min, F.max)) if ordered else (F.min(F.when(v.isNotNull(), cell)),) * 2
        aggregates += [F.count(v).alias(f"some{k}"), low.alias(f"low{k}"), high.alias(f"high{k}")]
    found = df.agg(*aggregates).first()
    out = {}
    for k, (c, kind) in enumerate(df.dtypes):
        some = found[f"some{k}"]
        name = ZONE_TYPES.get(kind) or ("list" if kind.startswith("array") else "float" if kind.startswith("decimal") else "dict")
        z = {"type": name if some else "null", "count": found["n"], "nulls": found["n"] - some}
        if some and (kind in ZONE_TYPES or some == 1):
            z |= {"min": json.loads(found[f"low{k}"])[0], "max": json.loads(found[f"high{k}"])[0]}
        out[c] = z
    return out


def commit(df: DataFrame, order: str) -> Commitment:
    """The root over a table; only one hash per column comes to the driver."""
    found = sorted((r["name"], r["leaf"]) for r in column_leaves(df, order).collect())
    return Commitment(layers([bytes.fromhex(h) for _, h in found])[-1][0].hex(), tuple(found), table_zones(df.drop(order)))


def verify_inclusion(root: str, proof: InclusionProof) -> bool:
    try:
        now = bytes.fromhex(proof.leaf)
        for side, other in proof.path:
            now = node(bytes.fromhex(other), now) if side == "left" else node(now, bytes.fromhex(other))
    except ValueError:
        return False
    return hmac.compare_digest(now.hex(), root)


def verify_disclosure(root: str, proof: InclusionProof, name: str, values: list, claimed_zone: dict | None = None) -> bool:
    """The zone is computed again from the values; a claimed one has to equal it."""
    z, found = leaf(name, values)
    return proof.name == name and (claimed_zone is None or claimed_zone == z) and hmac.compare_digest(found.hex(), proof.leaf) and verify_inclusion(root, proof)


def proves_above(zone: dict, bound) -> bool:
    """Whether the zone alone proves that all values are over ``bound``; missing bounds prove nothing."""
    try:
        return "min" in zone and zone["nulls"] == 0 and zone["min"] > bound
    except TypeError:
        return False
