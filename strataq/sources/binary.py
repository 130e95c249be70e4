"""Binary scans in Arrow batches: flow packets of version 5, event-log blocks, blocks of any bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER, RECORD = 24, 48
FLOW_RECORD = np.dtype([("src", ">u4"), ("dst", ">u4"), ("next_hop", ">u4"), ("input", ">u2"), ("output", ">u2"), ("packets", ">u4"), ("bytes", ">u4"), ("first", ">u4"), ("last", ">u4"), ("src_port", ">u2"), ("dst_port", ">u2"), ("pad1", "u1"), ("flags", "u1"), ("protocol", "u1"), ("tos", "u1"), ("src_as", ">u2"), ("dst_as", ">u2"), ("src_mask", "u1"), ("dst_mask", "u1"), ("pad2", ">u2")])
FLOW_SCHEMA = "path string, packet long, record long, src long, dst long, packets long, bytes long, src_port int, dst_port int, protocol int"


def flow_records(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Records, the number of the packet of each, and how many bytes were read: reading stops at a packet that is cut off or of another version."""
    found, packets, at, n = [], [], 0, 0
    while at + HEADER <= len(data):
        version, count = int.from_bytes(data[at : at + 2]), int.from_bytes(data[at + 2 : at + 4])
        end = at + HEADER + count * RECORD
        if version != 5 or end > len(data):
            break
        found.append(np.frombuffer(data, FLOW_RECORD, count, at + HEADER))
        packets.append(np.full(count, n))
        at, n = end, n + 1
    return (np.concatenate(found) if found else np.empty(0, FLOW_RECORD)), (np.concatenate(packets) if packets else np.empty(0, np.int64)), at


def flows(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                rows, packet, _ = flow_records(bytes(data or b""))
                yield pd.DataFrame({"path": name, "packet": packet, "record": np.arange(len(rows)), **{c: rows[c].astype(np.int64) for c in ("src", "dst", "packets", "bytes")}, **{c: rows[c].astype(np.int32) for c in ("src_port", "dst_port", "protocol")}})

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, FLOW_SCHEMA)


def flow_search(df: DataFrame, ip: str) -> DataFrame:
    """Records from or to an address: a typed comparison on both fields."""
    parts = [int(x) for x in ip.split(".")]
    value = sum(x << 8 * (3 - k) for k, x in enumerate(parts))
    return df.where((F.col("src") == value) | (F.col("dst") == value))


WIDE, NARROW = re.compile(rb"(?:[\x20-\x7e]\x00){3,}"), re.compile(rb"[\x20-\x7e]{4,}")


def block_tokens(df: DataFrame, path: str = "path", content: str = "content", block: int = 2 << 20) -> DataFrame:
    """path, block_id, wide (UTF-16 text), token: readable runs per block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                data = bytes(data or b"")
                for at in range(0, len(data), block):
                    piece = data[at : at + block]
                    rows = [(True, m[0].decode("utf-16-le")) for m in WIDE.finditer(piece)] + [(False, m[0].decode()) for m in NARROW.finditer(piece)]
                    yield pd.DataFrame({"path": name, "block_id": at // block, "wide": [w for w, _ in rows], "token": [t for _, t in rows]}).astype({"block_id": "int64", "wide": "bool", "token": "object"})

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, block_id long, wide boolean, token string")


def universal_blocks(df: DataFrame, path: str = "path", content: str = "content", block: int = 512 << 10) -> DataFrame:
    """path, block_id, token: words of four or more, with long hex and base64 runs whole. Blocks end at a line feed, so no word is cut."""
    word = re.compile(rb"[0-9a-fA-F]{16,}|[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_]{4,}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                data, at, k = bytes(data or b""), 0, 0
                while at < len(data):
                    end = min(len(data), at + block)
                    end = end if end == len(data) else (data.find(b"\n", end) + 1 or len(data))
                    found = sorted({m[0].decode() for m in word.finditer(data[at:end])})
                    yield pd.DataFrame({"path": name, "block_id": np.int64(k), "token": found}).astype({"block_id": "int64", "token": "object"})
                    at, k = end, k + 1

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, block_id long, token string")


def block_grep(df: DataFrame, query: str, path: str = "path", content: str = "content", block: int = 2 << 20) -> DataFrame:
    """path, block_id, hits: occurrences of the query as UTF-8 and as UTF-16LE. A block reads on past its end by the length of the query, so no occurrence is missed or counted twice.

    Every file has a block at least: an empty one has block 0 without hits, one whose content is null has block 0 with null.
    """
    needles = [query.encode(), query.encode("utf-16-le")]

    def counts(data) -> list[int | None]:
        if data is None:
            return [None]
        data = bytes(data)
        starts = [m.start() for n in needles if n for m in re.finditer(re.escape(n), data)]
        return np.bincount(np.array(starts, np.int64) // block, minlength=max(1, -(-len(data) // block))).tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(name, k, n) for name, data in zip(part["path"], part["content"], strict=True) for k, n in enumerate(counts(data))]
            names, blocks, hits = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"path": pd.Series(names, dtype="object"), "block_id": np.array(blocks, np.int64), "hits": pd.array(hits, "Int64")})

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, block_id long, hits long")
