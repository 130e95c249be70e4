"""Reads older columnar archives: per-column or one-frame zstd, magic COL1 (no zone header), COL2 or COL3.

Only reading; new archives are Parquet. A file is one unit of work, its columns
are decoded with numpy and come out as JSON lines with dense row numbers.
Runs of 32 whole numbers or fewer are always variable-length there, longer ones
have a width byte if the sizes agree; that rule reads every file right that the
writer can make, including short runs that start with 1, 2, 4 or 8.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC_OLDEST, MAGIC_FRAMES, MAGIC_SINGLE = b"COL1", b"COL2", b"COL3"
NULL_CELL, SEPARATOR = b"\x01", b"\x00"
SHORT = 32


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("truncated archive")
        self.at += n
        return self.data[self.at - n : self.at]

    def rest(self) -> bytes:
        return self.take(len(self.data) - self.at)

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def varint(self) -> int:
        value = shift = 0
        while (b := self.take(1)[0]) & 0x80:
            value, shift = value | (b & 0x7F) << shift, shift + 7
        return value | b << shift

    def text(self, n: int) -> str:
        return self.take(n).decode()


def deltas(c: Cursor, n: int) -> list[int]:
    raw = c.rest()
    if n > SHORT and raw and raw[0] in (1, 2, 4, 8) and len(raw) == 1 + n * raw[0]:
        return np.cumsum(np.frombuffer(raw, f"<i{raw[0]}", n, 1).astype(np.int64)).tolist()
    inner, out, last = Cursor(raw), [], 0
    for _ in range(n):
        z = inner.varint()
        last += z // 2 if z % 2 == 0 else -(z + 1) // 2
        out.append(last)
    return out


def placed(mask: bytes, values: list) -> list:
    """Values at the rows whose mask byte is set, null elsewhere."""
    out = np.full(len(mask), None, object)
    on = np.flatnonzero(np.frombuffer(mask, np.uint8))
    column = np.empty(len(values), object)
    column[:] = values
    out[on] = column
    return out.tolist()


def present(mask: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(mask, np.uint8)))


def entries(c: Cursor, n: int) -> list[str]:
    return [c.text(c.varint()) for _ in range(n)]


def small_dictionary(c: Cursor, rows: int) -> list:
    words = [*entries(c, c.varint())]
    words += [None] * (256 - len(words))
    return [words[k] for k in c.take(rows)]


def wide_dictionary(c: Cursor, rows: int) -> list:
    words = entries(c, c.number(2))
    return [None if k == 0xFFFF else words[k] for k in np.frombuffer(c.take(2 * rows), "<u2").tolist()]


def joined_dictionary(c: Cursor, rows: int) -> list:
    words = c.take(c.number(4)).decode().split(SEPARATOR.decode())
    return [words[k] if k < len(words) else None for k in deltas(c, rows)]


def eight_bytes(c: Cursor, rows: int) -> list:
    kind = "<f8" if c.number(1) == 1 else "<i8"
    mask = c.take(rows)
    return placed(mask, np.frombuffer(c.take(8 * present(mask)), kind).tolist())


def whole(c: Cursor, rows: int) -> list:
    mask = c.take(rows)
    return placed(mask, deltas(c, present(mask)))


def numbered(c: Cursor, rows: int) -> list:
    prefix, width = c.text(c.varint()), c.number(1)
    mask = c.take(rows)
    return placed(mask, [prefix + str(k).zfill(width) for k in deltas(c, present(mask))])


def instants(c: Cursor, rows: int) -> list:
    mask = c.take(rows)
    tail, start = c.text(c.number(1)), datetime(1970, 1, 1, tzinfo=UTC)
    return placed(mask, [(start + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S") + tail for s in deltas(c, present(mask))])


def cells(make):
    def read(c: Cursor, rows: int) -> list:
        return [None if x == NULL_CELL else make(x) for x in c.rest().split(SEPARATOR)]

    return read


DECODERS = {1: small_dictionary, 2: cells(bytes.decode), 3: eight_bytes, 4: cells(json.loads), 5: whole, 6: numbered, 7: wide_dictionary, 8: instants, 9: joined_dictionary}


def column(payload: bytes, rows: int) -> list:
    if payload == b"\0":
        return [None] * rows
    c = Cursor(payload)
    mode = c.number(1)
    if mode not in DECODERS:
        raise ValueError(f"unknown column mode {mode}")
    values = DECODERS[mode](c, rows)
    if len(values) != rows:
        raise ValueError("column and row count disagree")
    return values


def decode(data: bytes) -> tuple[list[str], dict[str, list], int]:
    """Key order, columns and row count of an archive; ValueError if it is none or broken."""
    import zstandard

    c = Cursor(data)
    magic = c.take(min(4, len(data)))
    if magic not in (MAGIC_OLDEST, MAGIC_FRAMES, MAGIC_SINGLE):
        raise ValueError("no archive of this kind")
    unpack = zstandard.ZstdDecompressor().decompress
    rows, n, _ = c.number(4), c.number(2), c.number(1)
    keys = json.loads(c.take(c.number(4)))
    if magic != MAGIC_OLDEST:
        c.take(c.number(4))  # zone header
    columns: dict[str, list] = {}
    try:
        if magic != MAGIC_SINGLE:
            for _ in range(n):
                name = c.text(c.varint())
                columns[name] = column(unpack(c.take(c.number(4))), rows)
        else:
            directory, sizes = Cursor(c.take(c.number(4))), []
            while directory.at < len(directory.data):
                name = directory.text(directory.varint())
                sizes.append((name, directory.number(4)))
            body = Cursor(unpack(c.take(c.number(4))))
            for name, size in sizes:
                columns[name] = column(body.take(size), rows)
    except zstandard.ZstdError as e:
        raise ValueError(f"damaged frame: {e}") from e
    return keys, columns, rows


def json_lines(data: bytes) -> list[str]:
    """One object per row, keys in order, nulls left out."""
    keys, columns, rows = decode(data)
    return [json.dumps({k: columns[k][i] for k in keys if k in columns and columns[k][i] is not None}, separators=(",", ":"), ensure_ascii=False) for i in range(rows)]


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """path, row_id (from 0 in each file) and value (JSON) of all archives under ``path``; a broken one raises."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                lines = json_lines(bytes(data))
                yield pd.DataFrame({"path": name, "row_id": np.arange(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInPandas(run, "path string, row_id long, value string")
