"""Value encodings as column expressions: zigzag, varint length, delta width, suffix, ISO time, IPv4, hex and base64."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
SUFFIX = "^(.*?)([0-9]+)$"
IPV4 = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
HEX_TOKEN, BASE64_TOKEN = "[0-9a-fA-F]{16,}", "[A-Za-z0-9+/]{20,}={0,2}"


def zigzag(c: Column) -> Column:
    """Signed 64-bit to non-negative order: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(c.cast("long"), 1).bitwiseXOR(F.shiftright(c.cast("long"), 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c.cast("long"), 1).bitwiseXOR(-c.cast("long").bitwiseAND(F.lit(1)))


def varint_bytes(c: Column) -> Column:
    """Length of a non-negative value at seven bits a byte; values with the top bit set take ten."""
    out = F.when(c < 0, 10)
    for k in range(1, 9):
        out = out.when(c < (1 << 7 * k), k)
    return out.otherwise(9)


def delta_width(low: Column, high: Column) -> Column:
    """Bytes (1, 2, 4, 8) that hold every delta between low and high."""
    out = None
    for width in (1, 2, 4):
        fits = (low >= -(1 << 8 * width - 1)) & (high < (1 << 8 * width - 1))
        out = F.when(fits, width) if out is None else out.when(fits, width)
    return out.otherwise(8)


def suffix_parts(c: Column) -> Column:
    """struct<prefix, digits>, null where there is no trailing number."""
    return F.when(c.rlike("[0-9]$"), F.struct(F.regexp_extract(c, SUFFIX, 1).alias("prefix"), F.regexp_extract(c, SUFFIX, 2).alias("digits")))


def is_iso(c: Column) -> Column:
    return c.rlike(ISO)


def iso_seconds(c: Column) -> Column:
    """Seconds since the epoch, with the offset of each value; null if it is no time."""
    return F.when(is_iso(c), F.unix_timestamp(F.try_to_timestamp(c)))


def ipv4_to_long(c: Column) -> Column:
    parts = F.split(c, "[.]")
    value = F.lit(0).cast("long")
    for k in range(4):
        value = value * 256 + F.get(parts, F.lit(k)).try_cast("long")
    return F.when(c.rlike(IPV4), value)


def long_to_ipv4(c: Column) -> Column:
    return F.concat_ws(".", *(F.floor(c / (1 << s)).cast("long").bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def hex_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({HEX_TOKEN})"))


def liftable_hex(token: Column) -> Column:
    """Whether bytes bring the token back exactly: even length and one case."""
    return (F.length(token) % 2 == 0) & ((token == F.lower(token)) | (token == F.upper(token)))


def liftable_base64(token: Column) -> Column:
    raw = F.call_function("try_to_binary", token, F.lit("base64"))
    return F.coalesce(F.base64(raw) == token, F.lit(False))


def null_mask(c: Column) -> Column:
    return c.isNotNull().cast("int")


def canonical_json(value) -> str:
    """Sorted keys, no spaces, characters as they are; numbers that JSON lacks are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def shannon(counts: list[int]) -> float:
    total = sum(counts)
    return -sum(n / total * math.log2(n / total) for n in counts if n) if total else 0.0
