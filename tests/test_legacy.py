"""The reader of older archives against files that this test lays out byte by byte."""

import json
import struct

import numpy as np
import pytest

from strataq.operators.commit import length_prefix
from strataq.sources import legacy

zstandard = pytest.importorskip("zstandard")


def zigzag(values):
    out, last = b"", 0
    for v in values:
        d = v - last
        out, last = out + length_prefix(2 * d if d >= 0 else -2 * d - 1), v
    return out


def fixed(values, kind="<i4"):
    return bytes([np.dtype(kind).itemsize]) + np.diff(values, prepend=0).astype(kind).tobytes()


def word(x):
    return length_prefix(len(x.encode())) + x.encode()


def layout(columns, rows, single=False):
    pack = zstandard.ZstdCompressor().compress
    order = json.dumps(list(columns)).encode()
    head = (b"COL3" if single else b"COL2") + struct.pack("<IHB", rows, len(columns), 1) + struct.pack("<I", len(order)) + order + struct.pack("<I", 0)
    if not single:
        return head + b"".join(word(n) + struct.pack("<I", len(p := pack(body))) + p for n, body in columns.items())
    directory = b"".join(word(n) + struct.pack("<I", len(body)) for n, body in columns.items())
    body = pack(b"".join(columns.values()))
    return head + struct.pack("<I", len(directory)) + directory + struct.pack("<I", len(body)) + body


ROWS = 40
ON = bytes([1] * ROWS)
HALF = bytes(i % 2 for i in range(ROWS))
COLUMNS = {
    "none": b"\0",
    "int": b"\x05" + ON + fixed([1000 + i * i for i in range(ROWS)]),
    "some": b"\x05" + HALF + zigzag([1, *range(-5, 14)]),
    "float": b"\x03\x01" + HALF + struct.pack("<20d", *(i / 4 for i in range(20))),
    "dict": b"\x01" + length_prefix(2) + word("é") + word("b") + bytes([0, 1, 255, 1] * 10),
    "wide": b"\x07" + struct.pack("<H", 1) + word("w") + struct.pack("<40H", *([0, 0xFFFF] * 20)),
    "joined": b"\x09" + struct.pack("<I", 3) + b"x\0y" + fixed([i % 2 for i in range(ROWS)], "<i1"),
    "name": b"\x06" + word("n-") + b"\x04" + ON + fixed(list(range(7, 7 + ROWS)), "<i1"),
    "time": b"\x08" + ON + b"\x01Z" + fixed([1700000000 + i for i in range(ROWS)]),
    "raw": b"\x02" + b"\0".join(b"\x01" if i == 3 else f"r{i}".encode() for i in range(ROWS)),
    "nested": b"\x04" + b"\0".join(b'{"a":[1]}' for _ in range(ROWS)),
}


@pytest.mark.parametrize("single", [False, True])
def test_all_modes(single):
    got = [json.loads(x) for x in legacy.json_lines(layout(COLUMNS, ROWS, single))]
    assert len(got) == ROWS and "none" not in got[0] and "raw" not in got[3] and "dict" not in got[2]
    assert got[5] == {"int": 1025, "some": -4, "float": 0.5, "dict": "b", "joined": "y", "name": "n-0012", "time": "2023-11-14T22:13:25Z", "raw": "r5", "nested": {"a": [1]}}
    assert list(got[0]) == [k for k in COLUMNS if k in got[0]] and got[1]["some"] == 1


def test_short_runs_that_look_like_a_width():
    body = b"\x05" + bytes([1] * 3) + zigzag([1, 2, 3])
    assert [json.loads(x)["v"] for x in legacy.json_lines(layout({"v": body}, 3))] == [1, 2, 3]


def test_broken_archives_raise():
    good = layout(COLUMNS, ROWS)
    for bad in (b"", b"COL", b"XXXX" + good[4:], good[2:], good[:-3], layout({"v": b"\x63"}, 2), layout({"v": b"\x02a"}, 2)):
        with pytest.raises(ValueError):
            legacy.json_lines(bad)


def test_through_spark(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(layout(COLUMNS, ROWS))
    (tmp_path / "b.bin").write_bytes(layout(COLUMNS, ROWS, True))
    df = legacy.read_legacy(spark, str(tmp_path))
    assert df.count() == 2 * ROWS and df.select("value").distinct().count() == ROWS
