"""ISO base media containers: write, walk, and read sample tables without touching payloads.

``mux`` stores bytes as 8 x 8 frames of 8-bit grey samples (64 bytes a frame)
in a one-track container. ``tracks`` walks the nested boxes of any such file
and decodes its sample tables only; ``payload`` then reads the sample bytes.

Cases: null or empty text is one frame of zeros. Bytes that are no container,
truncated boxes and impossible sizes give no track and a text in ``error``;
they never raise. 64-bit box sizes, boxes that run to the end, compact sample
sizes and both chunk offset tables are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._batches import map_texts

UNIT, PER_CHUNK, KEY_EVERY, TIMESCALE = 64, 256, 32, 25
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
MAX_DEPTH = 16
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

TRACK = T.StructType(
    [
        T.StructField("handler", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("timescale", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("sample_bytes", T.LongType()),
        T.StructField("keyframes", T.LongType()),
        T.StructField("keyframe_ranges", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def mux(data: bytes) -> bytes:
    """A container whose samples are ``data``, a positive multiple of UNIT bytes."""
    frames = len(data) // UNIT
    chunks = -(-frames // PER_CHUNK)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    entry = struct.pack(">6xH16xHHIIIH32xHh", 1, 8, 8, 0x480000, 0x480000, 0, 1, 40, -1)
    runs = [(1, PER_CHUNK)] if frames % PER_CHUNK == 0 else [(1, PER_CHUNK)] * (chunks > 1) + [(chunks, frames % PER_CHUNK)]

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * UNIT * PER_CHUNK
        wide = first + len(data) > 0xFFFFFFFF
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", k, n, 1) for k, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), IDENTITY, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), IDENTITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    head = len(ftyp) + len(moov(0)) + 8
    if head + len(data) > 0xFFFFFFFF:
        raise ValueError("payload of more than 4 GB")
    return ftyp + moov(head) + struct.pack(">I4s", len(data) + 8, b"mdat") + data


def walk(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, depth, start of body, end of body), in file order; stops at the first impossible box."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("truncated box header")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if at + size > end or size < body - at:
            raise ValueError(f"impossible size of box {bytes(kind)!r}")
        yield kind, depth, body, at + size
        if kind in CONTAINERS and depth < MAX_DEPTH:
            yield from walk(data, body, at + size, depth + 1)
        at += size
    if at != end:
        raise ValueError("bytes behind the last box")


def table(data: memoryview, at: int, end: int, kind: str, per_row: int = 1) -> np.ndarray:
    """Rows of a counted table behind version and flags."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * per_row * np.dtype(kind).itemsize > end:
        raise ValueError("table longer than its box")
    return np.frombuffer(data, kind, n * per_row, at + 8).astype(np.int64).reshape(n, per_row)


def sample_places(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample."""
    offsets, runs, sizes = x["offsets"], x["runs"], x["sizes"]
    chunk = np.arange(1, len(offsets) + 1)
    per = runs[np.maximum(np.searchsorted(runs[:, 0], chunk, "right") - 1, 0), 1] if len(runs) else np.zeros(len(chunk), np.int64)
    if per.sum() != len(sizes):
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    has = per > 0
    base = np.repeat(offsets[has] - before[first[has]], per[has])
    return base + before, sizes


def read_tracks(data: bytes) -> list[dict]:
    """The tables of each track; raises ValueError or struct.error on a broken file."""
    view = memoryview(data)
    out: list[dict] = []
    for kind, _, a, b in walk(view, 0, len(view)):
        if kind == b"trak":
            out.append({"sizes": np.empty(0, np.int64), "offsets": np.empty(0, np.int64), "runs": np.empty((0, 3), np.int64), "keys": None})
        if not out:
            continue
        x = out[-1]
        if kind == b"mdhd":
            x["timescale"], x["duration"] = struct.unpack_from(">IQ", view, a + 20) if view[a] == 1 else struct.unpack_from(">II", view, a + 12)
        elif kind == b"hdlr":
            x["handler"] = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd" and b - a >= 16:
            x["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1")
            if x.get("handler") == "vide" and b - a >= 44:
                x["width"], x["height"] = struct.unpack_from(">HH", view, a + 40)
        elif kind == b"stts":
            times = table(view, a, b, ">u4", 2)
            x["length"] = int((times[:, 0] * times[:, 1]).sum())
        elif kind == b"stss":
            x["keys"] = table(view, a, b, ">u4")[:, 0]
        elif kind == b"stsc":
            x["runs"] = table(view, a, b, ">u4", 3)
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", view, a + 4)
            if one and n * one > len(data):
                raise ValueError("more samples than bytes")
            x["sizes"] = np.full(n, one, np.int64) if one else table(view, a + 4, b, ">u4")[:, 0]
        elif kind == b"stz2":
            bits, n = view[a + 7], struct.unpack_from(">I", view, a + 8)[0]
            if bits == 4:
                raw = np.frombuffer(view, np.uint8, (n + 1) // 2, a + 12)
                x["sizes"] = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
            else:
                x["sizes"] = table(view, a + 4, b, ">u2" if bits == 16 else "u1")[:, 0]
        elif kind in (b"stco", b"co64"):
            x["offsets"] = table(view, a, b, ">u4" if kind == b"stco" else ">u8")[:, 0]
    for x in out:
        x["at"], _ = sample_places(x)
        if len(x["at"]) and (x["at"].min() < 0 or (x["at"] + x["sizes"]).max() > len(data)):
            raise ValueError("samples outside the file")
    return out


def key_ranges(x: dict) -> list[dict]:
    """Byte ranges of the sync samples, those that touch joined."""
    at, sizes = x["at"], x["sizes"]
    if x["keys"] is not None:
        pick = x["keys"][(x["keys"] >= 1) & (x["keys"] <= len(at))] - 1
        at, sizes = at[pick], sizes[pick]
    if not len(at):
        return []
    fresh = np.r_[True, at[1:] != at[:-1] + sizes[:-1]]
    ends = np.r_[np.flatnonzero(fresh)[1:] - 1, len(at) - 1]
    return [{"start": int(a), "end": int(b)} for a, b in zip(at[fresh], (at + sizes)[ends], strict=True)]


def describe(data: bytes | None) -> tuple[list[dict], str | None]:
    """One record a track as in TRACK, and what is wrong with the file."""
    try:
        found = read_tracks(data or b"")
    except (ValueError, struct.error, IndexError) as e:
        return [], str(e)
    out = []
    for x in found:
        keys = len(x["at"]) if x["keys"] is None else len(x["keys"])
        out.append({"handler": x.get("handler"), "codec": x.get("codec"), "width": x.get("width"), "height": x.get("height"), "timescale": x.get("timescale"), "duration": x.get("length", x.get("duration")), "samples": len(x["at"]), "sample_bytes": int(x["sizes"].sum()), "keyframes": keys, "keyframe_ranges": key_ranges(x)})
    return out, None if found else "no track"


def payload(data: bytes) -> bytes:
    """The samples of the first track, in order."""
    x = read_tracks(data)[0]
    at, sizes = x["at"], x["sizes"]
    if not len(at):
        return b""
    fresh = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + sizes[:-1]])
    ends = np.r_[fresh[1:] - 1, len(at) - 1]
    return b"".join(data[a:b] for a, b in zip(at[fresh].tolist(), (at + sizes)[ends].tolist(), strict=True))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8, unpadded), media (binary): each text as a container."""

    def run(texts: list[str]) -> list:
        raw = [t.encode() for t in texts]
        return [[len(r) for r in raw], [mux(pad(r)) for r in raw]]

    return map_texts(df, id_col, text_col, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), lambda: run)


def media_columns(df: DataFrame, media_col: str = "media", with_payload: bool = False, rows: int = 256) -> DataFrame:
    """``df`` with ``tracks`` (array of TRACK) and ``error``; ``payload`` only if asked for.

    Columns of ``df`` with these names are replaced. Null media: no tracks, an error.
    """
    new = [T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("error", T.StringType())] + [T.StructField("payload", T.BinaryType())] * with_payload
    source = df.drop(*(f.name for f in new))
    schema = T.StructType([*source.schema.fields, *new])
    arrow, at = to_arrow_schema(schema), source.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                files = part.column(at).to_pylist()
                told = [describe(x) for x in files]
                more = [pa.array([t for t, _ in told], arrow.field("tracks").type), pa.array([e for _, e in told], pa.string())]
                if with_payload:
                    more.append(pa.array([None if e else payload(x) for x, (_, e) in zip(files, told, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)), *more], schema=arrow)

    return source.mapInArrow(run, schema)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and describes them; one row per input row."""
    read = media_columns(store_texts(df, id_col, text_col), with_payload=True)
    first = F.element_at("tracks", 1)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim(first["codec"])),
        F.concat(F.lit("handler="), first["handler"]),
        F.concat(F.lit("size="), first["width"].cast("string"), F.lit("x"), first["height"].cast("string")),
        F.concat(F.lit("timescale="), first["timescale"].cast("string")),
        F.concat(F.lit("duration="), first["duration"].cast("string")),
        F.concat(F.lit("samples="), first["samples"].cast("string")),
        F.concat(F.lit("keyframes="), first["keyframes"].cast("string")),
        F.concat(F.lit("ranges="), F.sha2(F.concat_ws(",", F.transform(first["keyframe_ranges"], lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))), 256)),
    )
    return read.select(
        id_col,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
