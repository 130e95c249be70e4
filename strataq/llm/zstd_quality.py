"""Quality by compression: zstandard dictionaries from good and bad labelled text.

One dictionary holds pieces of texts labelled good, the other pieces of texts
labelled bad. A text is cut into segments of ``SEGMENT`` bytes, so that the
dictionaries, not the text itself, are what a segment is compared with however
long the text is, and each segment is compressed with either one. The score
rests on one number: the difference of both compressed sizes, normalised by the
bytes of the text. As a few bytes say little, each text counts with EVIDENCE more
bytes of the mean difference of the labelled texts. A logistic calibration that
rises with it, fitted on labelled texts that are in neither dictionary, makes it
the chance of label 1.

The model is fitted on a bounded sample: ``SAMPLE`` labelled rows of each class,
those with the smallest hash of the id. Of each class, FOR_CALIBRATION goes to
the calibration, which uses whole texts. A dictionary has DICTIONARY_BYTES; all
texts of its part have an equal share of them, short ones whole and long ones by
pieces at even distances over their whole length. Neither bound depends on the
input; all rows are scored, over their whole texts.

The calibration is the minimum of a strictly convex function of two numbers,
found by Newton steps that are halved until the loss falls; a fit that does not
reach GRADIENT raises. So the model follows from the set of labelled rows, not
from their order.

Cases: null and empty texts get a score like any other. Without labels of one
class every text scores the share of label 1 among the labels (1.0 without any
label). A class with too few texts for both parts is calibrated on the texts of
its dictionary as well. Repeated rows get equal scores. If an id has several
texts, the smallest of them is the one that its label trains. An id with both
labels counts in both classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import map_texts, packed
from .components import cut

SAMPLE = 1500
DICTIONARY_BYTES, PIECE, SEGMENT, LEVEL = 524_288, 512, 2048, 6
FOR_CALIBRATION = 0.3
EVIDENCE = 64
RIDGE, GRADIENT, STEPS = 1e-5, 1e-9, 200
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class QualityModel:
    """The two dictionaries, the mean difference and the calibration: chance of label 1 = logistic(slope * smoothed difference + offset)."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    mean: float = 0.0

    def scorer(self):
        """A function from text to score; makes the compressors once."""
        if not self.good:
            return lambda text: logistic(self.offset)
        of = differ(self.good, self.bad)
        return lambda text: logistic(self.slope * smoothed(*of(text), self.mean) + self.offset)


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(max(z, -700.0)) / (1 + math.exp(max(z, -700.0)))


def logit(share: float) -> float:
    """Finite, for shares of 0 and 1 as well."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    return math.log(share / (1 - share))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def differ(good: bytes, bad: bytes):
    """A function from text to the bytes that the good dictionary saves against the bad one, and the bytes of the text."""
    pair = [compressor(x) for x in (good, bad)]

    def of(text: str) -> tuple[int, int]:
        raw = text.encode("utf-8", "replace")
        parts = [raw[k : k + SEGMENT] for k in range(0, len(raw), SEGMENT)]
        a, b = (sum(len(c.compress(p)) for p in parts) for c in pair)
        return b - a, len(raw)

    return of


def smoothed(saved, size, mean: float):
    """The normalised difference, with EVIDENCE bytes of the mean one."""
    return (saved + EVIDENCE * mean) / (size + EVIDENCE)


def even_pieces(raw: bytes, most: int) -> bytes:
    """``raw``, or pieces of it at even distances that make up at most ``most`` bytes (one piece at least)."""
    if len(raw) <= most:
        return raw
    n = max(1, most // PIECE)
    return b"".join(raw[len(raw) * k // n :][:PIECE] for k in range(n))


def equal_share(sizes: list[int], total: int) -> int:
    """The largest size such that sizes cut to it sum up to no more than ``total``."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return max(sizes, default=0)


def dictionary(pieces: list[bytes]) -> bytes:
    """The same for any order of ``pieces``."""
    return b"\n".join(sorted(pieces))[:DICTIONARY_BYTES].ljust(8, b"\n")


def weights_of(label: np.ndarray, prior: float) -> np.ndarray:
    """The classes weigh ``prior`` and 1 - ``prior``, however many rows were taken of each."""
    return np.where(label == 1, prior / max((label == 1).sum(), 1), (1 - prior) / max((label == 0).sum(), 1))


def calibrated(difference: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """slope (0 or more) and offset of the logistic function."""
    order = np.lexsort((label, difference))  # sums do not depend on the order of the rows
    x, y = np.asarray(difference, float)[order], np.asarray(label, float)[order]
    weight = weights_of(y, prior)
    middle, spread = float((weight * x).sum() / weight.sum()), float(x.std()) or 1.0
    x = (x - middle) / spread
    columns = np.c_[x, np.ones(len(x))]

    def loss(w: np.ndarray) -> float:
        z = columns @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * (w @ w))

    def slope_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 0.5 * (1 + np.tanh(columns @ w / 2))
        return columns.T @ (weight * (p - y)) + RIDGE * w, p

    w = np.array([0.0, logit(prior)])
    for _ in range(STEPS):
        g, p = slope_of(w)
        if np.abs(g).max() < GRADIENT:
            break
        step = np.linalg.solve((columns.T * (weight * p * (1 - p))) @ columns + RIDGE * np.eye(2), g)
        now, size = loss(w), 1.0
        while loss(w - size * step) > now - 1e-4 * size * (g @ step) and size > 1e-10:
            size /= 2
        w = w - size * step
    else:
        raise ArithmeticError(f"The calibration did not converge: gradient {np.abs(g).max()}")
    if w[0] <= 0:  # the difference says nothing here
        return 0.0, logit(prior)
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """(id, label, text, fit) of at most 2 * SAMPLE rows, ``fit`` telling what is for the dictionaries, and the share of label 1 among all usable labels."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string")) % FOLDS != 0))
    n, ones = usable.agg(F.count(F.lit(1)), F.sum("label")).first()
    picked = [usable.where(F.col("label") == k).select("id", "label").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for k in (1, 0)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * SAMPLE rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    fit = F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1000)) >= int(FOR_CALIBRATION * 1000)  # copies of a text are on one side
    return found.withColumn("fit", fit), ones / n if n else 1.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns only from rows whose fold is not 0."""
    sample, prior = labelled_sample(docs, labels, id_col, text_col, label_col)
    sample = cut(sample)
    have = {(r["label"], r["fit"]) for r in sample.select("label", "fit").distinct().collect()}  # at most 4 rows
    if len({k for k, _ in have}) < 2:
        return QualityModel(b"", b"", 0.0, logit(prior))
    both = all((k, f) in have for k in (0, 1) for f in (False, True))
    parts = sample.where("fit") if both else sample

    # Only what a dictionary can hold comes to the driver: a part of a text that it cuts is longer than its share.
    sizes = parts.select("label", F.octet_length("text").alias("n")).collect()
    pieces = {k: max(PIECE, equal_share([r["n"] for r in sizes if r["label"] == k], DICTIONARY_BYTES)) for k in (0, 1)}

    @F.pandas_udf(T.BinaryType())
    def shares(texts: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series([even_pieces(t.encode("utf-8", "replace"), pieces[k]) for t, k in zip(texts, label, strict=True)], dtype=object)

    held = [(r[0], bytes(r[1])) for r in parts.select("label", shares("text", "label")).collect()]
    good, bad = (dictionary([raw for k, raw in held if k == wanted]) for wanted in (1, 0))

    @F.pandas_udf("saved long, size long")
    def savings(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = differ(good, bad)
        for texts in batches:
            yield pd.DataFrame([of(t) for t in texts], columns=["saved", "size"])

    rest = sample.where(~F.col("fit")) if both else sample
    told = np.array(sorted(tuple(r) for r in rest.select(savings("text").alias("s"), "label").select("label", "s.*").collect()), float)  # at most 2 * SAMPLE rows of numbers
    return fitted(good, bad, told, prior)


def fitted(good: bytes, bad: bytes, told: np.ndarray, prior: float) -> QualityModel:
    """The model from rows of label, bytes saved and size."""
    label, saved, size = told[np.lexsort(told.T)].T
    mean = float((weights_of(label, prior) * saved / np.maximum(size, 1)).sum())
    return QualityModel(good, bad, *calibrated(smoothed(saved, size, mean), label, prior), mean)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score."""

    def make():
        f = model.scorer()
        return lambda texts: [[f(t) for t in texts]]

    return map_texts(docs, id_col, text_col, T.StructType([T.StructField("score", T.DoubleType())]), make)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD."""

    @F.pandas_udf(T.DoubleType())
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = None
        for texts in parts:
            f = f or model.scorer()
            yield pd.Series([f(t or "") for t in texts], dtype="float64")

    return packed(docs, score=scores(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).where(F.col("score") >= THRESHOLD).select("row.*")
