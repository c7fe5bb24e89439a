"""Compression classifier: zstandard dictionaries of good and of bad text; the normalised size difference, calibrated.

Every text is cut into chunks of about CHUNK bytes, each compressed alone with either dictionary, so a long text is judged
by all of it and never by what its own beginning taught the compressor. Feature: (bad size - good size) / (bad size + good size)
over the chunks' sums. A logistic curve fitted on labelled rows that gave nothing to the dictionaries makes it a score.

Fit on a bounded sample of labelled rows (max_rows of learn, MAX_ROWS here, by hash order): two thirds give the dictionaries'
samples, the rest calibrates. The driver holds at most max_chunks chunks of either label (a parameter of fit): of all chunks of
the whole texts those of the smallest hash, wherever they stand, chosen by one rule for both labels.

Nulls and empty texts: difference 0. Where a label gave no chunks, every score is the smoothed share of label 1 among all labelled
rows (0.5 without any). Where the rows kept for calibration are of one label or none, all labelled rows calibrate. Ties: chunks of
equal hash are equal. Repeated rows are scored each; an empty table gives an empty result. Ids are of any type. Very long texts
are compressed chunk by chunk. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from .common import Batches, batch, quoted, text_bytes

MAX_ROWS = 12_000
MAX_CHUNKS = 6_000
CHUNK = 1024
DICTIONARY = 112 << 10
LEVEL = 3


def chunks(text: bytes) -> list[bytes]:
    """Equal cuts of about CHUNK bytes."""
    n = max(1, round(len(text) / CHUNK))
    step = -(-len(text) // n) or 1
    return [text[i : i + step] for i in range(0, len(text), step)]


class Sizes:
    """Normalised difference of the compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._dictionary(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
        out = zstandard.ZstdCompressionDict(data)
        out.precompute_compress(level=LEVEL)
        return out

    def difference(self, text: bytes | None) -> float:
        parts = chunks(text or b"")
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.by)
        return (bad - good) / (bad + good) if parts else 0.0


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a small penalty on the slope. Labels weigh alike."""
    a, b, unit = 0.0, 0.0, max(1e-6, float(x.std()))
    z = x / unit
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * z).sum() + 1e-2 * a, g.sum()])
        a, b = a - step[0], b - step[1]
    return a / unit, b


def _sample(share: float) -> Callable[[Batches], Batches]:
    """Chunks of the dictionary rows whose hash is among the lowest share of all hashes; whole texts stay on executors."""
    below = int(share * 2**64)

    def run(batches: Batches) -> Batches:
        schema = pa.schema([("label", pa.int32()), ("chunk", pa.binary())])
        for b in batches:
            rows = [(label, c) for label, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True) for c in chunks(t or b"") if hash_order(c) < below]
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 2))

    return run


def _differences(good: bytes, bad: bytes) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        sizes = Sizes(good, bad)
        for b in batches:
            x = [sizes.difference(t) for t in text_bytes(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.float64())], names=[*b.schema.names[:-1], "difference"])

    return run


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float, intercept: float):
        self.good, self.bad, self.slope, self.intercept = good, bad, slope, intercept


def with_roles(labelled: DataFrame) -> DataFrame:
    """Equal texts have one role, so no text of the dictionaries calibrates."""
    return labelled.withColumn("role", F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(3)))


def fit(labelled: DataFrame, max_chunks: int = MAX_CHUNKS) -> Model:
    """labelled: label, text, role (0, 1: dictionary, 2: calibration); at most MAX_ROWS rows."""
    for_dictionaries = labelled.where("role < 2")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = {r[0]: r[1] for r in for_dictionaries.groupBy("label").agg(F.sum(F.greatest(F.lit(1.0), F.round(size / CHUNK)))).collect()}
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for label in samples:
        share = min(1.0, 1.25 * max_chunks / max(1, total.get(label) or 0))  # some over, so that the smallest max_chunks are among them
        rows = for_dictionaries.where(F.col("label") == label).select("label", "text").mapInArrow(_sample(share), "label int, chunk binary").toArrow()
        samples[label] = sorted(rows.column(1).to_pylist(), key=hash_order)[:max_chunks]
    if not samples[0] or not samples[1]:
        n1, n = labelled.agg(F.sum("label"), F.count("*")).first()
        rate = ((n1 or 0) + 1) / (n + 2)
        return Model(b"", b"", 0.0, math.log(rate / (1 - rate)))
    good, bad = dictionary(samples[1]), dictionary(samples[0])

    def differences(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = rows.select("label", "text").mapInArrow(_differences(good, bad), "label int, difference double").toArrow()
        return np.asarray(found.column(1).to_pylist(), float), np.asarray(found.column(0).to_pylist(), float)

    x, y = differences(labelled.where("role = 2"))
    if len(y) == 0 or y.min() == y.max():
        x, y = differences(labelled)
    return Model(good, bad, *calibrate(x, y))


def hash_order(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id, the size difference and a score in (0, 1) for every row."""
    given = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string"))
    x = given.mapInArrow(_differences(model.good, model.bad), T.StructType([given.schema[0], T.StructField("difference", T.DoubleType())]))
    z = F.lit(model.slope) * F.col("difference") + F.lit(model.intercept)
    return x.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))
