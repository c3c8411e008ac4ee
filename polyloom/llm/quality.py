"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and labelled bad text. A text is cut into pieces of about 1 KB, every
piece is compressed with either dictionary, and the difference of the two sums over their total is its raw score; a logistic
curve fitted on the training documents makes it a probability of label 1.

Labels are fitted on a bounded sample of labelled documents: of each label about ``SAMPLE``, and no more than together hold ``SAMPLE_BYTES`` (both
parameters). Whole texts are read, there and in scoring.

Defined results: a null or empty text gets the curve's value at difference 0; rows that repeat get equal scores; with only one
label, or none, every score is the share of label 1 (0.5 without labels); rows without a label, or with a null one, train
nothing, nor do those with two labels; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.llm import common

SAMPLE, SAMPLE_BYTES = 1200, 8 << 20
PIECE_BYTES = 1024
DICTIONARY_BYTES = 48 << 10
LEVEL = 3


def pieces(data: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


@dataclasses.dataclass(frozen=True)
class Model:
    """Dictionaries (raw content), and the calibration: probability = 1 / (1 + exp(-(slope * difference + offset)))."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    @functools.cached_property
    def compressors(self):
        def of(content):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        return of(self.good), of(self.bad)

    def difference(self, data: bytes) -> float:
        """Positive when the good dictionary compresses the text better; 0 for an empty text."""
        if not data or not self.good or not self.bad:
            return 0.0
        good, bad = self.compressors
        cut = pieces(data)
        g = sum(len(good.compress(p)) for p in cut)
        b = sum(len(bad.compress(p)) for p in cut)
        return (b - g) / (b + g)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(difference, float) + self.offset, -50, 50)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton's method, with a small ridge so that separable data stay finite."""
    scale = np.std(x) or 1.0
    z, w = x / scale, np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -50, 50)))
        a = np.stack([z, np.ones_like(z)])
        gradient = a @ (weight * (p - y)) + 1e-4 * w
        hessian = (a * (weight * p * (1 - p))) @ a.T + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little text for that, the text itself."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def train(rows: list[tuple[int, int, list[bytes]]]) -> Model:
    """rows: id, label and pieces. Even rows build the dictionaries, odd rows fit the curve."""
    rows = sorted(rows, key=lambda r: r[0])
    labels = np.array([r[1] for r in rows], int)
    share = float(labels.mean()) if len(labels) else 0.5
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(set(labels.tolist())) < 2:
        return Model(b"", b"", 0.0, prior if len(labels) else 0.0)
    build, fit = [], []
    for label in (0, 1):
        own = [r for r in rows if r[1] == label]
        build += own[::2]
        fit += own[1::2] or own
    content = {k: dictionary([p for r in build if r[1] == k for p in r[2] if p]) for k in (0, 1)}
    raw = Model(content[1], content[0], 1.0, 0.0)
    x = np.array([raw.difference(b"".join(r[2])) for r in fit])
    slope, offset = fit_curve(x, np.array([r[1] for r in fit], float))
    return dataclasses.replace(raw, slope=slope, offset=offset)


def training_rows(docs: DataFrame, labels: DataFrame, keep, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[int, int, list[bytes]]]:
    """The bounded training sample: about ``sample`` labelled documents of each label, in the order of a hash of their ids until they hold ``SAMPLE_BYTES`` (the first in any case), whole."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & keep).groupBy(id_col).agg(F.max(label_col).alias("label_"), F.min(label_col).alias("least_"))
    known = common.bounded_sample(known.where("label_ = least_").select(F.col(id_col).alias("id_"), "label_"), "id_", sample, "label_")
    chosen = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(known), "id_")  # a sample of a bounded number of rows
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label_").orderBy(F.xxhash64(F.col("id_").cast("string")), "id_", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("before_", F.coalesce(size, F.lit(0))).where(F.col("before_") < SAMPLE_BYTES).drop("before_")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in common.texts(batch).to_pylist():
                out.append(pieces((text or "").encode()))
            return pa.RecordBatch.from_arrays([common.column(batch, "id_").cast(pa.int64()), common.column(batch, "label_").cast(pa.int64()), pa.array(out, pa.list_(pa.binary()))], names=["id_", "label_", "pieces"])

        return work

    rows = common.map_arrow(chosen.select(F.col("id_").cast("bigint"), F.col("label_").cast("bigint"), "text"), make, "id_ bigint, label_ bigint, pieces array<binary>").collect()
    return [(r["id_"], r["label_"], [bytes(p) for p in r["pieces"]]) for r in rows]


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and quality_score. Extra columns are kept; one of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(dataclasses.astuple(model))
    docs = docs.drop("quality_score")

    def make():
        own = Model(*shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = common.raw(common.texts(batch, text_col))
            view = data.tobytes()
            x = own.probability([own.difference(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.float64())], names=[*batch.schema.names, "quality_score"])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_arrow(docs, make, f"{schema}, quality_score double", by=text_col)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep=None, **columns) -> Model:
    return train(training_rows(docs, labels, F.lit(True) if keep is None else keep, **columns))
