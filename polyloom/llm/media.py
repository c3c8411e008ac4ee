"""Texts as media columns: a payload stored as lossless WebP images, read back, with features.

The payload is the text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64. Four bytes are one pixel (alpha, red,
green, blue), 16 pixels a row; every ``ROWS`` rows are an image of their own, and the files of a text follow one another (each
carries its length). Every image that needs no palette has a predictor, its modes chosen for each band of 16 rows, and cross-colour where it
pays, by the image's own bytes; reading inverts them. So no image is ever large, long texts are worked side by side, and a text has no greatest length.

Defined results: a null text counts as empty (64 zero bytes); equal texts get equal files and features; rows that repeat stay; an empty
table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common, webp

ROW_BYTES = 64
ROWS = 256
TILE = ROW_BYTES * ROWS


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW_BYTES) if data else bytes(ROW_BYTES)


def tiles(data: bytes) -> list[np.ndarray]:
    """The images of a payload."""
    return [np.frombuffer(data[a : a + TILE], ">u4").astype(np.uint32).reshape(-1, ROW_BYTES // 4) for a in range(0, len(data), TILE)]


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    images = [tiles(p) for p in payloads]
    files = webp.encode([x for own in images for x in own], transforms=None, block=4)
    at = np.cumsum([0, *map(len, images)])
    return [b"".join(files[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def split_files(stored: bytes) -> list[bytes]:
    """The WebP files that follow one another."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(stored[at : at + size])
        at += size
    return out


def load(stored: list[bytes]) -> tuple[list[bytes], list[list[np.ndarray]]]:
    """The payloads and the images, decoded from the stored forms."""
    files = [split_files(s) for s in stored]
    images = webp.decode([f for own in files for f in own])
    at = np.cumsum([0, *map(len, files)])
    own = [images[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return [b"".join(x.astype(">u4").tobytes() for x in group) for group in own], own


def feature(images: list[np.ndarray]) -> str:
    """Rows, the mean and the deviation of all samples, and of sixteen equal ranges of values those with the most samples first."""
    samples = np.concatenate([x.ravel() for x in images]).view(np.uint8)
    count = np.bincount(samples >> 4, minlength=16)
    top = np.argsort(-count, kind="stable")[:4]
    total, square = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    mean = total / len(samples)
    return f"rows={sum(len(x) for x in images)};mean={mean:.4f};sd={max(0.0, square / len(samples) - mean * mean) ** 0.5:.4f};top={'-'.join(map(str, top))}"


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with ``keep``, media (the stored bytes)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = common.raw(common.texts(batch))
            view = data.tobytes()
            texts = [view[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            stored = store([payload(t) for t in texts])
            back, images = load(stored)
            ints = lambda x: pa.array(list(x), pa.int64())
            strings = lambda x: pa.array(list(x), pa.string())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = {
                "id": common.column(batch, "id"),
                "n_bytes": ints(np.diff(at)),
                "payload_bytes": ints(map(len, back)),
                "payload_sha256": strings(map(sha, back)),
                "tail_crc32": ints(zlib.crc32(x[-ROW_BYTES:]) for x in back),
                "media_bytes": ints(map(len, stored)),
                "media_sha256": strings(map(sha, stored)),
                "feature": strings(map(feature, images)),
            }
            if keep:
                columns["media"] = pa.array(stored, pa.binary())
            return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * keep
    return common.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, schema).withColumnRenamed("id", id_col)
