"""Shared parts of the training-data operators: table access, Arrow batches, word hashing and shared storage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.operators.shared import checkpoint_dir

#: Rows and bytes in one Arrow batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bytes of text a Python worker works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set it is a local one in local mode, as in tests, and an error elsewhere."""
    return checkpoint_dir(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder; the tables of a session go when its driver ends."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/polyloom/{spark.sparkContext.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_forget, spark, own)
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


_FOLDERS: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete a session's folder, if its JVM is still there to do it."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def slices(batch: pa.RecordBatch, by: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of the column ``by``."""
    column = batch.column(batch.schema.get_field_index(by))
    if not len(column):
        return
    size = np.cumsum(np.maximum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), 16))
    cut = np.flatnonzero(np.diff(size // limit)) + 1
    for a, b in zip([0, *cut], [*cut, len(column)], strict=True):
        yield batch.slice(a, b - a)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's Arrow operators by rows and bytes (Spark takes these from the session alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, by: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply to every batch, in slices of about ``limit`` bytes of the column ``by``, what ``make`` returns; ``make`` runs once in each task. Row counts may change."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()  # Spark uses its workers again: what ``make`` sets is set back
        try:
            work = make()
            for batch in batches:
                for part in slices(batch, by, limit) if by else [batch]:
                    yield work(part)
        finally:
            pa.set_memory_pool(pool)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at a task's end; Spark keeps its Python workers, and they would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and where each text starts (one more than rows)."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(at) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


# --- 64-bit word and window hashes, all words of a batch at once ---------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, _BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, inverse)]), dtype=np.uint64)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (the well-known splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(inside: Callable[[np.ndarray], np.ndarray] | np.ndarray) -> np.ndarray:
    """A table of 256 booleans: whether a byte belongs to a word."""
    return np.asarray(inside, bool)


#: Words of everything but the white space of ASCII.
NOT_SPACE = word_table(~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]))
#: Digits, lower-case letters and all that isn't ASCII (and capitals, as texts are lowered first).
WORD = word_table([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and for each text the index of its first word (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = is_in[edge]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    last[edge - 1] = is_in[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z; in blocks of bytes, so that memory stays bounded for long texts."""
    out = np.zeros(len(start), np.uint64)
    up, down = _powers()
    byte = _BYTE[_LOWER] if lower else _BYTE
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + _BLOCK, "right")))
            lo, hi = start[a], end[b - 1]
            if hi - lo > _BLOCK:  # one word longer than a block
                value = np.uint64(0)
                for at in range(lo, hi, _BLOCK):
                    part = data[at : min(hi, at + _BLOCK)]
                    value = mix(np.array([value ^ np.sum(byte[part] * up[: len(part)], dtype=np.uint64)]))[0]
                out[a] = value
            else:
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(byte[data[lo:hi]] * up[: hi - lo], out=total[1:])
                s, e = start[a:b] - lo, end[a:b] - lo
                out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on; the last k - 1 positions are left out."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _BASE + words[i : i + n])
    return out


def arrow(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema[c]) for c, x in columns.items()], schema=pa.schema([pa.field(c, schema[c]) for c in columns]))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of a matrix."""
    if not len(rows):
        return pa.array([], pa.binary())
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    at = np.arange(len(rows) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(data)])


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """What ``fixed`` wrote, as a matrix of ``kind``; all values are of one length."""
    if not len(column):
        return np.zeros((0, 0), kind)
    wide = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = (pa.concat_arrays(wide.chunks) if isinstance(wide, pa.ChunkedArray) else wide).cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(wide.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(kind).reshape(len(wide), -1)


def crc(column) -> F.Column:
    """crc32 of an id written in decimal."""
    return F.crc32(column.cast("string").cast("binary"))


#: Ids that may be sent to all executors (about 8 bytes each); more are joined by a shuffle.
SMALL_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among ``ids`` (of that one column). The ids are counted first and sent to all executors only where they are few."""
    ids = ids.select(key).distinct().checkpoint() if shared_dir(docs.sparkSession) else ids
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, key, "left_anti")


def bounded_sample(df: DataFrame, key: str, n: int | Callable[[int], int], groups: str | None = None) -> DataFrame:
    """About n rows (of each group) that a hash of ``key`` picks; all rows where there are no more. One count over ``key`` alone comes first; without groups n may depend on it."""
    unit = (F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    if groups is None:
        total = max(1, df.select(key).count())
        return df.where(unit < min(1.0, (n(total) if callable(n) else n) / total))
    share = {r[groups]: min(1.0, n / r["count"]) for r in df.groupBy(groups).count().collect()}
    keep = F.lit(False)
    for value, part in share.items():
        keep = keep | ((F.col(groups) == value) & (unit < part))
    return df.where(keep)
