"""Substring dedup by sliding sentence spans.

A text's sentences end at ``. ! ?``, their like in other scripts or a line's end; case and all but word characters do not count. A
sentence of more than ``LONG`` words (or a text without stops) is cut into pieces where its words alone say so, and the pieces count
as sentences. Every run of ``RUN`` consecutive sentences is hashed; one with fewer than ``LEAST_WORDS`` words is lengthened, forward and
backward, until it has them; a text of fewer than ``RUN`` sentences is one run, and one of fewer words meets only its exact copies. The hashes are joined over all documents, and sentences
that a run other than the first of its kind (by document, then place) covers are removed. Cutting, lengthening, one-run texts and
other scripts' stops are what ``whole`` adds; the query asks for it.

The runs are written once. The first of each kind comes from a partial aggregation and the rest from an equi-join; runs of more than ``HOT``
places are few (counted first), so that their firsts are sent to all rows and no task has all rows of one. No group is ever gathered.

Defined results: null and empty texts and those without words have no run and stay as they are; a run that repeats within a document is removed
after its first place; of equal documents the smallest id keeps its text; repeated rows with one id count as one document;
rows with a null id keep their text and do not count; ids are whole numbers; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common

RUN = 3
#: Words of a run: in full, and in the plain rule.
LEAST_WORDS, PLAIN_WORDS = 25, 8
#: Words above which a sentence is cut, and grams of ``GRAM`` words of which the first least in ``SPAN`` is a cut.
LONG, GRAM, SPAN = 24, 2, 8
#: Places of a run beyond which its rows are not brought together.
HOT = 4096
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_ENDS = np.array([chr(b) in ".!?\n" for b in range(256)])
# Stops of other scripts.
STOPS = "。｡．！？…।॥؟۔։።።፧།။៕"


def ascii_stops(data: np.ndarray) -> np.ndarray:
    """The bytes with every byte of a stop of another script as a full stop; places stay as they are."""
    out = data
    for stop in {x.encode() for x in STOPS}:
        n = len(stop)
        if len(data) < n:
            continue
        at = np.flatnonzero(data[: len(data) - n + 1] == stop[0])
        for k in range(1, n):
            at = at[data[at + k] == stop[k]]
        if len(at):
            out = out.copy() if out is data else out
            for k in range(n):
                out[at + k] = 0x2E
    return out


def cuts(words: np.ndarray, first: np.ndarray, size: np.ndarray, long: int = LONG) -> np.ndarray:
    """Words at which over-long sentences are cut: grams that are the first least of some ``SPAN`` grams of one sentence."""
    big = np.flatnonzero(size > long)
    if not len(big):
        return np.zeros(0, np.int64)
    count = size[big] - GRAM - SPAN + 2  # spans of grams within the sentence
    at = np.repeat(first[big], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    grams = common.windows(words, GRAM)
    best, where = grams[at], at.copy()
    for k in range(1, SPAN):
        g = grams[at + k]
        where = np.where(g < best, at + k, where)
        best = np.minimum(best, g)
    return np.unique(where)


def sentences(column: pa.Array, whole: bool = True):
    """For all texts together: each sentence's hash, its words and first byte, and where each text's sentences begin (one more than texts)."""
    data, at = common.raw(column)
    plain = ascii_stops(data) if whole else data
    start, end, rows = common.spans(plain, at, common.WORD)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64), data, at
    words = common.word_hashes(plain, start, end)
    ends = np.concatenate([[0], np.cumsum(_ENDS[plain], dtype=np.int64)])
    opens = np.ones(n, bool)
    opens[1:] = ends[start[1:]] > ends[end[:-1]]
    opens[rows[:-1][rows[:-1] < n]] = True
    first = np.flatnonzero(opens)
    if whole:
        opens[cuts(words, first, np.diff(np.append(first, n)))] = True
        first = np.flatnonzero(opens)
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        mixed = common.mix(words + (place + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        hashes = common.mix(np.add.reduceat(mixed, first) + size.astype(np.uint64))
    return hashes, size, start[first], np.searchsorted(first, rows), data, at


def runs(hashes: np.ndarray, size: np.ndarray, rows: np.ndarray, run: int, least: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first sentence (within the text) and number of sentences of every run."""
    n = len(hashes)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    low, high = rows[text], rows[text + 1]
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(n)
    own = np.minimum(run, high - low)  # a shorter text is one run
    ahead = np.maximum(at + own, np.searchsorted(total, total[:-1] + least))
    back = np.minimum(at + 1 - own, np.searchsorted(total, total[1:] - least, "right") - 1)
    pairs = np.stack([np.concatenate([at, back]), np.concatenate([ahead, at + 1])], 1)
    pairs = np.unique(pairs[np.concatenate([(ahead <= high) & (total[np.minimum(ahead, n)] - total[:-1] >= least), (back >= low) & (total[1:] - total[np.maximum(back, 0)] >= least)])], axis=0)
    first, count = pairs[:, 0], pairs[:, 1] - pairs[:, 0]
    tiny = np.flatnonzero((np.diff(rows) > 0) & (total[rows[1:]] - total[rows[:-1]] < least)) if whole else np.zeros(0, np.int64)
    if whole:
        first, count = np.append(first, rows[tiny]), np.append(count, np.diff(rows)[tiny])
    else:
        first, count = first[count == run], count[count == run]
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > k)
            out[on] = common.mix(out[on] * common._BASE + hashes[first[on] + k])
    out[len(out) - len(tiny) :] ^= _WHOLE  # meets other whole texts only
    return out, text[first], first - low[first], count


def repeated_runs(docs: DataFrame, *, run: int = RUN, least: int | None = None, whole: bool = False) -> DataFrame:
    """doc_id, sentence, count, first_doc of every run that is not the first of its kind."""
    least = least if least is not None else LEAST_WORDS if whole else PLAIN_WORDS

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, size, _, rows, _, _ = sentences(common.texts(batch), whole)
            h, text, at, count = runs(hashes, size, rows, run, least, whole)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), common.column(batch, "doc_id").take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32))], names=["h", "doc_id", "sentence", "count"])

        return work

    known = docs.where("doc_id is not null")
    every = common.materialise(common.map_arrow(known, make, "h bigint, doc_id bigint, sentence int, count int"))
    first = every.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sentence")).alias("first")).where("n > 1")
    first = common.materialise(first.select("h", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.sentence").alias("first_sentence")))
    hot = first.where(F.col("n") > HOT).drop("n")
    if hot.count() <= common.SMALL_IDS:  # the rows of frequent runs stay where they are
        rest = every.join(F.broadcast(hot.select("h")), "h", "left_anti").join(first.where(F.col("n") <= HOT).drop("n"), "h")
        found = rest.unionByName(every.join(F.broadcast(hot), "h"))
    else:
        found = every.join(first.drop("n"), "h")
    return found.where("doc_id <> first_doc or sentence <> first_sentence").select("doc_id", "sentence", "count", "first_doc")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int | None = None, only_changed: bool = False, whole: bool = False) -> DataFrame:
    """The documents with their text less the sentences that repeat; id, text, n_sentences, n_removed, first_docs (where they stand first).

    Without ``whole``, only runs of just ``run`` sentences between ASCII stops that have ``least`` (``PLAIN_WORDS``) words count: exact copies with shorter runs stay.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))  # ids are whole numbers
    found = repeated_runs(own, run=run, least=least, whole=whole).groupBy("doc_id").agg(F.collect_set(F.col("sentence").cast("bigint") * (1 << 31) + F.col("count")).alias("places"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    both = own.join(found, "doc_id", "inner" if only_changed else "left")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, _, first, rows, data, at = sentences(common.texts(batch), whole)
            view = data.tobytes()
            kept, count, removed = [], [], []
            for i, (places, valid) in enumerate(zip(common.column(batch, "places").to_pylist(), common.texts(batch).is_valid().to_pylist(), strict=True)):
                begin = np.append(first[rows[i] : rows[i + 1]], at[i + 1])
                gone = np.zeros(len(begin) - 1, bool)
                for p in places or []:
                    gone[p >> 31 : (p >> 31) + (p & 0x7FFFFFFF)] = True
                parts = [view[at[i] : begin[0]]] + [view[begin[j] : begin[j + 1]] for j in np.flatnonzero(~gone)]
                kept.append(b"".join(parts).decode() if valid else None)
                count.append(len(gone))
                removed.append(int(gone.sum()))
            return pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), common.column(batch, "first_docs")], names=["doc_id", "text", "n_sentences", "n_removed", "first_docs"])

        return work

    return common.map_arrow(both, make, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, first_docs array<bigint>").withColumnRenamed("doc_id", id_col)
