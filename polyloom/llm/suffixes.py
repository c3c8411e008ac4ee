"""Repeated passages by sparse suffix arrays.

Of each text only the suffixes at minimisers stay: places whose hash of ``GRAM`` words is the least of a window of ``SPAN`` such
places. Every passage of ``LEAST`` words holds a whole window, so all its copies keep a suffix at the same place, with at least
``HEAD`` words of the passage after it. Suffixes carry the hash of their first ``HEAD`` words and the ``AROUND`` words before and after
the head (15 bits a word: at a passage's very edge one word in 32,768 is taken for another), and are sorted, so that equal heads of all
documents are neighbours. A passage around a suffix takes 0 to ``SPAN`` - 1 words to the left of the head and the rest to the right; for each
of these ``SPAN`` ways the neighbours are grouped by the passage's hash, and each but the first of its kind (by document, then place) is a
repeat. The unions of a document's repeats are reported.

Heads are counted first, in a pass that carries nothing else (keeping the suffixes would take 1.4 times the input). A head of more than ``HOT``
suffixes is dealt by document into shares. Each share is compared by itself, and the first of each passage
in it goes on to a second grouping over all shares: at most ``SPAN`` rows for each suffix, one for each passage. No result depends on partitions.

Defined results: null, empty and short texts have no repeats; a repeat within one text is reported from its second place on;
rows with a null id are left out; repeated rows with one id are told apart by nothing and count once; ids are whole numbers; an empty
table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common
from polyloom.llm.jaccard import sorted_runs

LEAST = 50
GRAM, SPAN = 8, 32
HEAD = LEAST - SPAN + 1
AROUND = SPAN
#: Suffixes of one head that one task compares; bytes of text that are laid out at once.
HOT, PART_BYTES = 4096, 1 << 20


def minimisers(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The places that are the first least of any window of ``span`` places, ascending."""
    n = len(grams)
    if n < span:
        return np.zeros(0, np.int64)
    # least of windows by doubling; the place goes along, in the low bits of a key
    best, where, width = grams.copy(), np.arange(n), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        pick = b < a
        where = np.where(pick, where[step:], where[: len(where) - step])
        best = np.minimum(a, b)
        width += step
    return np.unique(where)


def suffixes(column: pa.Array, wide: bool = True):
    """For all texts: text, place, hash of the head, and (if ``wide``) the words around: before, reversed, then after the head."""
    data, at = common.raw(column)
    start, end, rows = common.spans(data, at, common.WORD)
    words = common.word_hashes(data, start, end)
    grams = common.mix(common.windows(words, GRAM))
    heads = common.windows(words, HEAD)
    short = (words >> np.uint64(48)).astype(np.uint16)
    texts, places = [], []
    for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
        if b - a >= LEAST:
            p = minimisers(grams[a : b - GRAM + 1])
            p = p[p + HEAD <= b - a]
            texts.append(np.full(len(p), i))
            places.append(p)
    text, place = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (texts, places))
    whole = rows[text] + place
    heads = heads[whole] if len(whole) else np.zeros(0, np.uint64)
    if not wide:
        return text, place, heads, None
    offset = np.concatenate([-1 - np.arange(AROUND), HEAD + np.arange(AROUND)])
    position = whole[:, None] + offset
    outside = (position < rows[text][:, None]) | (position >= rows[text + 1][:, None])
    np.clip(position, 0, max(0, len(short) - 1), out=position)
    around = short[position] | np.uint16(1) if len(words) else np.zeros((0, 2 * AROUND), np.uint16)
    around[outside] = 0
    return text, place, heads, around


def passages(head: np.ndarray, around: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words before the head: that number, the suffixes whose text holds the whole passage, and the passages' hashes."""
    after = [np.zeros(len(head), np.uint64)]
    with np.errstate(over="ignore"):
        for k in range(SPAN - 1):
            after.append(common.mix(after[-1] * common._BASE + around[:, AROUND + k].astype(np.uint64)))
        before = head.astype(np.uint64)
        inside = np.ones(len(head), bool)
        for k in range(SPAN):
            if k:
                before = common.mix(before * common._BASE + around[:, k - 1].astype(np.uint64))
                inside = inside & (around[:, k - 1] != 0)
            rest = SPAN - 1 - k
            own = np.flatnonzero(inside & (around[:, AROUND + rest - 1] != 0) if rest else inside)
            yield k, own, common.mix(before[own] + common.mix(after[rest][own] + np.uint64(k + 1)))


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes sorted by head, share, document and place: repeats (key null), and of shared-out heads the first of each passage (with its key)."""
    for t, runs in sorted_runs(batches, ["head", "share"]):
        doc, place, head = t.column("doc_id").to_numpy(), t.column("place").to_numpy().astype(np.int64), t.column("head").to_numpy().view(np.uint64)
        around, run = common.matrix(t.column("around"), np.uint16), np.repeat(np.arange(len(runs) - 1), np.diff(runs)).astype(np.uint64)
        lead = np.full((len(doc), SPAN), -1, np.int32)
        for k, own, key in passages(head, around):
            key = common.mix(key + run[own])
            order = own[np.argsort(key, kind="stable")]  # rows stand by document and place: the first leads
            key = np.sort(key, kind="stable")
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else order
            later = (doc[order] != doc[first]) | (place[order] != place[first])
            lead[order[later], k] = first[later]
        row, low, high = stretches(lead)
        yield _rows(doc[row], place[row] - high, place[row] - low + LEAST, *others(lead, row, low, high, doc))
        for x in np.flatnonzero(t.column("hot").to_numpy(zero_copy_only=False)[runs[:-1]]):
            own = slice(runs[x], runs[x + 1])
            yield _firsts(doc[own], place[own], head[own], around[own])


def stretches(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring entries other than -1 of each row: row, first and last column."""
    wide = np.pad(lead >= 0, ((0, 0), (1, 1)))
    row, low = np.nonzero(wide[:, 1:-1] & ~wide[:, :-2])
    _, high = np.nonzero(wide[:, 1:-1] & ~wide[:, 2:])
    return row, low, high


def others(lead: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct documents that lead in each stretch, one after the other, and where each stretch's begin (one more than stretches)."""
    size = high - low + 1
    of = np.repeat(np.arange(len(row)), size)
    column = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
    value = doc[lead[row[of], column]]
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))[: len(of)]
    return value[new], np.searchsorted(of[new], np.arange(len(row) + 1))


_MATCH = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("others", pa.list_(pa.int64())), ("key", pa.int64())])


def _rows(doc, first, last, other, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, first, last)), common.lists(other, at, pa.int64()), pa.nulls(len(doc), pa.int64())], schema=_MATCH)


def _firsts(doc, place, head, around) -> pa.RecordBatch:
    """The first of each passage of these suffixes, with its hash."""
    rows, keys, start = [], [], []
    for k, own, key in passages(head, around):
        key, at = np.unique(key, return_index=True)
        rows.append(own[at])
        keys.append(key)
        start.append(place[own[at]] - k)
    rows, keys, start = np.concatenate(rows), np.concatenate(keys), np.concatenate(start)
    return pa.RecordBatch.from_arrays([pa.array(doc[rows], pa.int64()), pa.array(start, pa.int64()), pa.array(start + LEAST, pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.array(keys.view(np.int64))], schema=_MATCH)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From matches sorted by document: its repeats (unions of those of ``LEAST`` words or more that touch), and the other documents."""
    for t, runs in sorted_runs(batches, ["doc_id"]):
        doc, first, last = (t.column(c).to_numpy() for c in ("doc_id", "first", "last"))
        listed = pa.concat_arrays(t.column("others").chunks)
        flat, at = listed.flatten().to_numpy(), np.asarray(listed.offsets) - np.asarray(listed.offsets)[0]
        out = []
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            order = np.argsort(first[a:b], kind="stable") + a
            low, high = first[order], np.maximum.accumulate(last[order])
            new = np.append(True, low[1:] > high[:-1])
            high = high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
            low = low[new]
            out.append((int(doc[a]), [{"first": int(x), "last": int(y)} for x, y in zip(low, high, strict=True)], int((high - low).sum()), np.unique(flat[at[a] : at[b]])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
            names=["doc_id", "spans", "n_words", "other_docs"],
        )


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (first word, end), n_words in them, other_docs (that hold the earlier copies): the documents with a repeat that isn't its first copy."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, place, head, around = suffixes(common.texts(batch))
            return pa.RecordBatch.from_arrays(
                [common.column(batch, "doc_id").take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(head.view(np.int64)), common.fixed(around)],
                names=["doc_id", "place", "head", "around"],
            )

        return work

    def heads():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array(suffixes(common.texts(batch), False)[2].view(np.int64))], names=["head"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = common.map_arrow(own.select("text"), heads, "head bigint", limit=PART_BYTES).groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = common.materialise(counted)
    few = hot.count() <= common.SMALL_IDS
    every = common.map_arrow(own, make, "doc_id bigint, place int, head bigint, around binary", limit=PART_BYTES).join(F.broadcast(hot) if few else hot, "head", "left")
    share = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / HOT))).cast("int")
    keys = ["head", "share"]
    dealt = every.select("head", share.alias("share"), "doc_id", "place", "around", F.col("n").isNotNull().alias("hot")).repartition(parts, *keys).sortWithinPartitions(*keys, "doc_id", "place")
    found = common.materialise(dealt.mapInArrow(compare, "doc_id bigint, first bigint, last bigint, others array<bigint>, key bigint"))
    edges = found.where("key is not null").drop("others")
    lead = edges.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "first")).alias("lead")).where("n > 1").select("key", F.col("lead.doc_id").alias("other"), F.col("lead.first").alias("lead_first"))
    again = edges.join(lead, "key").where("doc_id <> other or first <> lead_first").select("doc_id", "first", "last", F.array("other").alias("others"))
    matches = found.where("key is null").select("doc_id", "first", "last", "others").unionByName(again)
    return matches.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(merged, "doc_id bigint, spans array<struct<first:bigint,last:bigint>>, n_words bigint, other_docs array<bigint>")
