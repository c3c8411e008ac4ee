"""Language identification of spans.

Every distinct word of a batch is scored once for each language by smoothed character n-grams; the ranges of its script narrow
the languages that can have it. Viterbi over the words of a text, with a penalty for a change of language, labels its spans.
Long texts are cut into chunks that are worked side by side and joined exactly by max-plus steps.

The model is fitted on a bounded sample (``SAMPLE`` labelled documents of each language, a parameter). Prediction reads whole texts.

Defined results: a null text, or one without letters, is ``und`` with score 0; equal totals of two languages go to the first by
name; rows that repeat get equal results; without any labelled row all texts are ``und``; an empty table
gives an empty table; other columns are left out.
"""

from __future__ import annotations

import dataclasses
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common

SAMPLE = 250
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PENALTY = 6.0
CHUNK = 128
# The first code points of ranges, and their script.
SCRIPTS = {0x0000: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew", 0x0600: "Arabic", 0x0900: "Devanagari", 0x0980: "other", 0x0E00: "Thai", 0x0E80: "other", 0x10A0: "Georgian", 0x1100: "Hangul", 0x1200: "other", 0x1E00: "Latin", 0x1F00: "Greek", 0x2000: "other", 0x2C60: "Latin", 0x2C80: "other", 0x3040: "Kana", 0x3100: "Han", 0xA000: "other", 0xA720: "Latin", 0xA800: "other", 0xAC00: "Hangul", 0xD7B0: "other", 0xF900: "Han", 0xFB00: "Latin", 0xFB13: "other", 0x20000: "Han"}
_STARTS = np.array(list(SCRIPTS))
_NAMES = sorted(set(SCRIPTS.values()))
_OF = np.array([_NAMES.index(s) for s in SCRIPTS.values()])


def split_letters(text: F.Column) -> F.Column:
    """The runs of letters of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words, each between two boundary marks (1), and where each word starts."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    joined = "\x01" + "\x01\x01".join(words) + "\x01" if words else ""
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def grams(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram within a word, and the word each is from."""
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, whose = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        k = len(code) - n + 1
        h = np.full(k, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + k].astype(np.uint64))
        same = word[:k] == word[n - 1 :]
        if n == 1:
            same &= code != 1
        out.append((h[same] % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(word[:k][same])
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(whose) if whose else np.zeros(0, np.int64)


def scripts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The script of each word's first letter."""
    return _OF[np.searchsorted(_STARTS, code[first[:-1] + 1], "right") - 1]


@dataclasses.dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log probabilities
    allowed: np.ndarray  # scripts x languages

    def scores(self, words: list[str]) -> np.ndarray:
        code, first = letters(words)
        bucket, word = grams(code, first)
        out = np.stack([np.bincount(word, self.table[bucket, k], len(words)).astype(float) for k in range(len(self.languages))], axis=1)
        ok = self.allowed[scripts(code, first)] if words else np.ones((0, len(self.languages)), bool)
        out[~ok] -= 1e4
        return out.astype(np.float32)


def fit(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows with a language; counts of n-grams are summed on the executors, only their table of fixed size is collected."""
    known = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang_")).where("lang_ is not null and text is not null")
    known = common.bounded_sample(known, "id_", sample, "lang_").select("lang_", split_letters(F.col("text")).alias("words"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: Counter = Counter()
            for lang, words in zip(common.column(batch, "lang_").to_pylist(), common.column(batch, "words").to_pylist(), strict=True):
                code, first = letters(words)
                bucket, _ = grams(code, first)
                for b, n in zip(*np.unique(bucket, return_counts=True), strict=True):
                    total[lang, int(b)] += int(n)
                for s, n in zip(*np.unique(scripts(code, first), return_counts=True), strict=True):
                    total[lang, -1 - int(s)] += int(n)
            keys = sorted(total)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], names=["lang_", "bucket", "n"])

        return work

    counts = common.map_arrow(known, make, "lang_ string, bucket bigint, n bigint", by=None).groupBy("lang_", "bucket").sum("n").collect()
    languages = sorted({r[0] for r in counts})
    n = np.zeros((BUCKETS, len(languages)))
    seen = np.zeros((len(_NAMES), len(languages)))
    for lang, bucket, k in counts:
        (n[bucket] if bucket >= 0 else seen[-1 - bucket])[languages.index(lang)] += k
    table = np.log((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)) if languages else n
    allowed = seen >= 0.001 * np.maximum(1, seen.sum(0))
    allowed[~allowed.any(1)] = True  # a script that no language is known for narrows nothing
    return Model(languages, table.astype(np.float32), allowed)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of each text: sum of scores less ``penalty`` for each change. score: words x labels; first: each text's first word, and the end.

    Chunks of ``CHUNK`` words of all texts go in lock-step. 1: for each chunk the best sum from each label before it to each label
    at its end. 2: from chunk to chunk of a text, the best sums so far. 3: each chunk again from those, with back pointers.
    """
    n, k = score.shape
    size = np.diff(first)
    chunks = -(-size // CHUNK)
    text = np.repeat(np.arange(len(size)), chunks)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[:-1][text] + rank * CHUNK
    length = np.minimum(CHUNK, first[1:][text] - begin)
    c = len(text)
    if not c:
        return np.zeros(0, np.uint8)
    order = np.argsort(-length, kind="stable")
    begin_o, length_o = begin[order], length[order]
    active = [int(np.searchsorted(-length_o, -t, "left")) for t in range(CHUNK)]  # chunks longer than t
    # 1
    best = np.full((c, k, k), -penalty, np.float32)
    best[:, np.arange(k), np.arange(k)] = 0
    for t in range(CHUNK):
        m = active[t]
        if not m:
            break
        s = score[begin_o[:m] + t]
        if t == 0:
            best[:m] += s[:, None, :]
        else:
            d = best[:m]
            best[:m] = np.maximum(d, d.max(2, keepdims=True) - penalty) + s[:, None, :]
    step = np.empty_like(best)
    step[order] = best
    # 2
    entry = np.zeros((c, k), np.float32)
    by_rank = np.argsort(rank, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(rank))])
    for r in range(1, len(ends) - 1):
        own = by_rank[ends[r] : ends[r + 1]]
        d = (entry[own - 1][:, :, None] + step[own - 1]).max(1)
        entry[own] = d - d.max(1, keepdims=True)
    # 3
    stay = np.zeros((n, k), bool)
    source = np.zeros(n, np.uint8)
    d = entry[order]
    starts = rank[order] == 0
    for t in range(CHUNK):
        m = active[t]
        if not m:
            break
        at = begin_o[:m] + t
        own = d[:m]
        top = own.argmax(1)
        jump = own[np.arange(m), top] - penalty
        keep = own >= jump[:, None]
        if t == 0:
            keep |= starts[:m, None]
        stay[at], source[at] = keep, top
        d[:m] = np.where(keep, own, jump[:, None]) + score[at]
    final = np.empty_like(d)
    final[order] = d
    # back, for each label at a chunk's end
    state = np.tile(np.arange(k, dtype=np.uint8), (c, 1))
    path = np.zeros((n, k), np.uint8)
    for t in range(CHUNK - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        at = begin_o[:m] + t
        own = state[:m]
        path[at] = own
        state[:m] = np.where(np.take_along_axis(stay[at], own.astype(np.int64), 1), own, source[at][:, None])
    back = np.empty_like(state)
    back[order] = state
    end = np.zeros(c, np.int64)
    last = np.concatenate([text[1:] != text[:-1], [True]])
    end[last] = final[last].argmax(1)
    for r in range(len(ends) - 2, 0, -1):
        own = by_rank[ends[r] : ends[r + 1]]
        end[own - 1] = back[own, end[own]]
    return path[np.arange(n), np.repeat(end, length)]


def label(words: pa.Array, model: Model, penalty: float = PENALTY):
    """For a list column of words: each word's label, each text's first word, and the letters of each word."""
    rows = np.asarray(words.offsets).astype(np.int64)
    rows -= rows[0]
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    score = model.scores(distinct)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    code = coded.indices.to_numpy().astype(np.int64)
    return viterbi(score[code], rows, penalty), rows, size[code]


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """id, lang_pred, score (share of the letters that lie in spans of that language), n_words, and with ``spans`` the spans: language, first word, words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def make():
        own = shared.value
        k = len(own.languages)
        names = np.array([*own.languages, "und"], object)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = common.column(batch, "words")
            n = len(words)
            if k:
                found, rows, size = label(words, own, penalty)
                text = np.repeat(np.arange(n), np.diff(rows))
                total = np.bincount(text * k + found, size, n * k).reshape(n, k)
            else:
                text, found, rows, total = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros((n, 1))
            whole = total.sum(1)
            pick = np.where(whole > 0, total.argmax(1), k)
            score = np.where(whole > 0, total.max(1) / np.maximum(whole, 1), 0.0)
            out = {"id": common.column(batch, "id"), "lang_pred": pa.array(names[pick].tolist(), pa.string()), "score": pa.array(score, pa.float64()), "n_words": pa.array(np.diff(rows), pa.int64())}
            if spans:
                cut = np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])]) if len(found) else np.zeros(0, bool)
                at = np.flatnonzero(cut)
                long = np.diff(np.append(at, len(found)))
                whose = text[at] if len(at) else np.zeros(0, np.int64)
                inner = pa.StructArray.from_arrays([pa.array(names[found[at]].tolist() if len(at) else [], pa.string()), pa.array(at - rows[whose] if len(at) else [], pa.int64()), pa.array(long if len(at) else [], pa.int64())], fields=list(kind.value_type))
                out["lang_spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(n + 1)), pa.int32()), inner)
            return pa.RecordBatch.from_arrays([*out.values()], names=[*out])

        return work

    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_kind}, lang_pred string, score double, n_words bigint" + (", lang_spans array<struct<lang:string,first:bigint,words:bigint>>" if spans else "")
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", split_letters(F.col("text")).alias("words"))
    return common.map_arrow(words, make, schema, by=None).withColumnRenamed("id", id_col)
