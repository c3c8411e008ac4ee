"""License scan: exact phrases, and a fuzzy search for short notices.

A notice of m characters with at most e edits is cut into e + 1 seeds; by the pigeonhole principle at least one seed of a match
stands unchanged. Seeds are looked for exactly; around each hit the regex library's bounded-error matching verifies the notice
and reports span and edits. Texts are lower-cased (A-Z) and runs of other characters than word characters become one space first.

Defined results: a null text counts as empty (no words, no labels, score 0); of overlapping matches of one notice the one with
fewer edits stays; repeated rows give equal results; a text is always searched whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common

# The phrases, and the notices that are matched with edits, as lower-case words.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = {
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"),
    "apache-2": ("licensed under the apache license version 2 0",),
    "cc-by-nc": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial"),
    "gpl-3": ("licensed under the gnu general public license version 3",),
    "gpl-2": ("licensed under the gnu general public license version 2",),
    "lgpl": ("gnu lesser general public license",),
    "bsd": ("redistribution and use in source and binary forms with or without modification",),
    "mpl-2": ("mozilla public license version 2 0",),
}
#: Characters for each edit that is allowed.
PER_EDIT = 10
_WORD = rb"[0-9a-z\x80-\xff]"
_SEPARATE = re.compile(rb"[^0-9a-z\x80-\xff]+")


def seeds(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """The notice in edits + 1 pieces of about equal length, and where each begins."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Apart:
    """Spans that do not overlap, by start."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Whether the span meets none that is there; if so it is kept."""
        i = bisect.bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES, per_edit: int = PER_EDIT):
        gap = rb"[^0-9a-z\x80-\xff]+"
        self.phrases = []
        for label, phrase in phrases.items():
            words = phrase.encode().split()
            rare = max(words, key=len)
            self.phrases.append((label, rare, re.compile(rb"(?<!" + _WORD + rb")" + gap.join(map(re.escape, words)) + rb"(?!" + _WORD + rb")")))
        self.notices = []
        for label, texts in notices.items():
            for text in texts:
                own = text.encode()
                edits = max(1, len(own) // per_edit)
                fuzzy = regex.compile(rb"(?b)(?:" + regex.escape(own, special_only=True) + rb"){e<=" + str(edits).encode() + rb"}")
                self.notices.append((label, own, edits, seeds(own, edits), fuzzy))

    def base(self, low: bytes) -> list[tuple[str, int]]:
        """The places of the phrases: label and first byte."""
        return [(label, m.start()) for label, rare, pattern in self.phrases if rare in low for m in pattern.finditer(low)]

    def fuzzy(self, plain: bytes) -> list[tuple[str, int, int, int, int]]:
        """Label, start and end byte, edits and the notice's length of every notice found in the plain form of a text."""
        out = []
        for label, notice, edits, parts, pattern in self.notices:
            near = []
            for at, seed in parts:
                hit = plain.find(seed)
                while hit >= 0:
                    a = max(0, hit - at - edits)
                    near.append((a, min(len(plain), a + len(notice) + 3 * edits)))
                    hit = plain.find(seed, hit + 1)
            found: list[tuple[int, int, int]] = []
            for a, b in sorted(set(near)):
                m = pattern.search(plain, a, b)
                if m:
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            apart = Apart()
            out += [(label, a, b, e, len(notice)) for a, b, e in sorted(set(found), key=lambda x: (x[2], x[0])) if apart.add(a, b)]
        # where notices overlap, those nearest to the text stay: "version 2" is within the edits of "version 3"
        apart = Apart()
        kept = [x for x in sorted(out, key=lambda x: (x[3] / x[4], -x[4], x[1], x[0])) if apart.add(x[1], x[2])]
        return sorted(kept, key=lambda x: (x[1], x[0]))


def plain(low: bytes) -> bytes:
    return _SEPARATE.sub(b" ", low)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a phrase, else 1 - edits / length of the best notice), spans (label, bytes of the plain form, edits)."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))

    def make():
        scanner = Scanner(phrases, notices)
        all_seeds = sorted({s for *_, parts, _ in scanner.notices for _, s in parts})

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = common.raw(common.texts(batch))
            start, _, rows = common.spans(data, at, common.WORD)
            lowered = data.tobytes().lower()
            n = len(at) - 1
            n_base, first, last, base_labels, labels, score, spans = np.zeros(n, np.int64), [None] * n, [None] * n, [""] * n, [""] * n, np.zeros(n), [[] for _ in range(n)]
            for i in range(n):
                low = lowered[at[i] : at[i + 1]]
                base = scanner.base(low)
                flat = plain(low) if any(s in low for s in anchors) or base else b""
                more = scanner.fuzzy(flat) if flat else []
                if base:
                    n_base[i] = len(base)
                    first[i] = int(np.searchsorted(start[rows[i] : rows[i + 1]], at[i] + min(p for _, p in base)))
                    last[i] = int(np.searchsorted(start[rows[i] : rows[i + 1]], at[i] + max(p for _, p in base)))
                own = {x for x, _ in base}
                base_labels[i] = ",".join(sorted(own))
                labels[i] = ",".join(sorted(own | {x[0] for x in more}))
                score[i] = 1.0 if base else max([0.0, *(1 - e / m for *_, e, m in more)])
                spans[i] = [{"label": x, "start": a, "end": b, "edits": e} for x, a, b, e, _ in more]
            ints = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [common.column(batch, "id"), ints(np.diff(rows)), ints(n_base), ints(first), ints(last), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"],
            )

        # The plain form is made only of texts that can hold a match: a seed without its spaces' neighbours stands in the text itself.
        anchors = sorted({max(s.split(b" "), key=len) for s in all_seeds})
        anchors = [a for a in anchors if not any(b != a and b in a for b in anchors)]
        return work

    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, license_spans array<struct<label:string,start:bigint,end:bigint,edits:bigint>>"
    return common.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, schema).withColumnRenamed("id", id_col)
