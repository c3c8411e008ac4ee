"""Sentence spans, sparse suffix arrays and benchmark templates, against brute force and planted cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from polyloom.llm import decontaminate, queries, sentences, suffixes

from .conftest import AWKWARD


def prose(r, n, vocabulary):
    out = []
    while n > 0:
        k = r.randint(3, 12)
        out.append(" ".join(r.choices(vocabulary, k=k)).capitalize() + ".")
        n -= k
    return " ".join(out)


@pytest.fixture(scope="module")
def planted():
    """Texts of random prose; passages of over 50 words stand in several, exact copies and near copies too."""
    r = random.Random(12)
    vocabulary = [a + b for a in "ba ce di fo gu la me ni po ru sa te".split() for b in "ka lo mi ne pu ra se ti vo".split()]
    texts = {i: prose(r, r.randint(20, 300), vocabulary) for i in range(60)}
    holders = {}
    for _ in range(8):
        passage = prose(r, r.randint(60, 120), vocabulary)
        own = sorted(r.sample(range(60), 4))
        for i in own:
            cut = r.choice([m.end() for m in re.finditer(r"[.] ", texts[i] + " ")])
            texts[i] = texts[i][:cut].rstrip() + " " + passage + " " + texts[i][cut:]
        holders[passage] = own
    texts[100] = texts[3]
    texts[101] = "la " * 300
    texts[102] = prose(r, 300, vocabulary) + " " + "la " * 200
    return texts, holders


# --- 2 ---


def brute_sentences(texts, run, least):
    """doc_id -> kept text of those that change, by the definition."""
    seen, out = {}, {}
    for i in sorted(texts):
        t = texts[i] or ""
        pieces = [(m.start(), m.end()) for m in re.finditer(r"[^.!?\n]*(?:[.!?\n]+|$)", t) if re.search(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", m[0])]
        words = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t[a:b].lower())) for a, b in pieces]
        gone = [False] * len(pieces)
        for j in range(len(pieces) - run + 1):
            key = tuple(words[j : j + run])
            if sum(map(len, key)) >= least and seen.setdefault(key, (i, j)) != (i, j):
                gone[j : j + run] = [True] * run
        if any(gone):
            out[i] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def test_sentences_equal_brute_force(spark, sf, planted):
    for texts in (planted[0], {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        want = brute_sentences(texts, sentences.RUN, sentences.PLAIN_WORDS)
        rows = {r.doc_id: r for r in sentences.remove_repeats(docs).collect()}
        assert rows.keys() == texts.keys()
        assert {i for i, r in rows.items() if r.n_removed} == want.keys()
        for i, kept in want.items():
            assert re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", rows[i].text.lower()) == [w for s in kept for w in s]
        assert all(rows[i].text == texts[i] for i in texts if i not in want)


def brute_whole(texts, run, least):
    """doc_id -> kept sentences (by place) of those that change, by the definition of whole runs over the sentences as they are cut."""
    seen, gone, count = {}, {}, {}
    for i in sorted(texts):
        h, size, *_ = sentences.sentences(pa.array([texts[i]], pa.string()))
        h, size = h.tolist(), size.tolist()
        m = count[i] = len(h)
        own, runs = min(run, m), set()
        for a in range(m):
            b = a + own
            while b <= m and sum(size[a:b]) < least:
                b += 1
            if b <= m:
                runs.add((a, b))
            b, c = a + 1, a + 1 - own
            while c >= 0 and sum(size[c:b]) < least:
                c -= 1
            if c >= 0:
                runs.add((c, b))
        keys = [(tuple(h[a:b]), a, b) for a, b in runs]
        if m and sum(size) < least:
            keys.append((("whole", *h), 0, m))
        for key, a, b in sorted(keys, key=lambda x: x[1:]):
            if seen.setdefault(key, (i, a)) != (i, a):
                gone.setdefault(i, set()).update(range(a, b))
    return {i: (count[i], len(g)) for i, g in gone.items()}


def test_whole_sentences_equal_brute_force(spark, sf, planted):
    for texts in (planted[0], {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        rows = {r.doc_id: (r.n_sentences, r.n_removed) for r in sentences.remove_repeats(docs, whole=True, only_changed=True).collect()}
        assert rows == brute_whole(texts, sentences.RUN, sentences.LEAST_WORDS)


def test_sentence_query_leaves_clean_documents_and_catches_long_repeats(spark):
    """Over the query's own table: documents with a 50-word passage of an earlier document are changed, those without any 50-word repeat hardly ever."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    changed = {r.doc_id for r in queries.op2_sentence_dedup(spark, sf).collect()}
    repeats = set(later_windows(texts, 50))
    short = {i for i, t in texts.items() if t and any(j < i and texts[j] == t for j in texts)}
    assert len(repeats & changed) >= 0.97 * len(repeats) and len(changed - repeats - short) <= 0.03 * (len(texts) - len(repeats))


def test_sentence_query_finds_planted(spark, planted):
    texts, holders = planted
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in sentences.remove_repeats(docs, only_changed=True).collect()}
    for own in holders.values():
        assert all(i in rows for i in own[1:])
    clean = set(range(60)) - {i for own in holders.values() for i in own}
    assert not clean & set(rows) and rows[100].n_removed == rows[100].n_sentences


def test_sentences_awkward(spark, awkward, nothing):
    rows = {r.doc_id: r for r in sentences.remove_repeats(awkward).collect()}
    assert {i: r.text for i, r in rows.items()} == dict(enumerate(AWKWARD)) and all(r.n_removed == 0 for r in rows.values())
    assert sentences.remove_repeats(nothing).count() == 0
    none = spark.createDataFrame([(None, "A b. " * 40), (1, "A b. " * 40)], "doc_id long, text string")
    assert len(sentences.remove_repeats(none, least=4).collect()) == 2


# --- 8 ---


def later_windows(texts, n):
    """The places of every n-word window that stands earlier, by document and place."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (texts[i] or "").lower())
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if key in seen:
                out.setdefault(i, set()).update(range(j, j + n))
            seen.add(key)
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_suffixes_cover_every_repeat(spark, planted, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        texts = planted[0]
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: {x for s in r.spans for x in range(s.first, s.last)} for r in suffixes.repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, wide = later_windows(texts, suffixes.LEAST), later_windows(texts, suffixes.HEAD)
    assert all(want[i] <= got.get(i, set()) for i in want)
    assert all(got[i] <= wide.get(i, set()) for i in got)


def test_suffixes_awkward(awkward, nothing):
    rows = suffixes.repeats(awkward).collect()
    assert {r.doc_id for r in rows} <= {4, 11} and suffixes.repeats(nothing).count() == 0


def test_minimisers_are_window_minima():
    r = np.random.default_rng(1)
    for n in (0, 5, 31, 32, 200):
        g = r.integers(0, 50, n, dtype=np.uint64)
        want = sorted({i + int(g[i : i + 32].argmin()) for i in range(n - 31)})
        assert suffixes.minimisers(g).tolist() == want


# --- 4 ---

ITEM = "A train leaves Boston at 9 and travels 300 miles to Denver while another train leaves Denver at 11 going 80 miles per hour where do they meet"
OTHER = ITEM.replace("Boston", "Madrid").replace("Denver", "Lisbon").replace("300", "1250").replace("11", "14").replace("80", "95").replace(" 9 ", " 7 ")
ODD = ITEM.replace("to Denver", "to Lisbon").replace("leaves Denver", "leaves Madrid").replace("leaves Boston", "leaves Athens")


def test_templates(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, "one two"), (9, None), (10, "purple monkeys dance on quiet hills")], "item_id long, text string")
    rows = [
        (0, "Some words before. " + ITEM + " and after."),
        (1, "Intro text here: " + OTHER + ". More."),
        (2, "Nothing of the kind is in this text at all, it is about other things and goes on for a while."),
        (3, ITEM.upper()),
        (4, "we saw purple monkeys dance on quiet hills today"),
        (5, None),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got.keys() == {(0, 7), (1, 7), (3, 7), (4, 10)}
    assert got[0, 7].exact and not got[1, 7].exact and got[0, 7].first_word == 3
    odd = spark.createDataFrame([(0, ODD)], "doc_id long, text string")
    only = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    share = decontaminate.contaminated(odd, only).collect()
    assert not share or share[0].words < len(ITEM.split())


def test_slots_must_agree():
    a = np.array
    assert decontaminate.consistent(a([1, 2, 1]), a([3, 0, 3]), a([5, 9, 5]), a([3, 0, 3]))
    assert not decontaminate.consistent(a([1, 2, 1]), a([3, 0, 3]), a([5, 9, 6]), a([3, 0, 3]))
    assert not decontaminate.consistent(a([1, 2]), a([3, 3]), a([5, 5]), a([3, 3]))


def test_contamination_against_brute_force(spark, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bench = {r.item_id: word.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, sf).collect()}
    want = set()
    n = decontaminate.WINDOW
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = word.findall((d.text or "").lower())
        places = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for k, b in bench.items():
            covered = [False] * len(b)
            for i in range(len(b) - n + 1):
                if tuple(b[i : i + n]) in places:
                    covered[i : i + n] = [True] * n
            longest = max(map(len, "".join("x" if c else " " for c in covered).split()), default=0)
            if len(b) >= n and (sum(covered) >= decontaminate.COVER * len(b) or longest >= decontaminate.RUN):
                want.add((d.doc_id, k))
    assert want and want <= got and len(got - want) <= 0.05 * len(want) + 1


def test_contamination_awkward(spark, sf, awkward, nothing):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(awkward, bench).count() == 0 and decontaminate.contaminated(awkward, empty).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.clean(awkward, bench).count() == len(AWKWARD)
