"""The Jaccard join and the components, against brute force over all pairs."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from polyloom.llm import common, jaccard, queries
from polyloom.llm.components import components

from .conftest import AWKWARD


def brute(texts, k=5):
    """doc_id -> (n_shingles, component)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for at, a in enumerate(ids):
        for b in ids[:at]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def found(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, sf).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("short, block, tokens", [(128, 256, 1 << 20), (4, 8, 600)])
def test_groups_of_near_copies(spark, monkeypatch, short, block, tokens):
    """Near copies around the threshold, shared passages and long lists, with blocks of few classes too."""
    for name, value in (("SHORT", short), ("BLOCK", block), ("BLOCK_TOKENS", tokens)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(40)]
    texts, n = {}, 0
    for _ in range(6):
        base = r.choices(vocabulary, k=r.choice([8, 30, 60, 90]))
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            own += r.choices(vocabulary, k=r.randrange(6))
            texts[n] = " ".join(own).title() if r.random() < 0.3 else " ".join(own)
            n += 1
    for _ in range(30):
        texts[n] = " ".join(r.choices(vocabulary, k=r.randrange(4, 60)) + passage)
        n += 1
    for _ in range(10):
        texts[n] = texts[r.randrange(n)]
        n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs) == brute(texts)


def test_awkward(spark, awkward, nothing):
    assert found(awkward) == brute(dict(enumerate(AWKWARD)))
    assert found(nothing) == {}
    rows = jaccard.near_duplicates(awkward.unionByName(awkward)).collect()
    assert len(rows) == 2 * len(AWKWARD) and {(r.doc_id, r.component_id) for r in rows} == {(i, c) for i, (_, c) in brute(dict(enumerate(AWKWARD))).items()}
    none = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(none).collect()), key=str) == [(3, 2, 3), (None, 2, None)]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    rows = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(61)) and all(rows[600 + i] == 500 for i in range(50))
    assert all(rows[a] == rows[b] for a, b in edges) and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    from polyloom.llm import components as module

    monkeypatch.setattr(module, "MANY", 5)
    r = random.Random(4)
    edges = [(1000, i) for i in range(200)] + [(5, 3000 + i) for i in range(40)] + [(7000 + r.randrange(60), 7000 + r.randrange(60)) for _ in range(90)] + [(3001, 9000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    rows = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_merged_lists_equal_counting():
    r = np.random.default_rng(2)
    for _ in range(50):
        lists = [np.unique(r.integers(0, 40, r.integers(1, 30))) for _ in range(r.integers(1, 12))]
        entries, least = np.concatenate(lists), int(r.integers(1, 6))
        count = np.bincount(entries, minlength=40)
        who, n = jaccard.merged(entries, least)
        assert who.tolist() == np.flatnonzero(count >= least).tolist() and n.tolist() == count[count >= least].tolist()


def test_long_texts_have_bounded_bitmaps():
    tokens = np.unique(np.random.default_rng(1).integers(0, 2**63, 60_000, dtype=np.uint64))
    assert len(jaccard.bitmap(tokens)) == jaccard.MOST_BITS // 8 and len(jaccard.bitmap(tokens[:10])) == 8


def test_bitmap_bound_never_exceeds_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, len(a) + 1)], r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (a, b))
        flat, words = np.concatenate([x, y]), np.array([len(x), len(y)])
        first, to = np.array([0, len(x)]), min(len(x), len(y))
        apart = np.bitwise_count(jaccard.folded(flat, first, words, np.array([0]), to) ^ jaccard.folded(flat, first, words, np.array([1]), to)).sum()
        assert apart <= len(np.setxor1d(a, b))


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.5)
    rows = sc.statusStore().executorList(False)
    return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size()))


def test_shared_passages_of_long_texts_shuffle_little(spark):
    """Long texts that share half of their passages with the next: their shared tokens carry no bitmaps, however many partitions they are dealt to."""
    r = random.Random(5)
    passages = [" ".join(f"w{r.randrange(10**6)}" for _ in range(1000)) for _ in range(41)]
    texts = {i: f"{a} {b}" for i, (a, b) in enumerate(zip(passages[:-1], passages[1:], strict=True))}
    docs = common.materialise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    before = shuffled(spark)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        got = found(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == {i: (1996, i) for i in texts}
    assert shuffled(spark) - before < 4 * sum(map(len, texts.values()))


def test_packed_postings_come_back():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 5, 300, 0, 70_000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ids = [-7, 3, 2**62, 9, -(2**63)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), common.lists(np.concatenate(sets).view(np.int64), at, pa.int64())], names=["rep", "n", "prefix"])
    t = pa.Table.from_batches([jaccard.packed(7)(batch)])
    got = set()
    for i in range(t.num_rows):
        token, *rest = (x.tolist() for x in jaccard.unpacked(t.slice(i, 1)))
        got |= {(t.column("bucket")[i].as_py(), *row) for row in zip(token, *rest, strict=True)}
    assert got == {((x >> 40) % 7, x & (1 << 40) - 1, ids[k], len(s), p) for k, s in enumerate(sets) for p, x in enumerate(s.tolist())}


@pytest.mark.parametrize("rows", [100_000, 40])
def test_components_read_no_more_rows_than_nodes_allow(spark, monkeypatch, rows):
    """All pairs of a group: what the rounds read grows with its nodes. Few rows a task make the rounds run."""
    from polyloom.llm import components as module

    monkeypatch.setattr(module, "ROWS", rows)
    monkeypatch.setattr(module, "MANY", 5)
    read, pairs = [], module.pairs

    def counted(df, *ways):
        if df.columns == ["u", "v"]:
            read.append(df.count())
        return pairs(df, *ways)

    monkeypatch.setattr(module, "pairs", counted)
    edges = [(7 * a, 7 * b) for a in range(1, 150) for b in range(a)] + [(5000 + i, 5001 + i) for i in range(100)] + [(9000, 9000)]
    random.Random(2).shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {7 * a: 0 for a in range(150)} | {5000 + i: 5000 for i in range(101)}
    assert max(read) <= 4 * len(got)


@pytest.mark.parametrize("n, m", [(1, 1), (50, 20), (50, 60), (3000, 2500)])
def test_stars_of_a_task(monkeypatch, n, m):
    from polyloom.llm import components as module

    monkeypatch.setattr(module, "ROWS", 30)
    r = np.random.default_rng(n)
    ids = np.unique(r.integers(-(2**63), 2**63 - 1, n))
    edges = ids[r.integers(0, len(ids), (m, 2))]
    up = {int(i): int(i) for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges.tolist():
        a, b = sorted((root(a), root(b)))
        up[b] = a
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"]) for x in np.array_split(edges, 7)]
    rows = [x for t in module.stars(iter(batches)) for x in zip(t.column("u").to_pylist(), t.column("v").to_pylist(), strict=True)]
    assert sorted(rows) == sorted((x, root(x)) for x in up if root(x) != x)
    assert [t.num_rows for t in module.stars(iter([]))] == [0]
