"""The corpus pipeline: each stage against its own input, and the driver contract."""

import hashlib

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from polyloom.llm import common, jaccard, secrets

from .test_jaccard import brute


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(common.materialise(stage(spark, made[-1], sf)))
    for d in made[:-1]:
        assert d.columns == docs.columns
    rows = [{r.doc_id: r for r in d.collect()} for d in made]
    bad = {r.doc_id for r in common.table(spark, sf, "labels").where("quality = 0").collect()} & set(rows[0])
    good = {r.doc_id for r in common.table(spark, sf, "labels").where("quality = 1").collect()} & set(rows[0])
    assert len(bad & set(rows[1])) <= 0.1 * len(bad) + 1 and len(good & set(rows[1])) >= 0.9 * len(good)
    components = brute({i: r.text for i, r in rows[1].items()})
    assert set(rows[2]) == {i for i, (_, c) in components.items() if c == i}
    assert set(rows[3]) < set(rows[2]) and set(rows[4]) == set(rows[3]) == set(rows[5])
    for i, r in rows[4].items():
        assert not secrets.base_spans(r.text) and (r.text == rows[3][i].text or "[SECRET]" in r.text)
        assert r.n_chars == (len(r.text) if r.text != rows[3][i].text else rows[3][i].n_chars)
        assert rows[5][i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and rows[5][i].n_tokens == len(rows[5][i].ids)
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == {(i, r.ids_sha256) for i, r in rows[5].items()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty(spark, sf, awkward, nothing, stage):
    assert stage(spark, nothing, sf).count() == 0
    assert stage(spark, awkward, sf).count() >= (0 if stage is corpus_pipeline.quality_filter else 5)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_repeated_rows_and_other_columns(spark, sf, awkward, stage):
    """Rows that repeat (ids too) get equal results; the near-duplicate stage keeps one of them."""
    once = [tuple(r) for r in stage(spark, awkward, sf).collect()]
    twice = [tuple(r) for r in stage(spark, awkward.unionByName(awkward), sf).collect()]
    if stage is corpus_pipeline.near_duplicates:
        assert {r[:2] for r in twice if r[1]} == {r[:2] for r in once if r[1]} and len({r[1] for r in twice if r[1] and r[1].strip()}) == len([r for r in twice if r[1] and r[1].strip()])
    elif stage is not corpus_pipeline.quality_filter:
        assert sorted(map(str, twice)) == sorted(map(str, once * 2))
    else:
        assert len(twice) % 2 == 0 and {r[0] for r in twice} <= set(range(len(awkward.collect())))


def test_contract():
    names = list(entry_point.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(entry_point.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]


def test_near_duplicates_of_many_ids_keep_texts_in_place(spark, sf, monkeypatch):
    """Where more ids are compared than a join sends out, stage 2 gives the same rows and its plan shuffles no text for them."""
    docs = common.table(spark, sf, "documents")
    ids = docs.where("doc_id % 2 = 0").selectExpr("doc_id AS rep")
    whole = docs.select("doc_id", "text")
    want = {(r.rep, bytes(r.tokens)) for r in jaccard.token_sets(whole, ids, jaccard.K).collect()}
    monkeypatch.setattr(common, "SMALL_IDS", 1)
    sets = jaccard.token_sets(whole, ids, jaccard.K)
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    assert {(r.rep, bytes(r.tokens)) for r in sets.collect()} == want


def test_links_of_a_cut_cluster_are_contracted_before_the_rounds(spark, monkeypatch):
    """160 near copies in 20 blocks: each pair of blocks reports a forest, and the rounds read no more rows than there are copies."""
    from polyloom.llm import components

    monkeypatch.setattr(jaccard, "BLOCK", 8)
    read, pairs = [], components.pairs

    def counted(df, *ways):
        if df.columns == ["u", "v"]:
            read.append(df.count())
        return pairs(df, *ways)

    monkeypatch.setattr(components, "pairs", counted)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} own{i}", "en", "s", 0) for i in range(160)] + [(999, base.replace("w", "v"), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 999]
    assert max(read) < 160
