"""Cases in which operators once did less than the whole job."""

import random

import pytest

from polyloom.llm import decontaminate, jaccard, queries, secrets, sentences, suffixes

from .test_repeats import later_windows


# --- 2 ---


def test_sentence_copies_of_any_shape_are_removed(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    shouted = "".join(f"{word()}!! " for _ in range(40))
    two = " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(9))
    passage = " ".join(word() for _ in range(60))
    chinese = "".join(f"{word()} 你好。" for _ in range(20))
    texts = [shouted, shouted, two, two, f"{word()} {word()} {passage} {word()}", f"{word()} {passage} {word()} {word()}", chinese, "x. " + chinese, "Hello there.", "Hello there."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in sentences.remove_repeats(docs, whole=True).collect()}
    assert [i for i in rows if rows[i].n_removed] and {i for i in rows if rows[i].n_removed} == {1, 3, 5, 7, 9}
    assert all(rows[i].n_removed == rows[i].n_sentences for i in (1, 3, 9)) and rows[7].text == "x. "
    assert len(set(rows[5].text.split()) & set(passage.split())) <= 20
    assert all(rows[i].text == texts[i] for i in (0, 2, 4, 6, 8))


def test_frequent_runs_and_ties(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    common_ = " ".join(f"{word()} {word()} {word()}." for _ in range(12))
    texts = [f"{word()} {word()} {word()}. {common_} {word()} {word()}." for _ in range(40)] + ["", None, common_, common_]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for hot in (4096, 3):
        monkeypatch.setattr(sentences, "HOT", hot)
        found.append(sorted(map(str, sentences.remove_repeats(docs, whole=True).collect())))
    monkeypatch.setattr("polyloom.llm.common.SMALL_IDS", 0)
    found.append(sorted(map(str, sentences.remove_repeats(docs, whole=True).collect())))
    assert found[0] == found[1] == found[2]
    rows = {x.doc_id: x for x in sentences.remove_repeats(docs, whole=True).collect()}
    assert common_ in rows[0].text and not any(common_ in (rows[i].text or "") for i in range(1, 44)) and rows[42].text == rows[43].text == ""


# --- 8 ---


@pytest.mark.parametrize(("parts", "hot"), [("1", 4096), ("7", 40)])
def test_suffixes_equal_brute_force_where_many_share_a_passage(spark, parts, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, pre, post = words(48), words(5), words(5)
    texts = {i: words(60) + passage + words(60) for i in range(150)}
    for i, j in ((20, 90), (31, 140)):
        texts[i] = words(60) + pre + passage + words(60)
        texts[j] = words(60) + passage + post + words(60)
        texts[j + 1], texts[i + 1] = words(60) + pre + passage + words(60), words(60) + passage + post + words(60)
    a, b = words(30), words(30)
    texts[200], texts[201], texts[202] = words(40) + a + words(40), words(40) + b + words(40), words(40) + a + b + words(40)
    texts = {i: " ".join(t) for i, t in texts.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = suffixes.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {x.doc_id: {p for s in x.spans for p in range(s.first, s.last)} for x in rows} == later_windows(texts, suffixes.LEAST)


def test_suffix_query_equals_brute_force_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 6)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("1", "7", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found.append(sorted((r.doc_id, r.spans, r.n_words, r.other_docs) for r in queries.op8_suffix_dedup(spark, sf).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    got = {i: {p for x in s.split(",") for p in range(*map(int, x.split(":")))} for i, s, _, _ in found[0]}
    assert got == later_windows(texts, suffixes.LEAST)


# --- 4 ---


def test_names_at_sentence_starts_are_placeholders(spark):
    item = "Tom has 12 apples. Tom buys 30 pears. Tom eats 7 of them. How many remain?"
    wrapped = "The farmer who lives near the river told Élodie that 14 cows\nWandered off towards DENVER while she\nCounted the remaining 9 sheep"
    bench = spark.createDataFrame([(1, item), (2, wrapped)], "item_id long, text string")
    texts = [item.replace("Tom", "Élodie").replace("12", "15"), item.replace("Tom", "ANNA"), wrapped.replace("\n", " ").replace("Élodie", "Zoé").replace("DENVER", "PARIS"), item.replace("Tom buys", "Ann buys").replace("Tom eats", "Sue eats")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(x.doc_id, x.item_id): x.exact for x in decontaminate.contaminated(docs, bench).collect()}
    assert found.keys() >= {(0, 1), (1, 1), (2, 2)} and not any(found.values()) and (3, 1) not in found


def test_parted_numbers_are_one_slot(spark):
    item = "A pump moves 1,000 litres of water in 3.5 hours. Zoë then opens a second pump. How long for 9 tanks?"
    copy = item.replace("1,000", "2.750,5").replace("3.5", "12").replace("Zoë", "Ángel").replace("9", "1,234,567")
    bench = spark.createDataFrame([(None, item), (3, item), (3, item)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x " + copy), (None, copy), (None, copy), (6, item), (7, "quite another text about pumps, tanks and 1,000 other things")], "doc_id long, text string")
    found = sorted(((x.doc_id, x.item_id, x.exact, x.first_word) for x in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert found == sorted([(5, None, False, 1), (5, 3, False, 1), *[(None, None, False, 0), (None, 3, False, 0)] * 2, (6, None, True, 0), (6, 3, True, 0)], key=str)
    assert [x.doc_id for x in decontaminate.clean(docs, bench).collect()] == [7]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, empty).count() == 0 and decontaminate.clean(docs, empty).count() == 5


def test_decontamination_with_windows_that_half_the_texts_share(spark):
    item = "the quick brown fox jumps over the lazy dog near the old mill by the river"
    docs = spark.createDataFrame([(i, item if i % 2 else f"{item[:45]} text {i}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, item + " " + f"w{i} " * 30) for i in range(5)] + [(9, item)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert found >= {(i, 9) for i in range(300) if i % 2} and all(i % 2 or k == 9 for i, k in found)


# --- 1 ---


def test_secrets_anywhere_in_long_candidates_and_of_letters_alone():
    network = secrets.trained()
    key = "Zk3nR8vQ2xLw7TbYc5Jd9MfH"
    texts = ["hooks.slack.com/services/T00000000/B00000000/" + key, "/".join(["some/long/path"] * 6) + "/" + key + "/and/more/of/the/path", "AbKqZtRwXcVbNmLpQsDfGhJk"]
    for t in texts:
        assert secrets.written(secrets.find([f"see {t} ok"], network)[0][0]) == f"net:4:{4 + len(t)}"
    clean = ["some/long/path/of/directories/without/any/secret/inside/it.html", "x" * 1000]
    assert secrets.find(clean, network)[0] == [[], []]


def test_secret_threshold_keeps_recall_below_one_half():
    network = secrets.Network()
    x, y, _ = secrets.examples([], [], generated=400, seed=2)
    network.calibrate(x, y)  # not trained: scores are near one half
    assert (network.accepts(x) & (y == 1)).sum() >= secrets.RECALL * y.sum()


# --- pipeline ---


def test_rows_with_null_or_repeated_ids_are_judged_by_their_text(spark):
    item = "a train leaves the northern station at noon and reaches the harbour after nine long hours"
    text = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item), (1, item), (1, "quite another text"), (None, "clean as well")], "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(docs, bench).collect()) == ["clean as well", "quite another text"]
    copies = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (9, text), (7, item), (None, item), (None, None), (None, None)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(copies).collect()]
    assert sorted(kept, key=str) == sorted([(7, text), (7, item), (None, None), (None, None)], key=str)
