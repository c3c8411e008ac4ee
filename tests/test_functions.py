"""Expressions, statistics, readers, clusters and crosses on small known cases; the published tables where they are at hand."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyloom.functions import labels, sequence, statistics
from polyloom.operators import breeding, clusters, diversity, genotype, profiles, quality, simulation
from polyloom.sources import files
from polyloom.streaming import status

#: A folder with published tables, if there is one; tables are found by their columns.
TABLES = os.environ.get("POLYLOOM_TABLES", "")


def one(spark, **values):
    return spark.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()}))


def value(spark, expression, **values):
    return one(spark, **(values or {"x": 1})).select(expression.alias("v")).first().v


# --- expressions ---


@pytest.mark.parametrize("counts, want", [([3], "AAAA"), ([2, 1], "AAAB"), ([3, 2], "AABB"), ([1, 1], "AABB"), ([1, 1, 1], "AABC"), ([1, 1, 1, 1], "ABCD"), ([2, 1, 1, 1, 1], "ABCD")])
def test_genotype_class(spark, counts, want):
    assert value(spark, labels.genotype_class("c"), c=counts) == want


@pytest.mark.parametrize("broken, total, want", [(1, 3, ("Insufficient_data", None, None)), (0, 5, ("SI", None, 0)), (1, 4, ("SI", None, 1)), (5, 40, ("SI", None, 0)), (4, 4, ("SC", None, 4)), (2, 8, ("pSI", "high", 1)), (2, 10, ("pSI", "low", 1))])
def test_si_status(spark, broken, total, want):
    assert tuple(value(spark, labels.si_status("b", "t"), b=broken, t=total)) == want


def test_other_labels(spark):
    assert value(spark, labels.dominant_reason(F.lit("a(4);b(1)"))) == "a" and value(spark, labels.dominant_reason(F.lit("a(4);b(2)"))) == "mixed"
    assert value(spark, labels.bucket("x", [0.0, 1.0, 2.0]), x=1.0) == "[0, 1]" and value(spark, labels.bucket("x", [0.0, 1.0, 2.0]), x=1.5) == "(1, 2]" and value(spark, labels.bucket("x", [0.0, 1.0]), x=3.0) is None
    assert value(spark, labels.cross_category("a", "b", "d"), a="I", b="I", d=0.01) == "Synonymy_test" and value(spark, labels.cross_category("a", "b", "d"), a="I", b="II", d=0.0) == "Compatible_cross"
    assert value(spark, labels.null_label("c", "n"), c=[2, 1], n=1) == "AAB0"
    assert value(spark, labels.biological_allele("a", "g"), a="Allele_1", g="Isolated") == "Allele_1" and value(spark, labels.biological_allele("a", "g"), a="x", g="Group_12") == "Synonymy_group_12"
    known = F.array(F.lit("EO18"), F.lit("EO25"), F.lit("EO118"))
    for raw, want in (("", (None, "Unassigned")), ("15", ("EO18", "Inferred")), (" 25 ", ("EO25", "Assigned")), ("118-A", ("EO118", "Inferred")), ("7", (None, "Unassigned"))):
        assert tuple(value(spark, labels.site_status("r", known), r=raw)) == want
    assert value(spark, labels.group_status("m", "s"), m=2 / 3, s=0.1) == "OK" and value(spark, labels.group_status("m", "s"), m=0.5, s=0.4) == "CRITICAL"


def test_sequences(spark):
    assert value(spark, sequence.translate("d"), d="ATG-GCNTAATG") == "MX*" and value(spark, sequence.translate("d"), d="AT") == ""
    assert value(spark, sequence.reverse_complement("d"), d="AACGTn") == "nACGTT"
    assert value(spark, sequence.stop_positions("p"), p="A*B*C*") == [2, 4] and value(spark, sequence.stop_status("p"), p="ABC*") == "OK"
    assert value(spark, sequence.p_distance("a", "b"), a="AC-GT", b="AGTG-") == pytest.approx(1 / 3) and value(spark, sequence.p_distance("a", "b", empty=0.0), a="--", b="AB") == 0.0
    assert value(spark, sequence.backfill_ends("a", "r", 2), a="----C-G---", r="ABCDEFGHIJ") == "ABNNC-GNIJ" and value(spark, sequence.backfill_ends("a", "r"), a="--", r="AB") is None
    assert value(spark, sequence.failures("p", 5), p="AX*B*") == ["too_short", "contains_X", "internal_stop"]
    assert value(spark, sequence.project_exons("a", [(1, 3), (6, 7)]), a="AC-GTTGA") == "ACTG" and sequence.column_map("A--CG") == [1, 4, 5]
    assert value(spark, sequence.n_content_ok("d", 1, 0.5), d="ANNG") is False and value(spark, sequence.masked("p", 2, 3), p="AXBXC") == "*B*"


# --- statistics ---


def test_distributions():
    assert statistics.chi2_p(3.841458820694124, 1) == pytest.approx(0.05) and statistics.chi2_p(18.307038053275146, 10) == pytest.approx(0.05)
    assert statistics.fisher_p(8, 2, 1, 5) == pytest.approx(0.03496503496503495) and statistics.fisher_p(3, 0, 0, 3) == pytest.approx(0.1)
    u, p = statistics.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert u == 0 and p == pytest.approx(0.0808556, abs=1e-6)
    h, p = statistics.kruskal([np.array([1.0, 2, 3]), np.array([4.0, 5, 6])])
    assert h == pytest.approx(3.857142857) and p == pytest.approx(0.0495346, abs=1e-6)
    n = np.arange(1, 60)
    assert statistics.saturation_fit(n, 50 * n / (12 + n)) == pytest.approx((50, 12), rel=1e-6)
    assert math.isnan(statistics.saturation_fit(np.array([1]), np.array([1]))[0])


# --- readers ---


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">s1 count=3\nACG\nTT\n>s2\nGG\n>s3|x  two words\n\n")
    rows = files.read_fasta(spark, str(p)).orderBy("ord").collect()
    assert [(r.id, r.description, r.seq) for r in rows] == [("s1", "count=3", "ACGTT"), ("s2", "", "GG"), ("s3|x", "two words", "")]
    files.write_fasta(files.read_fasta(spark, str(p)).orderBy("ord"), str(tmp_path / "out"))
    assert {(r.id, r.seq) for r in files.read_fasta(spark, str(tmp_path / "out")).collect()} == {(r.id, r.seq) for r in rows}


def test_fasta_headers_may_hold_a_mark(spark, tmp_path):
    (tmp_path / "b.fasta").write_text("\n>x|a>b first > second\r\nAC\r\nGT\r\n>y\n>z\nTT\n")
    rows = files.read_fasta(spark, str(tmp_path / "b.fasta")).orderBy("ord").collect()
    assert [(r.id, r.description, r.seq) for r in rows] == [("x|a>b", "first > second", "ACGT"), ("y", "", ""), ("z", "", "TT")]


def test_truncated_gzip_gives_what_can_be_read(spark, tmp_path):
    import gzip
    import random

    r = random.Random(1)
    text = "".join(f"@r{i}\n{''.join(r.choices('ACGT', k=80))}\n+\n{''.join(map(chr, r.choices(range(40, 70), k=80)))}\n" for i in range(4000)).encode()
    whole = gzip.compress(text)
    (tmp_path / "cut.fastq.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "whole.fastq.gz").write_bytes(whole)
    got = {x.file.rsplit("/", 1)[1]: x for x in files.read_stats(files.read_fastq(spark, [str(tmp_path / "cut.fastq.gz"), str(tmp_path / "whole.fastq.gz")])).collect()}
    assert got["whole.fastq.gz"].reads == 4000 and 1500 < got["cut.fastq.gz"].reads < 2500 and got["cut.fastq.gz"].n50 == 80


def test_quoted_header(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a, b",c\n"x, y",2\n')
    df = files.read_table(spark, str(tmp_path / "q.csv"), ",", {"c": "int"})
    assert df.columns == ["a, b", "c"] and tuple(df.first()) == ("x, y", 2)


def test_sinks_refuse_to_replace(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.23456), ("a", 2.0)], "k string, v double")
    files.write_table(df, str(tmp_path / "t"), ["k"], {"v": 2})
    with pytest.raises(Exception, match="exist"):
        files.write_table(df, str(tmp_path / "t"), ["k"])
    files.write_table(df, str(tmp_path / "t"), ["k"], overwrite=True)
    assert [r.k for r in files.read_table(spark, str(next((tmp_path / "t").glob("part-*"))), "\t").collect()] == ["a", "b"]
    exons = spark.createDataFrame([("gene", "1", "9"), ("exon", "50", "90"), ("exon", "5", "9"), ("exon", "1", "2")], "V3 string, V4 string, V5 string")
    assert [r.V4 for r in files.exons(exons, 4).collect()] == ["5", "50"]


def test_tables_and_reads(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,Tube #,Tube #\nx,1,2\ny,,3\n", encoding="utf-8")
    df = files.read_table(spark, str(tmp_path / "t.csv"), ",", {"Tube #": "int"})
    assert df.columns == ["a", "Tube #", "Tube #_2"] and [tuple(r) for r in df.orderBy("a").collect()] == [("x", 1, "2"), ("y", None, "3")]
    with pytest.raises(ValueError):
        files.require_columns(df, ["b"])
    assert files.shadowed(["L1.fasta", "L1_Nfilt.fasta", "L2.fasta"]) == ["L1_Nfilt.fasta", "L2.fasta"]
    (tmp_path / "r.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+\n!!\n@c\nACG\n+\n")
    s = files.read_stats(files.read_fastq(spark, str(tmp_path / "r.fastq")), long=4).first()
    assert (s.reads, s.bases, s.long_reads, s.n50, s.median) == (3, 9, 1, 3, 3) and s.quality_by_base == 26.67 and s.quality_by_read == 20
    (tmp_path / "rep.txt").write_text("x\nFound 1,234 reads.\nFound 5 reads\n")
    assert files.report_count(spark, str(tmp_path / "rep.txt")).first().reads == 1234
    d = files.dense_depth(spark.createDataFrame([("c", 2, 5), ("c", 4, 7)], "contig string, pos int, depth int"))
    assert [r.depth for r in d.orderBy("pos").collect()] == [0, 5, 0, 7]


def test_trees():
    nodes = files.parse_newick("((a:1,b:1)90:5,(c:1,(d:1,e:1)95:1)80:2);")
    got = dict(clusters.supported_clades(nodes, 70))
    assert got["a"] == got["b"] and got["d"] == got["e"] and len({got["a"], got["c"], got["d"]}) == 3
    assert clusters.class_split(nodes) == {"a": "I", "b": "I", "c": "II", "d": "II", "e": "II"}


# --- operators ---


def test_genotype_path(spark):
    facts = spark.createDataFrame([(1, "p1", "A"), (1, "p2", "A"), (1, "p3", "B"), (2, "p1", "A"), (2, "p1", "A")], "individual int, protein string, allele string")
    c = genotype.copy_counts(facts)
    assert {(r.individual, r.genotype, r.composition) for r in genotype.genotypes(c).collect()} == {(1, "AAAB", "A(2)+B(1)"), (2, "AAAA", "A(1)")}
    assert {tuple(r) for r in genotype.four_copies(c).collect()} == {(1, "A", 3), (1, "B", 1), (2, "A", 4)}
    own = genotype.apportioned(c.withColumn("target", F.lit(4)))
    assert {(r["individual"], r["n"]) for r in own.groupBy("individual").agg(F.sum("n").alias("n")).collect()} == {(1, 4), (2, 4)}
    s = spark.createDataFrame([(1, "pSI", "high", 1), (2, "SI", None, 0), (3, "SC", None, 4)], "individual int, status string, confidence string, copies int")
    got = {r.individual: (r.composition, r.label) for r in genotype.null_aware(c, s).collect()}
    assert got == {1: ("A(2)+B(1)+Allele_NULL(1)", "AAB0"), 2: ("A(4)", "AAAA"), 3: ("Allele_NULL(4)", "0000")}


def test_named_by_first_appearance(spark):
    rows = [(i, s) for i, s in enumerate("bbacabd")]
    got = {r.seq: (r.number, r.n) for r in genotype.named_proteins(spark.createDataFrame(rows, "ord long, seq string").repartition(3)).collect()}
    assert got == {"b": (1, 3), "a": (2, 2), "c": (3, 1), "d": (4, 1)}


def test_linkage_equals_plain_search():
    r = np.random.default_rng(3)
    for n in (2, 3, 9, 30):
        x = r.random((n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        groups, want = {i: [i] for i in range(n)}, []
        while len(groups) > 1:  # the two groups with the least mean distance
            h, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b)
            want.append((a, b, h, len(groups[a]) + len(groups[b])))
            groups[n + len(want) - 1] = groups.pop(a) + groups.pop(b)
        assert np.allclose(clusters.linkage(d), np.array(want))


def test_ward_and_numbers_of_clusters(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.05, (6, 2)) for c in ((0, 0), (1, 0), (0, 1))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups, want = {i: [i] for i in range(18)}, []
    while len(groups) > 1:  # the two groups whose union adds least to the squares within
        cost = lambda a, b: 2 * len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b])) * ((x[groups[a]].mean(0) - x[groups[b]].mean(0)) ** 2).sum()
        h, a, b = min((cost(a, b), a, b) for a in groups for b in groups if a < b)
        want.append((a, b, h**0.5, len(groups[a]) + len(groups[b])))
        groups[18 + len(want) - 1] = groups.pop(a) + groups.pop(b)
    assert np.allclose(clusters.linkage(d, "ward"), np.array(want))
    rows = spark.createDataFrame([(f"{i:02d}", f"{j:02d}", float(d[i, j])) for i in range(18) for j in range(i + 1, 18)], "a string, b string, d double")
    got = {y.clusters: y for y in clusters.cluster_numbers(rows, 5).collect()}
    assert max(got, key=lambda k: got[k].silhouette) == 3 and got[2].within > 10 * got[3].within
    own = clusters.clustered(rows, clusters=3, method="ward")
    s = clusters.silhouettes(rows, own).agg(F.avg("silhouette")).first()[0]
    assert s == pytest.approx(got[3].silhouette) and s > 0.8


def test_pairs_and_nearest_in_blocks(spark, monkeypatch):
    from polyloom.operators import profiles

    r = np.random.default_rng(0)
    seqs = {f"s{i:02d}": "".join(r.choice(list("ACG-"), 12)) for i in range(30)}
    df = spark.createDataFrame(list(seqs.items()), "id string, seq string")

    def distance(a, b):
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" and y != "-"]
        return sum(x != y for x, y in pairs) / len(pairs) if pairs else None

    for block in (1000, 7):
        monkeypatch.setattr(profiles, "BLOCK", block)
        got = {(x.a, x.b): x.d for x in profiles.pairwise(df).collect()}
        assert got == {(a, b): distance(seqs[a], seqs[b]) for a in seqs for b in seqs if a < b}
        near = {}
        for x in profiles.nearest(df.limit(5), df).orderBy("query", "at").collect():
            near.setdefault(x["query"], []).append((x.d, x.reference))
        assert all(v == sorted((distance(seqs[q], seqs[b]), b) for b in seqs if distance(seqs[q], seqs[b]) is not None)[:2] for q, v in near.items()) and len(near) == 5


def test_linkage():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0.0]])
    tree = clusters.linkage(d)
    assert tree[:, 2].tolist() == [1, 2, 4.5] and clusters.cut(tree, 4, clusters=2).tolist() == [1, 1, 2, 2] and clusters.cut(tree, 4, height=1).tolist() == [1, 1, 2, 3]
    assert clusters.largest_gap(tree[:, 2]) == 3.25


def test_components_and_groups(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    n = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert {r.node: r.group for r in clusters.synonymy_groups(n, e).collect()} == {"a": "Group_1", "b": "Group_1", "c": "Group_1", "d": "Group_2", "e": "Group_2", "f": "Isolated"}


@pytest.mark.parametrize("mode", ["tetrasomic", "disomic"])
def test_offspring_sum_to_one(spark, mode):
    c = spark.createDataFrame([("x", ["a", "a", "b", "c"], ["d", "e", "e", "f"]), ("y", ["a", "a", "a", "b"], ["a", "c", "c", "d"])], "cross string, mother array<string>, father array<string>")
    o = breeding.offspring(c, 0.2, mode).groupBy("cross").agg(F.sum("p").alias("p"), F.max("compatibility").alias("k")).collect()
    assert all(r.p == pytest.approx(1) for r in o) and {r.cross: round(r.k, 9) for r in o}["x"] == 1
    g = breeding.gametes(c.select(F.col("mother").alias("genotype")), mode=mode).groupBy("genotype").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in g)


def test_greedy_and_weights():
    t = pd.DataFrame({"mother": ["a", "a", "c", "e"], "father": ["b", "c", "d", "f"], "group": ["x", "x", "x", "y"]})
    assert breeding.greedy(t, 5).index.tolist() == [0, 2, 3] and breeding.greedy(t, 5, per={"*": 1}).index.tolist() == [0, 3] and breeding.greedy(t, 5, reuse=True).index.tolist() == [0, 1, 2, 3]
    w, v = breeding.best_weights(np.eye(3), np.array([0.6, 0.2, 0.2]), np.full(3, 1 / 3), np.zeros(3), floor=0)
    assert w.sum() == pytest.approx(1) and w[0] < w[1] == pytest.approx(w[2], abs=1e-6) and v < 1e-3


def test_profiles(spark):
    s = spark.createDataFrame([("c", i, float(i)) for i in range(1, 11)], "g string, pos int, v double")
    rows = [r.smooth for r in profiles.smoothed(s, "g", "pos", "v", 4).orderBy("pos").collect()]
    x = np.arange(1, 11, dtype=float)
    padded = np.concatenate([x[:2][::-1], x, x[-1:]])
    assert rows == pytest.approx([padded[i : i + 4].mean() for i in range(10)])
    runs = profiles.islands(spark.createDataFrame([("c", p) for p in (1, 2, 3, 7, 9, 10)], "g string, pos int"), "g", "pos", 2)
    assert {(r["first"], r["last"]) for r in runs.collect()} == {(1, 3), (9, 10)}
    curve = spark.createDataFrame([(i / 100, 60 - i if i < 20 else 40) for i in range(60)], "threshold double, clusters int")
    assert profiles.plateau(curve).first().flat_y == 40


def test_frequency_compatibility():
    assert simulation.frequency_compatibility(np.full(20, 0.05)) == pytest.approx(sum(0.05**2 * (1 - 0.05 - (0.05 if a != b else 0)) ** 4 for a in range(20) for b in range(20)))


def test_rarefaction_is_the_mean_of_permutations(spark):
    r = np.random.default_rng(0)
    carriers = {str(i): set(r.choice(list("abcdefghij"), 2)) for i in range(40)}
    rows = [("g", a, sum(a in s for s in carriers.values()), 40) for a in sorted(set().union(*carriers.values()))]
    df = spark.createDataFrame(rows, "g string, allele string, carriers long, people long")
    exact = diversity.rarefied_richness(df, "g", 10).first().rarefied
    names = sorted(carriers)
    runs = np.array([[len(set().union(*(carriers[names[i]] for i in order[:k]))) for k in (3, 10)] for order in (r.permutation(40) for _ in range(4000))])
    assert exact == pytest.approx(runs[:, 1].mean(), abs=0.05)
    long = spark.createDataFrame([("g", i, a) for i, s in carriers.items() for a in s], "g string, individual string, allele string")
    spread = {x.n: x for x in diversity.accumulation_spread(long, "g", [3, 10, 40]).collect()}
    assert spread[10].mean == pytest.approx(exact) and spread[40].sd == pytest.approx(0, abs=1e-5)
    assert [spread[k].sd for k in (3, 10)] == pytest.approx(runs.std(0), rel=0.06)
    curve = {x.n: x.alleles for x in diversity.accumulation_curve(df, "g").collect()}
    assert curve[10] == pytest.approx(exact) and curve[40] == pytest.approx(len(rows))


def test_stream(spark, tmp_path):
    import datetime

    rows = [(f"L_b{i % 2}_{i}", "OK" if i % 3 else "REMOVED", datetime.datetime(2024, 1, 1, 0, i)) for i in range(12)]
    spark.createDataFrame(rows, status.LOG).write.parquet(str(tmp_path / "logs"))
    q = status.run_available(status.status_stream(status.log_stream(spark, str(tmp_path / "logs"))), "haps", str(tmp_path / "state"))
    assert not q.isActive and {r.individual: (r.ok, r.removed) for r in spark.table("haps").collect()} == {"L_b0": (4, 2), "L_b1": (4, 2)}


# --- published tables ---


needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no published tables here")


def published(spark, *columns, **types):
    """The first table whose header has these columns."""
    for folder, _, names in sorted(os.walk(TABLES)):
        for name in sorted(n for n in names if n.endswith(".tsv")):
            if {*columns, *types} <= set(files.header(spark, f"{folder}/{name}", "\t")):
                return files.read_table(spark, f"{folder}/{name}", "\t", types)
    pytest.skip("no such table")


@needs_tables
def test_published_genotype_classes(spark):
    z = published(spark, "Individual", "Allele_composition", "Genotype", "N_total_proteins").withColumnRenamed("Individual", "individual")
    got = {r.individual: r.genotype for r in genotype.genotypes(genotype.parsed_composition(z, "Allele_composition")).collect()}
    assert len(got) == 367 and got == {r.individual: r.Genotype for r in z.collect()}


@needs_tables
def test_published_status(spark):
    s = published(spark, "SI_status", n_haps_OK="int", n_haps_REMOVED="int", n_haps_total="int")
    got = s.select("SI_status", labels.si_status("n_haps_REMOVED", "n_haps_total").alias("x")).collect()
    assert len(got) == 497 and all(r.SI_status == r.x.status for r in got)


@needs_tables
def test_published_chi_square_and_chao1(spark):
    z = published(spark, "Individual", "Allele_composition", "Genotype", "N_total_proteins").withColumnRenamed("Individual", "individual")
    c = genotype.parsed_composition(z, "Allele_composition").withColumn("level", F.lit("species"))
    t = diversity.allele_totals(c, "level")
    x = diversity.uniform_chi2(t, "level").first()
    assert x.x2 == pytest.approx(4405.19268635724, abs=1e-6) and x.df == 48
    assert diversity.chao1(t, "level").first().chao1_ceiling == 54


@needs_tables
def test_published_null_aware_genotypes(spark):
    """Copies of the genotype table and the status table give the published null-aware one: label, composition and flag."""
    z = published(spark, "Individual", "Allele_composition", "Genotype", "N_total_proteins").withColumnRenamed("Individual", "individual")
    c = genotype.parsed_composition(z, "Allele_composition")
    s = published(spark, "SI_status", "pSI_confidence", "Sample_ID", "n_haps_OK", copies_nonfunctional="int")
    s = s.select(F.col("Sample_ID").alias("individual"), F.col("SI_status").alias("status"), F.col("pSI_confidence").alias("confidence"), F.col("copies_nonfunctional").alias("copies"))
    got = {r.individual: (r.label, r.flag, r.null_copies, tuple(sorted(r.composition.split("+")))) for r in genotype.null_aware(c, s).collect()}
    want = published(spark, "Individual", "Genotype_class_flag", "Allele_composition", "N_distinct_functional_alleles", N_null_copies="int").collect()
    assert len(want) == 368 and got == {r.Individual: (r.Genotype, r.Genotype_class_flag, r.N_null_copies, tuple(sorted(r.Allele_composition.split("+")))) for r in want}


@needs_tables
def test_published_strategies_and_scores(spark):
    g = published(spark, "Individual", "Genotype_Pattern", "GFS_class", "Method", GFS="double")
    for r in g.select("GFS", "GFS_class", "Genotype_Pattern", labels.class_score("Genotype_Pattern").alias("s"), labels.score_class("GFS").alias("c")).collect():
        assert r.s == pytest.approx(r.GFS, abs=1e-3) and r.GFS_class.startswith(r.c)
