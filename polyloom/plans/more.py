"""Further queries with their SQL: classifications, joins, ordered and set operators, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyloom.functions import labels, sequence
from polyloom.operators import breeding, diversity, genotype, profiles, quality, sets
from polyloom.plans import tables as t
from polyloom.plans.registry import _CELLS, _DEPTH, _aaaa, _cells, _depth, query, r6
from polyloom.plans.tables import cte

_SRC = "g AS (SELECT source, count(*) AS total, count(*) FILTER (length(text) >= 500) AS functional, count(DISTINCT lang) AS alleles, count(*) FILTER (length(text) >= 500) / count(*)::DOUBLE AS rate FROM documents GROUP BY source)"


@query("WITH " + _SRC + " SELECT source, total, functional, CASE WHEN total = 0 THEN 'no_sequences' WHEN functional = 0 THEN 'no_functional_proteins' WHEN alleles > 3 THEN 'too_many_alleles' WHEN rate < 0.95 THEN 'low_functional_rate' ELSE 'normal' END AS state FROM g")
def individual_states(spark, sf):
    d = t.table(spark, sf, "documents")
    ok = F.length("text") >= 500
    g = d.groupBy("source").agg(F.count("*").alias("total"), F.count_if(ok).alias("functional"), F.count_distinct("lang").alias("alleles")).withColumn("rate", F.col("functional") / F.col("total"))
    return g.select("source", "total", "functional", labels.individual_class("total", "functional", "alleles", F.lit(False), "rate", most=3, least_rate=0.95).alias("state"))


@query("""SELECT l_orderkey AS qseqid, l_partkey AS sseqid, floor(l_extendedprice / 20000) AS bitscore FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice / 20000) DESC, l_linenumber, l_partkey) AS pl FROM lineitem) WHERE pl = 1 AND l_quantity / 50.0 >= 0.5 AND 100 * (1 - l_discount) >= 95""")
def best_hits(spark, sf):
    """Scores in coarse steps, so that many are tied; the hit that comes first in its file counts."""
    h = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qseqid"), F.col("l_partkey").alias("sseqid"), (100 * (1 - F.col("l_discount"))).alias("pident"), F.col("l_quantity").alias("length"), F.lit(50.0).alias("qlen"), F.floor(F.col("l_extendedprice") / 20000).cast("double").alias("bitscore"), F.struct("l_linenumber", "l_partkey").alias("place"))
    return genotype.best_hits(h, coverage=0.5, order="place").select("qseqid", "sseqid", "bitscore")


_AUDIT = """WITH g AS (SELECT o_orderkey, o_custkey, o_orderkey % 50 AS o, o_orderstatus = 'F' AND o_custkey % 5 = 0 AS genotyped, o_custkey % 3 = 0 AS has_log, count(l_orderkey) FILTER (o_orderkey % 7 > 0) AS raw, count(*) FILTER (l_quantity >= 20) AS n4, count(*) FILTER (l_discount <= 0.05) AS n4b, count(*) FILTER (l_tax <= 0.04) AS n7b, CASE o_custkey % 7 WHEN 0 THEN 'no_functional_proteins' WHEN 1 THEN 'too_many_alleles' WHEN 2 THEN 'dropped_abundance_filter' WHEN 3 THEN 'no_sequences' WHEN 4 THEN 'normal' END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'premature_stop(9);ambiguous_aa(2)' WHEN 1 THEN 'ambiguous_aa(5)' WHEN 2 THEN 'premature_stop(4);ambiguous_aa(2)' END AS reasons FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
d AS (SELECT *, CASE WHEN genotyped THEN '' WHEN raw = 0 THEN 'Stage 3 — no assembly' WHEN n4 = 0 THEN 'Step 4 — length filter' WHEN has_log AND n4b = 0 THEN 'Step 4b — BLAST coverage filter' WHEN has_log AND n7b = 0 THEN 'Step 7b — N-content filter' WHEN label <> 'normal' THEN 'Step 9 — ' || label WHEN o = 0 THEN 'Step 11 — outgroup filter' ELSE 'Unknown' END AS stage FROM g)
"""


def _audited(spark, sf):
    o, li = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    g = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus", "o_custkey")
    g = g.agg(F.count(F.when(F.col("o_orderkey") % 7 > 0, F.col("l_orderkey"))).alias("raw"), F.count_if(F.col("l_quantity") >= 20).alias("n4"), F.count_if(F.col("l_discount") <= 0.05).alias("n4b"), F.count_if(F.col("l_tax") <= 0.04).alias("n7b"))
    of = lambda column, *names: F.get(F.array(*[F.lit(x) for x in names]), column)
    g = g.withColumns({"label": of((F.col("o_custkey") % 7).cast("int"), "no_functional_proteins", "too_many_alleles", "dropped_abundance_filter", "no_sequences", "normal", None, None), "reasons": of((F.col("o_orderkey") % 4).cast("int"), "premature_stop(9);ambiguous_aa(2)", "ambiguous_aa(5)", "premature_stop(4);ambiguous_aa(2)", None)})
    log = F.col("o_custkey") % 3 == 0
    return g.withColumn("d", labels.audit_decision((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 5 == 0), "raw", "n4", "n4b", "n7b", log, log, "label", "reasons", F.when(F.col("o_orderkey") % 50 == 0, "0").otherwise("1")))


@query(_AUDIT + """SELECT o_orderkey, CASE WHEN genotyped THEN 'Included' ELSE 'Excluded' END AS decision, stage, CASE WHEN genotyped THEN '' WHEN stage LIKE 'Stage 3%' THEN 'sample present in metadata but no haplotypes assembled by Canu — needs re-sequencing' WHEN stage LIKE 'Step 4 %' THEN raw || ' raw haps, 0 passed 3250–4000 bp length filter — likely fragmented or chimeric assembly; re-sequencing recommended' WHEN stage LIKE 'Step 4b%' THEN n4 || ' haps after Step 4, 0 passed coverage ≥ 0.90 / identity ≥ 95 vs canonical target — likely target paralogs / off-target; do NOT re-sequence (issue is sequence identity, not coverage)' WHEN stage LIKE 'Step 7b%' THEN n4b || ' haps after Step 4b, 0 passed N ≤ 9 — short Canu contigs filled with N''s by Step 7 backfill; re-sequencing may help if more reads recover longer contigs'
WHEN stage LIKE 'Step 9%' THEN CASE label WHEN 'no_sequences' THEN 'no DNA sequences reached define_functional_proteins.py' WHEN 'too_many_alleles' THEN '>4 distinct proteins per individual — likely contamination / assembly artefact' WHEN 'dropped_abundance_filter' THEN 'functional proteins present but below min_count = 5 abundance filter' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'all sequences carry premature stop codons — strong candidate for ongoing SI breakdown / self-compatibility escape; recommend controlled selfing test to phenotype' WHEN 1 THEN 'all sequences carry X residues from N-rich data — quality issue, NOT a biological SI escape; re-sequencing may help (would have been caught by Step 7b if applied)' WHEN 2 THEN 'mixed premature_stop + ambiguous_aa failures — both LoF mutations AND data-quality issues; interpret cautiously' ELSE 'all sequences failed translation / validation' END END || ' (Top failures: ' || coalesce(reasons, 'n/a') || ')'
WHEN stage LIKE 'Step 11%' THEN 'Ingroup = 0 in metadata; intentionally excluded from SI analyses (NOT a quality issue)' ELSE 'no exclusion stage identified — investigate manually' END AS reason FROM d""")
def audit_decisions(spark, sf):
    return _audited(spark, sf).select("o_orderkey", F.col("d.status").alias("decision"), "d.stage", "d.reason")


@query(_AUDIT + """, s AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'Functional' WHEN 1 THEN 'Partial_translation_failure' WHEN 2 THEN 'Complete_loss' ELSE 'NA' END AS loss FROM d),
c AS (SELECT o_orderkey, stage, CASE WHEN o = 0 THEN 'Outgroup' WHEN genotyped THEN CASE WHEN loss = 'Partial_translation_failure' THEN loss ELSE 'Functional' END WHEN loss = 'Complete_loss' AND o_orderkey % 4 = 0 THEN 'SI_escape_candidate' WHEN stage = 'Step 9 — too_many_alleles' THEN 'Re_DNA_extraction' ELSE 'Re_PCR' END AS category FROM s)
SELECT category, CASE category WHEN 'Re_PCR' THEN 'Re-PCR' WHEN 'Re_DNA_extraction' THEN 'Re-DNA-extraction' END AS action, CASE category WHEN 'Re_DNA_extraction' THEN 'Re-isolate tissue' WHEN 'Re_PCR' THEN CASE WHEN stage LIKE 'Stage 3%' THEN 'Re-PCR (no Canu as' WHEN stage LIKE 'Step 4 — length%' THEN 'Re-PCR (current pr' WHEN stage LIKE 'Step 4b%' THEN 'Re-PCR (current am' WHEN stage LIKE 'Step 7b%' THEN 'Re-PCR (short PCR ' WHEN stage LIKE '%dropped_abundance_filter%' THEN 'Re-PCR (low yield ' WHEN stage LIKE '%no_functional_proteins%' THEN 'Re-PCR (short / di' ELSE 'Re-PCR (see audit ' END END AS start, count(*) AS n FROM c GROUP BY ALL""")
def qc_outcomes(spark, sf):
    """Outcome category and what the laboratory is asked to do (the first words of it)."""
    a = _audited(spark, sf)
    loss = F.get(F.array(*[F.lit(x) for x in ("Functional", "Partial_translation_failure", "Complete_loss", "NA")]), (F.col("o_custkey") % 4).cast("int"))
    c = a.withColumn("category", labels.qc_category(F.when(F.col("o_orderkey") % 50 == 0, "0").otherwise("1"), "d.status", "d.stage", loss, labels.dominant_reason(F.coalesce("reasons", F.lit("")))))
    w = c.withColumn("w", labels.lab_action("category", "d.stage"))
    return w.groupBy("category", "w.action", F.substring("w.recommended", 1, F.when(F.col("w.action") == "Re-PCR", 18).otherwise(17)).alias("start")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey AS individual, l_returnflag AS reason, count(*) AS n, min(l_linenumber) AS o FROM lineitem GROUP BY ALL) SELECT individual, string_agg(reason || '(' || n || ')', '; ' ORDER BY n DESC, o, reason) AS reasons FROM c GROUP BY individual""")
def top_reasons(spark, sf):
    return genotype.top_reasons(t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("individual"), F.col("l_returnflag").alias("reason"), F.col("l_linenumber").alias("ord")))


@query("""WITH c AS (SELECT l_orderkey AS individual, l_returnflag AS reason, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY n DESC, reason DESC) AS pl, lead(n) OVER (PARTITION BY individual ORDER BY n DESC, reason DESC) AS second FROM c) SELECT individual, CASE WHEN coalesce(second >= 0.5 * n, false) THEN 'mixed' ELSE reason END AS dominant FROM r WHERE pl = 1""")
def dominant_reasons(spark, sf):
    c = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("individual"), F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"))
    text = c.groupBy("individual").agg(F.array_join(F.collect_list(F.concat("reason", F.lit("("), F.col("n").cast("string"), F.lit(")"))), ";").alias("text"))
    return text.select("individual", labels.dominant_reason("text").alias("dominant"))


@query(cte("facts") + """, s AS (SELECT individual, list(DISTINCT allele) AS a FROM facts GROUP BY 1) SELECT o.o_orderkey AS mother, o.o_orderkey + 1 AS father, CASE WHEN x.a IS NOT NULL AND y.a IS NOT NULL THEN len(list_intersect(x.a, y.a))::INTEGER END AS shared FROM orders o LEFT JOIN s x ON x.individual = o.o_orderkey LEFT JOIN s y ON y.individual = o.o_orderkey + 1""")
def cross_shared_alleles(spark, sf):
    s = t.facts(spark, sf).groupBy("individual").agg(F.collect_set("allele").alias("alleles"))
    c = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("mother"), (F.col("o_orderkey") + 1).alias("father"))
    return breeding.shared_alleles(c, s).select("mother", "father", "shared")


@query("""WITH s AS (SELECT n_name || '; ' || r_name || ' ,' || n_name || 'x' AS sites, n_nationkey + 1.0::DOUBLE AS area FROM nation JOIN region ON n_regionkey = r_regionkey), e AS (SELECT trim(unnest(regexp_split_to_array(sites, '[;,]'))) AS site, area / 3 AS area FROM s) SELECT site, round(sum(area), 9) AS area FROM e GROUP BY site""")
def split_areas(spark, sf):
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = n.select(F.concat("n_name", F.lit("; "), "r_name", F.lit(" ,"), "n_name", F.lit("x")).alias("sites"), (F.col("n_nationkey") + 1.0).alias("area"))
    return breeding.split_area(s).select("site", F.round("area", 9).alias("area"))


@query("""WITH s AS (SELECT o_orderkey AS individual, CASE WHEN o_orderstatus = 'F' THEN 'Insufficient_data' ELSE 'SI' END AS status, o_orderpriority AS site FROM orders), r AS (SELECT o_orderkey AS individual, 'Repeat' AS action, o_orderpriority AS site FROM orders WHERE o_totalprice > 150000)
SELECT individual, action, site FROM r UNION ALL SELECT individual, 'Re-sequence at higher depth', site FROM s WHERE status = 'Insufficient_data' AND individual NOT IN (SELECT individual FROM r)""")
def redo_list(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("individual"), F.when(F.col("o_orderstatus") == "F", "Insufficient_data").otherwise("SI").alias("status"), F.col("o_orderpriority").alias("site"), "o_totalprice")
    redo = o.where("o_totalprice > 150000").select("individual", F.lit("Repeat").alias("action"), "site")
    return quality.redo_list(redo, o.drop("o_totalprice")).select("individual", "action", "site")


@query("""SELECT c_custkey, c_mktsegment, n_first FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS n_first FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def first_match(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("k"))
    return quality.first_match(c, t.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("n_first")), "k", "n_first").drop("k")


@query(_DEPTH + "SELECT contig, min(CASE WHEN value > 80 THEN pos END)::INTEGER AS time FROM d GROUP BY contig")
def first_passage(spark, sf):
    return profiles.first_passage(_depth(spark, sf), ["contig"], "pos", F.col("value") > 80)


@query(_DEPTH + ", f AS (SELECT contig % 5 AS bag, coalesce(min(CASE WHEN value > 95 THEN pos END), 1001)::DOUBLE AS x FROM d GROUP BY contig) SELECT bag, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, count(*) AS n FROM f GROUP BY bag")
def passage_quantiles(spark, sf):
    f = profiles.first_passage(_depth(spark, sf), ["contig"], "pos", F.col("value") > 95).withColumn("bag", F.col("contig") % 5)
    return profiles.passage_quantiles(f, ["bag"], 1000).select("bag", *r6("q25", "median", "q75"), "n")


@query("SELECT user_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS pl, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pl = floor(0.975 * n)")
def indexed_percentile(spark, sf):
    return profiles.indexed_percentile(t.table(spark, sf, "events").select("user_id", "value"), "user_id", "value", 0.975)


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS pl FROM customer) WHERE pl <= 3")
def first_of_group(spark, sf):
    return profiles.first_of_group(t.table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey")


@query(cte("facts", "members") + ", s AS (SELECT DISTINCT site, protein || '-' || (individual % 60) AS allele FROM facts JOIN members USING (individual)), p AS (SELECT allele, min(site) AS site FROM s GROUP BY allele HAVING count(*) = 1) SELECT site, count(*) AS private FROM p GROUP BY site")
def private_alleles(spark, sf):
    """Parts with a number of the order, so that some stand at one site only."""
    f = t.facts(spark, sf).join(t.members(spark, sf), "individual")
    return sets.private_alleles(f.select("site", F.concat_ws("-", F.col("protein").cast("string"), (F.col("individual") % 60).cast("string")).alias("allele")).distinct(), "site")


@query(cte("facts") + """, c AS (SELECT DISTINCT individual AS mother, individual + 1 AS father, allele FROM facts), e AS (SELECT individual, allele FROM facts JOIN orders ON o_orderkey = individual WHERE o_orderstatus = 'P' GROUP BY ALL), h AS (SELECT mother, father, e.individual, c.allele FROM c JOIN e ON e.allele = c.allele AND (e.individual = mother OR e.individual = father))
SELECT individual, count(DISTINCT mother) AS crosses, string_agg(DISTINCT allele, ', ' ORDER BY allele) AS alleles FROM h GROUP BY individual""")
def excluded_parents(spark, sf):
    """Crosses of consecutive orders; the excluded are looked for among the two parents."""
    f = t.facts(spark, sf)
    a = f.groupBy("individual").agg(F.collect_set("allele").alias("alleles"))
    p = t.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("individual"))
    ex = a.join(p, "individual", "left_semi")
    c = a.select(F.col("individual").alias("mother"), (F.col("individual") + 1).alias("father"), "alleles").withColumn("cross", F.col("mother"))
    near = c.withColumn("parent", F.explode(F.array("mother", "father"))).join(ex.select(F.col("individual").alias("parent"), F.col("alleles").alias("own")), "parent").select("cross", "mother", "father", "parent", F.explode(F.array_intersect("alleles", "own")).alias("allele"))
    return near.groupBy(F.col("parent").alias("individual")).agg(F.count_distinct("cross").alias("crosses"), F.array_join(F.array_sort(F.collect_set("allele")), ", ").alias("alleles"))


@query(_CELLS + """, k AS (SELECT pos, item_id % 3 AS g, aa, count(*) AS n FROM cells WHERE aa <> '-' GROUP BY ALL), d AS (SELECT pos, g, aa FROM k QUALIFY row_number() OVER (PARTITION BY pos, g ORDER BY n DESC, aa) = 1), v AS (SELECT pos, aa, count(*) AS n, sum(count(*)) OVER (PARTITION BY pos) AS groups FROM d WHERE g <> 2 GROUP BY pos, aa), cc AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, aa) = 1)
SELECT cc.pos, cc.aa AS consensus, cc.n AS concordant, cc.groups::BIGINT AS groups, d.aa = cc.aa AS match_2 FROM cc LEFT JOIN d ON d.pos = cc.pos AND d.g = 2""")
def residue_concordance(spark, sf):
    cells = _cells(spark, sf).withColumn("g", (F.col("id") % 3).cast("string"))
    return quality.concordance(cells, "g", ["2"])


@query(_CELLS + ", k AS (SELECT pos, aa, count(*) AS n FROM cells WHERE aa <> '-' GROUP BY ALL) SELECT pos, string_agg(aa || ':' || n, ';' ORDER BY aa) AS composition FROM k GROUP BY pos")
def residue_composition(spark, sf):
    return profiles.composition(_cells(spark, sf))


@query("""WITH d AS (SELECT doc_id, regexp_replace(translate(lower(text), 'etaoinsrhld', 'ACGTACGTACG'), '[^ACGT]', '', 'g') AS dna FROM documents), i AS (SELECT doc_id, dna, list_transform(range(0, length(dna) // 3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (16 * (instr('TCAG', substr(dna, (3 * i + 1)::BIGINT, 1)) - 1) + 4 * (instr('TCAG', substr(dna, (3 * i + 2)::BIGINT, 1)) - 1) + instr('TCAG', substr(dna, (3 * i + 3)::BIGINT, 1)))::BIGINT, 1)) AS aa FROM d)
SELECT doc_id, md5(array_to_string(aa, '')) AS protein, md5(reverse(translate(dna, 'ACGT', 'TGCA'))) AS other_strand FROM i""")
def translated_texts(spark, sf):
    dna = F.regexp_replace(F.translate(F.lower("text"), "etaoinsrhld", "ACGTACGTACG"), "[^ACGT]", "")
    d = t.table(spark, sf, "documents").select("doc_id", dna.alias("dna"))
    return d.select("doc_id", F.md5(sequence.translate("dna")).alias("protein"), F.md5(sequence.reverse_complement("dna")).alias("other_strand"))


@query(cte("facts", "copies", "members", "own", "totals") + "SELECT lineage, ceil(20.0 * count(*) * 0.9 / (count(*) - count(*) * 0.9))::BIGINT AS needed FROM totals GROUP BY lineage")
def samples_to_target(spark, sf):
    d = diversity.diversity(diversity.allele_totals(t.copies(spark, sf).join(t.members(spark, sf), "individual"), "lineage"), "lineage")
    return d.select("lineage", diversity.samples_to(F.col("richness").cast("decimal(12,2)"), F.lit(20).cast("decimal(4,1)"), F.col("richness") * F.lit("0.9").cast("decimal(2,1)")).cast("bigint").alias("needed"))


@query("SELECT s_nationkey, round(count(*) / sum(1 / s_acctbal), 4) AS harmonic_mean FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def harmonic_means(spark, sf):
    return diversity.harmonic_mean(t.table(spark, sf, "supplier"), "s_nationkey", "s_acctbal").select("s_nationkey", F.round("harmonic_mean", 4).alias("harmonic_mean"))


@query("SELECT p_partkey, 'A' || dense_rank() OVER (ORDER BY p_brand) AS dense_id FROM part")
def dense_ids(spark, sf):
    return genotype.dense_ids(t.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "dense_id")


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS individual, l_returnflag AS contig, l_linenumber AS haplotype FROM lineitem) SELECT individual, contig, array_to_string(list_transform(range(1, count(*) + 1), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', i::BIGINT, 1)), '') AS genotype FROM f GROUP BY ALL""")
def haplotype_letters(spark, sf):
    return genotype.haplotype_sets(t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("individual"), F.col("l_returnflag").alias("contig"), F.col("l_linenumber").alias("haplotype")))


@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 31)::VARCHAR || CASE WHEN o_orderkey % 31 = 27 THEN CASE WHEN o_custkey % 2 = 0 THEN 'pv' ELSE 'rt' END ELSE '' END AS pop FROM orders) SELECT o_orderkey, CASE WHEN pop IN ('27pv', '27rt') THEN '27' ELSE pop END AS pooled, 'EO' || lpad(regexp_extract(pop, '^([0-9]+)', 1), 2, '0') AS naive FROM r""")
def pooled_codes(spark, sf):
    k = F.col("o_orderkey") % 31
    pop = F.concat(k.cast("string"), F.when(k == 27, F.when(F.col("o_custkey") % 2 == 0, "pv").otherwise("rt")).otherwise(""))
    o = t.table(spark, sf, "orders").select("o_orderkey", pop.alias("pop"))
    return o.select("o_orderkey", labels.pooled("pop").alias("pooled"), labels.naive_site("pop").alias("naive"))


@query("""SELECT source, count(*) AS n, round(median(n_chars), 6) AS median, count(*) FILTER (n_chars < 500) AS below, count(*) FILTER (n_chars BETWEEN 500 AND 5000) AS within, count(*) FILTER (n_chars > 5000) AS above FROM documents GROUP BY source""")
def length_summary(spark, sf):
    return profiles.length_summary(t.table(spark, sf, "documents").select("source", "n_chars"), "source", "n_chars", 500, 5000).select("source", "n", *r6("median"), "below", "within", "above")


@query(cte("hap", "st") + """SELECT individual, CASE WHEN status = 'SI' THEN 'SI_canonical' WHEN status = 'pSI' AND removed::DOUBLE / total < 0.25 THEN 'SI_promoted_from_pSI_low' WHEN status = 'pSI' AND copies > 0 THEN 'pSI_null_introduced' WHEN status = 'SC' THEN 'SC_all_null_from_genotype_table' WHEN status = 'Insufficient_data' THEN 'Insufficient_kept_existing' ELSE 'No_SI_status' END AS flag, CASE WHEN ok = 0 THEN 'Complete_loss' WHEN ok / nullif(total, 0)::DOUBLE < 0.5 THEN 'Partial_translation_failure' ELSE 'Functional' END AS loss FROM st""")
def copy_flags(spark, sf):
    s = genotype.haplotype_status(t.logs(spark, sf))
    return s.select("individual", labels.target_copies("status", "confidence", "copies")["flag"].alias("flag"), labels.loss_status("ok", F.when(F.col("total") > 0, F.col("ok") / F.col("total"))).alias("loss"))


@query("""SELECT o_orderkey, CASE WHEN a <> b THEN 'Compatible_cross' WHEN d = 0 THEN 'Incompatible' WHEN d < 0.04 THEN 'Synonymy_test' ELSE 'Compatible_within' END AS category, CASE WHEN a = b THEN 'within-BL' ELSE 'between-BL' END AS pairing, CASE WHEN k >= 2 THEN 'full' WHEN k = 1 THEN 'singleton' ELSE 'none' END AS power FROM (SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS b, (o_orderkey % 10) / 100.0 AS d, o_custkey % 4 AS k FROM orders)""")
def cross_categories(spark, sf):
    o = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O").alias("b"), ((F.col("o_orderkey") % 10) / 100).alias("d"), (F.col("o_custkey") % 4).alias("k"))
    return o.select("o_orderkey", labels.cross_category("a", "b", "d").alias("category"), labels.pairing("a", "b").alias("pairing"), labels.cross_power("k").alias("power"))


@query(cte("facts", "copies", "geno", "members") + "SELECT allele, count(*) AS carriers, count(DISTINCT lineage) AS lineages FROM (SELECT individual, min(allele) AS allele FROM copies JOIN geno USING (individual) WHERE genotype = 'AAAA' GROUP BY 1) JOIN members USING (individual) GROUP BY allele")
def homozygous_carriers(spark, sf):
    return _aaaa(spark, sf).groupBy("allele").agg(F.count("*").alias("carriers"), F.count_distinct("lineage").alias("lineages"))


@query("""WITH g AS (SELECT o_orderkey AS id, o_custkey, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 40) AS ok, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 44) AS rm, count(l_orderkey) FILTER (o_orderkey % 5 = 0) AS ch, o_custkey % 13 AS a, o_orderkey % 3 AS b, o_custkey % 2 AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
x AS (SELECT *, ok + rm AS clean, CASE WHEN ok + rm >= 4 THEN 'SI' WHEN id % 11 = 0 THEN NULL ELSE 'Insufficient_data' END AS st, CASE id % 9 WHEN 0 THEN 'Re-PCR' WHEN 1 THEN 'Re-DNA-extraction' END AS act, CASE WHEN a < 9 THEN a % 3 * 5 END AS contigs, CASE WHEN a < 9 THEN least(a % 3 * 5, b * 3) END AS uniq, CASE WHEN a = 2 THEN 85.5::DOUBLE END AS dropped, CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS within_, CASE WHEN id % 4 IN (1, 3) THEN 2 ELSE 0 END AS below, CASE WHEN id % 4 IN (2, 3) THEN 2 ELSE 0 END AS above, CASE WHEN a <> 12 THEN o_custkey * 200 END AS reads, 8 + id % 7 AS q, 700 + o_custkey % 200 AS n50, 40 + id % 20 AS lg FROM g)
SELECT id, CASE WHEN st = 'SI' THEN 'none — SI call achieved' WHEN st IS NULL THEN 'not_in_SI_status_table' WHEN act = 'Re-DNA-extraction' THEN 'DNA_contamination' WHEN act = 'Re-PCR' THEN 'PCR_amplicon_failure' WHEN ch >= 2 * greatest(clean, 1) AND ch >= 4 THEN 'chimera_dominated' WHEN clean BETWEEN 1 AND 3 THEN 'partial_recovery' WHEN dropped >= 80 AND uniq > 0 THEN 'pipeline_chimera_filter_too_aggressive' WHEN contigs > 0 THEN CASE WHEN uniq = 0 THEN 'pipeline_dedup_collapsed_all_contigs' WHEN within_ = 0 AND below > 0 AND above = 0 THEN 'pipeline_step4_length_filter_too_short' WHEN within_ = 0 AND above > 0 AND below = 0 THEN 'pipeline_step4_length_filter_too_long' WHEN within_ = 0 THEN 'pipeline_step4_length_filter_mixed' ELSE 'pipeline_downstream_filter' END
WHEN contigs = 0 THEN CASE WHEN reads < 10000 THEN 'coverage_limited' WHEN q < 10 THEN 'canu_assembly_failure_low_quality' WHEN n50 < 800 THEN 'canu_assembly_failure_fragmented' WHEN lg < 50 THEN 'canu_assembly_failure_no_long_reads' ELSE 'canu_assembly_failure' END WHEN reads < 10000 THEN 'coverage_limited' ELSE 'unresolved' END AS mode FROM x""")
def failure_modes(spark, sf):
    o, li = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    id_, cust = F.col("o_orderkey"), F.col("o_custkey")
    g = o.join(li, F.col("l_orderkey") == id_, "left").groupBy("o_orderkey", "o_custkey").agg(F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40)).alias("ok"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 44)).alias("rm"), F.count("l_orderkey").alias("all"))
    a, b = cust % 13, id_ % 3
    two = lambda *k: F.when((id_ % 4).isin(*k), 2).otherwise(0)
    m = labels.failure_mode(
        F.when(F.col("ok") + F.col("rm") >= 4, "SI").when(id_ % 11 == 0, None).otherwise("Insufficient_data"), F.when(id_ % 9 == 0, "Re-PCR").when(id_ % 9 == 1, "Re-DNA-extraction"), "ok", "rm", F.when(id_ % 5 == 0, F.col("all")).otherwise(0),
        dropped=F.when(a == 2, 85.5), unique=F.when(a < 9, F.least(a % 3 * 5, b * 3)), contigs=F.when(a < 9, a % 3 * 5), within=two(0), below=two(1, 3), above=two(2, 3), median=F.lit(2100), reads=F.when(a != 12, cust * 200), quality=8 + id_ % 7, n50=700 + cust % 200, long_reads=40 + id_ % 20,
    )
    return g.select(id_.alias("id"), m["mode"].alias("mode"))


@query()
def fitted_asymptotes(spark, sf):
    from polyloom.plans.registry import _carriers

    return diversity.fitted_asymptotes(diversity.accumulation_curve(_carriers(spark, sf), "site"), "site")


@query()
def variable_columns(spark, sf):
    return profiles.variable_columns(_cells(spark, sf), most_gaps=1.0, top=25)


@query(cte("facts", "copies", "members", "hap", "st") + """, nu AS (SELECT individual, lineage, 'NULL' AS allele, 4 AS n FROM st JOIN members USING (individual) WHERE status = 'SC'), u AS (SELECT individual, lineage, allele, n FROM copies JOIN members USING (individual) WHERE individual NOT IN (SELECT individual FROM nu) UNION ALL SELECT * FROM nu),
e AS (SELECT lineage, individual, count(*) FILTER (allele <> 'NULL') AS k, coalesce(sum(n) FILTER (allele = 'NULL'), 0) AS nulls, sum(n) AS whole FROM u GROUP BY ALL), d AS (SELECT lineage, 1 / sum(p * p) AS effective FROM (SELECT lineage, sum(n) / sum(sum(n)) OVER (PARTITION BY lineage)::DOUBLE AS p FROM u GROUP BY lineage, allele) GROUP BY lineage),
s AS (SELECT lineage, count(*) FILTER (status = 'SI') AS n_si, count(*) FILTER (status = 'pSI') AS n_psi, count(*) FILTER (status = 'SC') AS n_sc FROM st JOIN members USING (individual) GROUP BY lineage)
SELECT lineage, n, round(mean_null, 6) AS mean_null, round(share_null, 6) AS share_null, round(share_het, 6) AS share_het, n_si, n_psi, n_sc, round(effective, 6) AS effective FROM (SELECT lineage, count(*) AS n, avg(nulls) AS mean_null, sum(nulls) / sum(whole)::DOUBLE AS share_null, count(*) FILTER (k > 1) / count(*) FILTER (k > 0)::DOUBLE AS share_het FROM e GROUP BY lineage) JOIN s USING (lineage) JOIN d USING (lineage)""")
def null_aware_summary(spark, sf):
    s = genotype.haplotype_status(t.logs(spark, sf)).join(t.members(spark, sf), "individual")
    c = t.copies(spark, sf).join(t.members(spark, sf), "individual").select("individual", "lineage", "allele", "n")
    nulls = s.where("status = 'SC'").select("individual", "lineage", F.lit("NULL").alias("allele"), F.lit(4).cast("bigint").alias("n"))
    x = diversity.null_aware_summary(c.join(nulls, "individual", "left_anti").unionByName(nulls), s, "lineage")
    return x.select("lineage", "n", *r6("mean_null", "share_null", "share_het"), "n_si", "n_psi", "n_sc", *r6("effective"))
