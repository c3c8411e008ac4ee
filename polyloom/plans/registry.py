"""All queries by name, and the SQL that each must equal. One query for each operator or family of operators, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.functions import labels, sequence, statistics
from polyloom.operators import breeding, clusters, diversity, genotype, profiles, quality, sets, simulation
from polyloom.plans import tables as t
from polyloom.plans.tables import cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "tp2_status_by_group"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- genotypes ---


@query(cte("facts", "copies", "geno", "score", "members") + """
SELECT lineage, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS sd_score, round(stddev_samp(score) / sqrt(count(*)), 6) AS se_score,
  count(*) FILTER (genotype = 'AAAA') AS n_aaaa, count(*) FILTER (genotype = 'AAAB') AS n_aaab, count(*) FILTER (genotype = 'AABB') AS n_aabb, count(*) FILTER (genotype = 'AABC') AS n_aabc, count(*) FILTER (genotype = 'ABCD') AS n_abcd,
  round(count(*) FILTER (genotype = 'AAAA') / count(*), 6) AS share_aaaa,
  CASE WHEN round(avg(score), 3) < 0.667 AND round(count(*) FILTER (genotype = 'AAAA') / count(*), 3) > 0.3 THEN 'CRITICAL' WHEN round(avg(score), 3) < 0.667 OR round(count(*) FILTER (genotype = 'AAAA') / count(*), 3) > 0.3 THEN 'AT RISK' ELSE 'OK' END AS status
FROM score JOIN members USING (individual) GROUP BY lineage""")
def tp2_status_by_group(spark, sf):
    g = t.genotyped(spark, sf).select("individual", "genotype", labels.class_score("genotype").alias("score")).join(t.members(spark, sf), "individual")
    out = diversity.score_summary(g, "lineage")
    return out.select("lineage", "n", *r6("mean_score", "sd_score", "se_score"), *[F.col(f"n_{c}").alias(f"n_{c.lower()}") for c in ("AAAA", "AAAB", "AABB", "AABC", "ABCD")], F.round("share_AAAA", 6).alias("share_aaaa"), "status")


@query(cte("facts", "copies") + "SELECT individual, allele, n FROM copies")
def copy_counts(spark, sf):
    return t.copies(spark, sf)


@query(cte("facts", "copies", "geno") + """, comp AS (SELECT individual, string_agg(allele || '(' || n || ')', '+' ORDER BY allele) AS composition, sum(n)::BIGINT AS n_proteins FROM copies GROUP BY 1)
SELECT individual, k::INTEGER AS n_alleles, n_proteins, genotype, CASE WHEN k = 1 THEN 'Homozygous' ELSE 'Heterozygous' END AS zygosity, composition FROM geno JOIN comp USING (individual)""")
def genotype_classes(spark, sf):
    return t.genotyped(spark, sf)


@query(cte("facts", "copies") + "SELECT individual, allele, n::INTEGER AS n FROM copies")
def composition_round_trip(spark, sf):
    return genotype.parsed_composition(t.genotyped(spark, sf))


@query(cte("facts", "copies") + """, r AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY n DESC, allele) AS pl, count(*) OVER (PARTITION BY individual) AS k, max(n) OVER (PARTITION BY individual) AS top FROM copies),
s AS (SELECT *, max(CASE WHEN pl = 2 THEN n END) OVER (PARTITION BY individual) AS second FROM r)
SELECT individual, allele, CAST(CASE k WHEN 1 THEN 4 WHEN 2 THEN CASE WHEN top >= 2 * second THEN CASE WHEN pl = 1 THEN 3 ELSE 1 END ELSE 2 END WHEN 3 THEN CASE WHEN pl = 1 THEN 2 ELSE 1 END ELSE 1 END AS INTEGER) AS n FROM s WHERE pl <= 4""")
def inferred_four_copies(spark, sf):
    return genotype.four_copies(t.copies(spark, sf))


@query(cte("facts") + "SELECT * FROM facts WHERE individual NOT IN (SELECT individual FROM facts GROUP BY 1 HAVING count(DISTINCT allele) > 4)")
def overloaded_individuals_removed(spark, sf):
    return genotype.without_overloaded(t.facts(spark, sf), 4, "individual", "allele").select("individual", "protein", "allele")


@query("""SELECT text_md5, n, first, row_number() OVER (ORDER BY first) AS number FROM (SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) >= 2)""")
def named_duplicates(spark, sf):
    out = genotype.named_proteins(t.table(spark, sf, "documents").select(F.col("text").alias("seq"), F.col("doc_id").alias("ord")), least=2)
    return out.select(F.md5("seq").alias("text_md5"), "n", "first", "number")


@query(cte("facts", "copies") + """
SELECT individual, sum(CASE WHEN allele = 'Brand#11' THEN n ELSE 0 END)::BIGINT AS b11, sum(CASE WHEN allele = 'Brand#12' THEN n ELSE 0 END)::BIGINT AS b12 FROM copies GROUP BY individual""")
def wide_matrix(spark, sf):
    return genotype.wide(t.copies(spark, sf), ["Brand#11", "Brand#12"]).select("individual", F.col("`Brand#11`").alias("b11"), F.col("`Brand#12`").alias("b12"))


# --- status of copies ---


@query(cte("hap", "st") + """SELECT individual, ok, removed, chimeric, total, round(removed::DOUBLE / nullif(total, 0), 6) AS share, status, CASE WHEN status = 'pSI' THEN CASE WHEN removed::DOUBLE / total >= 0.25 THEN 'high' ELSE 'low' END END AS confidence, copies FROM st""")
def si_status(spark, sf):
    out = genotype.haplotype_status(t.logs(spark, sf).withColumn("state", F.col("state")))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("share"))).select("individual", "ok", "removed", "chimeric", "total", *r6("share"), "status", "confidence", "copies")


@query(cte("facts", "copies", "hap", "st") + """, tg AS (SELECT individual, CASE WHEN status = 'SC' THEN 0 WHEN status = 'pSI' AND removed::DOUBLE / total >= 0.25 THEN 4 - copies ELSE 4 END AS target FROM st),
q AS (SELECT individual, allele, n * target / sum(n) OVER (PARTITION BY individual)::DOUBLE AS quota, target FROM copies JOIN tg USING (individual) WHERE target > 0),
l AS (SELECT *, floor(quota) AS low, target - sum(floor(quota)) OVER (PARTITION BY individual) AS rest, row_number() OVER (PARTITION BY individual ORDER BY round(quota - floor(quota), 9) DESC, allele) AS pl FROM q)
SELECT individual, allele, CAST(low + CASE WHEN pl <= rest THEN 1 ELSE 0 END AS INTEGER) AS n FROM l WHERE low + CASE WHEN pl <= rest THEN 1 ELSE 0 END > 0""")
def apportioned_copies(spark, sf):
    s = genotype.haplotype_status(t.logs(spark, sf)).withColumn("t", labels.target_copies("status", "confidence", "copies"))
    return genotype.apportioned(t.copies(spark, sf).join(s.select("individual", F.col("t.functional").alias("target")).where("target > 0"), "individual"))


@query(cte("facts", "copies", "hap", "st") + """, tg AS (SELECT c.individual, status, CASE WHEN status = 'SC' THEN 0 WHEN status = 'pSI' AND removed::DOUBLE / total >= 0.25 AND st.copies > 0 THEN 4 - st.copies ELSE 4 END AS target, CASE status WHEN 'SI' THEN 'SI_canonical' WHEN 'SC' THEN 'SC_all_null_from_genotype_table' WHEN 'Insufficient_data' THEN 'Insufficient_kept_existing' WHEN 'pSI' THEN CASE WHEN removed::DOUBLE / total < 0.25 THEN 'SI_promoted_from_pSI_low' WHEN st.copies > 0 THEN 'pSI_null_introduced' ELSE 'No_SI_status' END ELSE 'No_SI_status' END AS flag FROM (SELECT DISTINCT individual FROM copies) c LEFT JOIN st USING (individual)),
q AS (SELECT individual, allele, n * target / sum(n) OVER (PARTITION BY individual)::DOUBLE AS quota, target FROM copies JOIN tg USING (individual) WHERE target > 0),
l AS (SELECT *, floor(quota) AS low, target - sum(floor(quota)) OVER (PARTITION BY individual) AS rest, row_number() OVER (PARTITION BY individual ORDER BY round(quota - floor(quota), 9) DESC, allele) AS pl FROM q),
k AS (SELECT individual, allele, CAST(low + CASE WHEN pl <= rest THEN 1 ELSE 0 END AS INTEGER) AS n FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY n DESC, allele) AS pos FROM k WHERE n > 0),
g AS (SELECT individual, string_agg(allele || '(' || n || ')', '+' ORDER BY allele) AS c, string_agg(repeat(substr('ABCDEFGH', pos, 1), n), '' ORDER BY pos) AS lab FROM r GROUP BY individual)
SELECT individual, status, target AS functional, 4 - target AS null_copies, flag, concat_ws('+', c, CASE WHEN target < 4 THEN 'Allele_NULL(' || (4 - target) || ')' END) AS composition, coalesce(lab, '') || repeat('0', 4 - target) AS label FROM tg LEFT JOIN g USING (individual)
UNION ALL SELECT individual, status, 0, 4, 'SC_added_from_SI_status', 'Allele_NULL(4)', '0000' FROM st WHERE status = 'SC' AND individual NOT IN (SELECT individual FROM copies)""")
def null_aware_genotypes(spark, sf):
    return genotype.null_aware(t.copies(spark, sf), genotype.haplotype_status(t.logs(spark, sf)))


@query(cte("hap", "st", "members") + """SELECT site, lineage, count(*) FILTER (status = 'SI') AS n_si, count(*) FILTER (status = 'pSI') AS n_psi, count(*) FILTER (status = 'SC') AS n_sc, count(*) AS n FROM st JOIN members USING (individual) GROUP BY site, lineage""")
def status_by_site(spark, sf):
    s = genotype.haplotype_status(t.logs(spark, sf)).join(t.members(spark, sf), "individual")
    return s.groupBy("site", "lineage").agg(*[F.count_if(F.col("status") == x).alias("n_" + x.lower()) for x in ("SI", "pSI", "SC")], F.count("*").alias("n"))


@query(cte("hap", "st") + "SELECT individual, CASE WHEN total = 0 THEN 'high' WHEN total < 2 THEN 'medium' ELSE 'low' END AS priority FROM st WHERE status = 'Insufficient_data'")
def redo_priorities(spark, sf):
    return genotype.haplotype_status(t.logs(spark, sf)).where("status = 'Insufficient_data'").select("individual", labels.redo_priority("total").alias("priority"))


# --- diversity ---


@query(cte("facts", "copies", "members", "own", "totals") + "SELECT lineage, count(*) AS richness, round(1 / sum(p * p), 6) AS effective, round(-sum(p * ln(p)), 6) AS shannon, round(-sum(p * ln(p)) / ln(count(*)), 6) AS evenness FROM totals GROUP BY lineage")
def allele_diversity(spark, sf):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual")
    return diversity.diversity(diversity.allele_totals(own, "lineage"), "lineage").select("lineage", "richness", *r6("effective", "shannon", "evenness"))


@query(cte("facts", "copies", "members", "own") + """, tot AS (SELECT site, allele, sum(n)::BIGINT AS n FROM own GROUP BY ALL), d AS (SELECT site, count(*) AS richness, round(sum(n)::DOUBLE * sum(n) / sum(n * n), 6) AS effective FROM tot GROUP BY site),
e AS (SELECT site, count(*) AS n_with, round(avg((k > 1)::INTEGER), 6) AS share_het, round(avg(k), 6) AS mean_alleles FROM (SELECT site, individual, count(*) AS k FROM own GROUP BY ALL) GROUP BY site),
b AS (SELECT site, string_agg(allele || '(' || n || ')', '; ' ORDER BY n DESC, allele) AS top_alleles FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS pl FROM tot) WHERE pl <= 3 GROUP BY site)
SELECT site, (SELECT count(*) FROM members m WHERE m.site = d.site) AS n, n_with, richness, effective, share_het, mean_alleles, top_alleles FROM d JOIN e USING (site) JOIN b USING (site)""")
def population_summary(spark, sf):
    m = t.members(spark, sf).select("individual", "site")
    return diversity.population_summary(t.copies(spark, sf), m, "site").select("site", "n", "n_with", "richness", *r6("effective", "share_het", "mean_alleles"), "top_alleles")


@query(cte("facts", "copies", "members", "own", "totals") + "SELECT lineage, round(sum(n * n) * count(*) / sum(n) - sum(n), 4) AS x2, count(*) - 1 AS df FROM totals GROUP BY lineage")
def uniform_chi2(spark, sf):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual")
    return diversity.uniform_chi2(diversity.allele_totals(own, "lineage"), "lineage").select("lineage", F.round("x2", 4).alias("x2"), "df")


@query()
def uniform_chi2_p(spark, sf):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual")
    x = diversity.uniform_chi2(diversity.allele_totals(own, "site"), "site")
    return x.withColumn("p", statistics.chi2_p_value("x2", F.col("df").cast("double")))


@query(cte("facts", "copies", "members", "own", "totals") + """, p AS (SELECT a.lineage, sum(a.p * b.p * pow(greatest(0, 1 - a.p - CASE WHEN a.allele <> b.allele THEN b.p ELSE 0 END), 4)) AS c FROM totals a JOIN totals b ON a.lineage = b.lineage GROUP BY 1)
SELECT lineage, leakage::DOUBLE AS leakage, round(c, 6) AS compatibility, round(c + leakage * (1 - c), 6) AS leaky FROM p, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) v(leakage)""")
def compatibility_ladder(spark, sf):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual")
    c = diversity.leakage_ladder(diversity.compatibility(diversity.allele_totals(own, "lineage"), "lineage"))
    return c.select("lineage", "leakage", *r6("compatibility", "leaky"))


@query(cte("facts", "copies", "members", "own") + """, tot AS (SELECT site, individual % 50 AS bag, allele, sum(n)::BIGINT AS n FROM own GROUP BY ALL), f AS (SELECT site || ':' || bag AS pool, count(*) AS s, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2 FROM tot GROUP BY 1)
SELECT pool, s, f1, f2, round(CASE WHEN f2 > 0 THEN s + f1 * f1 / (2.0::DOUBLE * f2) WHEN f1 > 0 THEN s + f1 * (f1 - 1) / 2.0::DOUBLE ELSE s END, 6) AS chao1 FROM f""")
def chao1_richness(spark, sf):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual").withColumn("pool", F.concat_ws(":", "site", (F.col("individual") % 50).cast("string")))
    return diversity.chao1(diversity.allele_totals(own, "pool"), "pool").select("pool", "s", "f1", "f2", *r6("chao1"))


def _carriers(spark, sf, group="site"):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual")
    n = own.groupBy(group).agg(F.count_distinct("individual").alias("people"))
    return own.groupBy(group, "allele").agg(F.count_distinct("individual").alias("carriers")).join(n, group)


@query(cte("facts", "copies", "members", "own") + """, nn AS (SELECT site, count(DISTINCT individual) AS big FROM own GROUP BY 1), m AS (SELECT site, allele, count(DISTINCT individual) AS m, any_value(big) AS big FROM own JOIN nn USING (site) GROUP BY site, allele),
e AS (SELECT site, allele, big, CASE WHEN big <= 30 THEN 0 WHEN min(big - m - i) <= 0 THEN 0 ELSE exp(sum(CASE WHEN big - m - i > 0 THEN ln((big - m - i)::DOUBLE / (big - i)) ELSE 0 END)) END AS miss FROM m, (SELECT unnest(range(0, 30)) AS i) GROUP BY site, allele, big)
SELECT site, round(sum(1 - miss), 5) AS rarefied FROM e GROUP BY site""")
def rarefied_richness(spark, sf):
    return diversity.rarefied_richness(_carriers(spark, sf), "site", 30).select("site", F.round("rarefied", 5).alias("rarefied"))


@query()
def accumulation_slopes(spark, sf):
    return diversity.accumulation_slopes(diversity.accumulation_curve(_carriers(spark, sf), "site"), "site")


@query(cte("facts", "copies", "geno", "score", "members") + """, lv AS (SELECT unnest(['AAAA', 'AAAB', 'AABB', 'AABC', 'ABCD']) AS genotype), g AS (SELECT lineage, genotype, count(*) AS n, count(*) FILTER (score > 0) AS supporting FROM score JOIN members USING (individual) GROUP BY ALL), x AS (SELECT DISTINCT lineage FROM g)
SELECT lineage, genotype, coalesce(n, 0) AS n, coalesce(supporting, 0) AS supporting, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY lineage), 6) AS share_of_group, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share_of_all FROM x CROSS JOIN lv LEFT JOIN g USING (lineage, genotype)""")
def reproductive_support(spark, sf):
    g = t.genotyped(spark, sf).select("individual", "genotype", labels.class_score("genotype").alias("score")).join(t.members(spark, sf), "individual")
    return diversity.reproductive_support(g, "lineage").select("lineage", "genotype", "n", "supporting", *r6("share_of_group", "share_of_all"))


@query(cte("facts", "copies", "members", "own") + "SELECT allele, count(DISTINCT site) AS n_groups FROM own GROUP BY allele HAVING count(DISTINCT site) >= (SELECT ceil(0.8 * count(DISTINCT site)) FROM own)")
def pan_group_alleles(spark, sf):
    return diversity.pan_group_alleles(t.copies(spark, sf).join(t.members(spark, sf), "individual"), "site")


@query(cte("facts", "copies") + """, r AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY n DESC, allele) AS pl, count(*) OVER (PARTITION BY individual) AS k, max(n) OVER (PARTITION BY individual) AS top FROM copies), s AS (SELECT *, max(CASE WHEN pl = 2 THEN n END) OVER (PARTITION BY individual) AS second FROM r),
f AS (SELECT individual, CASE k WHEN 1 THEN 4 WHEN 2 THEN CASE WHEN top >= 2 * second THEN CASE WHEN pl = 1 THEN 3 ELSE 1 END ELSE 2 END WHEN 3 THEN CASE WHEN pl = 1 THEN 2 ELSE 1 END ELSE 1 END AS n FROM s WHERE pl <= 4)
SELECT individual, round(1 - sum(n * (n - 1)) / 12.0::DOUBLE, 6) AS score, round(CASE WHEN sum(n) <= 1 THEN 0 ELSE (1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1.0::DOUBLE))) * sum(n) / 4 END, 6) AS null_aware FROM f GROUP BY individual""")
def copy_scores(spark, sf):
    c = genotype.four_copies(t.copies(spark, sf)).groupBy("individual").agg(F.collect_list("n").alias("c"))
    return c.select("individual", F.round(diversity.copy_score("c"), 6).alias("score"), F.round(diversity.null_aware_score("c"), 6).alias("null_aware"))


@query(cte("facts", "copies") + """, p AS (SELECT p_brand AS allele, coalesce(sum(n), 0)::DOUBLE / (SELECT sum(n) FROM copies) AS p FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN copies ON allele = p_brand GROUP BY 1)
SELECT round(var_pop(p), 9) AS variance, round(sum(pow(p - 1.0 / (SELECT count(*) FROM p), 2) * (SELECT count(*) FROM p)), 9) AS chi2, count(*) FILTER (p = 0) AS extinct, count(*) FILTER (p > 0 AND p < 0.02) AS endangered FROM p""")
def equilibrium_distance(spark, sf):
    pool = t.table(spark, sf, "part").select(F.col("p_brand").alias("allele")).distinct()
    d = diversity.equilibrium_distance(diversity.frequencies_with_pool(t.copies(spark, sf), pool))
    return d.select(F.round("variance", 9).alias("variance"), F.round("chi2", 9).alias("chi2"), "extinct", "endangered")


@query(cte("facts", "copies", "geno", "score") + "SELECT genotype, round(score, 6) AS score, CASE WHEN score >= 0.917 THEN 'ABCD' WHEN score >= 0.75 THEN 'AABC' WHEN score >= 0.583 THEN 'AABB' WHEN score >= 0.25 THEN 'AAAB' ELSE 'AAAA' END AS class, CASE WHEN score < 0.001 THEN 'SC / homozygous_null (0.000)' WHEN score < 0.501 THEN 'AAAB / AB00 / AAB0 (0.500)' WHEN score < 0.668 THEN 'AABB (0.667)' WHEN score < 0.751 THEN 'ABC0 (0.750)' WHEN score < 0.834 THEN 'AABC (0.833)' ELSE 'ABCD (1.000)' END AS tier, count(*) AS n FROM score GROUP BY ALL")
def score_classes(spark, sf):
    g = t.genotyped(spark, sf).withColumn("score", labels.class_score("genotype"))
    return g.groupBy("genotype", F.round("score", 6).alias("score"), labels.score_class("score").alias("class"), labels.score_tier("score").alias("tier")).agg(F.count("*").alias("n"))


@query(cte("facts", "copies", "members", "own", "totals") + """, p AS (SELECT a.lineage, sum(a.p * b.p * pow(greatest(0, 1 - a.p - CASE WHEN a.allele <> b.allele THEN b.p ELSE 0 END), 4)) AS c, count(DISTINCT a.allele) AS k FROM totals a JOIN totals b ON a.lineage = b.lineage GROUP BY 1)
SELECT lineage, round(1 - k / 59.0::DOUBLE, 6) AS depletion, CASE WHEN 1 - k / 59.0 >= 0.5 THEN 'Informed breeding + injection (' || CASE WHEN c >= 0.4 THEN 'preventive' ELSE 'urgent' END || ')' WHEN c >= 0.4 THEN 'HEALTHY (random mating)' ELSE 'Informed breeding (frequency skew)' END AS strategy, CASE WHEN c >= 0.4 THEN 'green' WHEN c >= 0.2 THEN 'amber' ELSE 'red' END AS light, round(greatest(0, 1 - 8.0::DOUBLE / k), 6) AS benchmark FROM p""")
def conservation_strategy(spark, sf):
    tot = diversity.allele_totals(t.copies(spark, sf).join(t.members(spark, sf), "individual"), "lineage")
    d = diversity.compatibility(tot, "lineage").join(diversity.diversity(tot, "lineage"), "lineage").withColumn("depletion", diversity.depletion("richness"))
    return d.select("lineage", F.round("depletion", 6).alias("depletion"), labels.conservation_quadrant("depletion", "compatibility").alias("strategy"), labels.traffic_light("compatibility").alias("light"), F.round(diversity.uniform_benchmark("richness"), 6).alias("benchmark"))


# --- sets ---

_SETS = cte("facts", "members") + ", s AS (SELECT DISTINCT site, lineage, protein AS allele FROM facts JOIN members USING (individual))"


def _site_sets(spark, sf):
    """The parts that each site's individuals carry, as its set of alleles."""
    f = t.facts(spark, sf).join(t.members(spark, sf), "individual")
    return f.select("individual", "site", "lineage", F.col("protein").alias("allele")).distinct()


@query(_SETS + "SELECT groups, n_groups, count(*) AS n_alleles FROM (SELECT allele, string_agg(site, '&' ORDER BY site) AS groups, count(*)::INTEGER AS n_groups FROM s GROUP BY allele) GROUP BY ALL")
def exclusive_intersections(spark, sf):
    return sets.exclusive_intersections(_site_sets(spark, sf), "site")


@query(_SETS + ", z AS (SELECT site, count(*) AS k FROM s GROUP BY 1) SELECT x.site AS a, y.site AS b, count(*) AS shared, round(count(*) / (max(zx.k) + max(zy.k) - count(*))::DOUBLE, 6) AS jaccard FROM s x JOIN s y ON x.allele = y.allele AND x.site < y.site JOIN z zx ON zx.site = x.site JOIN z zy ON zy.site = y.site GROUP BY x.site, y.site")
def shared_alleles(spark, sf):
    own = _site_sets(spark, sf)
    return sets.shared_counts(own, "site").join(sets.jaccard(own, "site"), ["a", "b"]).select("a", "b", "shared", *r6("jaccard"))


@query(_SETS + """, par AS (SELECT site, lineage, count(DISTINCT individual) AS n FROM facts JOIN members USING (individual) GROUP BY ALL), z AS (SELECT site, count(*) AS k FROM s GROUP BY 1),
sh AS (SELECT x.site AS recipient, y.site AS donor, count(*) AS shared FROM s x JOIN s y ON x.allele = y.allele AND x.site <> y.site GROUP BY ALL),
nov AS (SELECT r.site AS recipient, d.site AS donor, r.lineage = d.lineage AS same_parent, z.k - coalesce(sh.shared, 0) AS novel, coalesce(sh.shared, 0) AS shared, d.n AS donor_n FROM par r JOIN par d ON r.site <> d.site JOIN z ON z.site = d.site LEFT JOIN sh ON sh.recipient = r.site AND sh.donor = d.site)
SELECT recipient, donor, same_parent, novel::INTEGER AS novel, shared::INTEGER AS shared, donor_n, row_number() OVER (PARTITION BY recipient, same_parent ORDER BY novel DESC, shared DESC, donor_n DESC, donor)::INTEGER AS rank FROM nov""")
def donor_ranking(spark, sf):
    own = _site_sets(spark, sf)
    g = own.groupBy(F.col("site").alias("name"), F.col("lineage").alias("parent")).agg(F.count_distinct("individual").alias("n"), F.sort_array(F.collect_set("allele")).alias("alleles"))
    return sets.donor_ranking(g, 100_000).select("recipient", "donor", "same_parent", "novel", "shared", "donor_n", "rank")


# --- positional series ---

_DEPTH = "WITH d AS (SELECT user_id AS contig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events) "


def _depth(spark, sf):
    from pyspark.sql.window import Window

    return t.table(spark, sf, "events").select(F.col("user_id").alias("contig"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), "value")


@query(_DEPTH + """, w AS (SELECT *, avg(value) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM d), g AS (SELECT contig, count(*) AS n, avg(value) AS mean, median(value) AS median, CASE WHEN count(*) <= 20 THEN avg(value) ELSE min(CASE WHEN pos >= 20 THEN a END) END AS window_min FROM w GROUP BY contig)
SELECT contig, n, round(mean, 5) AS mean, round(median, 5) AS median, round(window_min, 5) AS window_min, CASE WHEN mean < 20 OR coalesce(window_min / nullif(median, 0), 0) < 0.2 THEN 'DROP' ELSE 'KEEP' END AS decision FROM g""")
def coverage_report(spark, sf):
    out = profiles.coverage_report(_depth(spark, sf), value="value", size=20)
    return out.select("contig", "n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "window_min")], "decision")


@query(_DEPTH + """, th AS (SELECT contig, avg(value) + stddev_pop(value) AS t FROM d GROUP BY 1), h AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS k FROM d JOIN th USING (contig) WHERE value > t)
SELECT contig, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last, count(*) AS length FROM h GROUP BY contig, k HAVING count(*) >= 2""")
def high_runs(spark, sf):
    return profiles.high_runs(_depth(spark, sf), "contig", "pos", "value", least=2)


@query(_DEPTH + """, n AS (SELECT contig, count(*) AS n FROM d GROUP BY 1), m AS (SELECT contig, pos AS pl, value FROM d UNION ALL SELECT contig, 1 - pos, value FROM d WHERE pos <= 4 UNION ALL SELECT contig, 2 * n + 1 - pos, value FROM d JOIN n USING (contig) WHERE pos > n - 3),
s AS (SELECT contig, pl, avg(value) OVER (PARTITION BY contig ORDER BY pl ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS smooth FROM m) SELECT contig, pl::INTEGER AS pos, round(smooth, 5) AS smooth FROM s JOIN n USING (contig) WHERE pl BETWEEN 1 AND n""")
def smoothed_profile(spark, sf):
    return profiles.smoothed(_depth(spark, sf), "contig", "pos", "value", 8).select("contig", "pos", F.round("smooth", 5).alias("smooth"))


@query("""SELECT source, max(n_chars) AS n50 FROM (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents) WHERE run * 2 >= total GROUP BY source""")
def length_n50(spark, sf):
    from polyloom.sources.files import n50

    return n50(t.table(spark, sf, "documents").select("source", "n_chars"), "source", "n_chars")


_CELLS = "WITH c AS (SELECT item_id, string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '') AS seq FROM benchmark), cells AS (SELECT item_id, unnest(seq) AS aa, generate_subscripts(seq, 1)::INTEGER AS pos FROM c) "


def _cells(spark, sf):
    """The benchmark's items as rows of an alignment, a character a column; letters as capitals."""
    d = t.table(spark, sf, "benchmark")
    return profiles.columns(d.select(F.col("item_id").alias("id"), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("seq")))


@query(_CELLS + """, k AS (SELECT pos, aa, count(*) AS c FROM cells WHERE aa IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') GROUP BY ALL), q AS (SELECT *, sum(c) OVER (PARTITION BY pos) AS n FROM k)
SELECT pos, max(n)::BIGINT AS n, count(*) AS k, round(-sum(c / n::DOUBLE * log2(c / n::DOUBLE)), 6) AS entropy, round(max(n) * count(*) / max(c)::DOUBLE, 6) AS wu_kabat FROM q GROUP BY pos""")
def entropy_profile(spark, sf):
    return profiles.entropy_profile(_cells(spark, sf)).select("pos", "n", "k", *r6("entropy", "wu_kabat"))


@query(_CELLS + ", k AS (SELECT pos, aa, count(*) AS c FROM cells WHERE aa <> '-' GROUP BY ALL) SELECT pos, round((sum(c)::DOUBLE * sum(c) - sum(c * c)) / (sum(c)::DOUBLE * (sum(c) - 1)), 9) AS difference FROM k GROUP BY pos")
def pair_differences(spark, sf):
    return profiles.pair_differences(_cells(spark, sf)).select("pos", F.round("difference", 9).alias("difference"))


def _alleles(spark, sf):
    """The benchmark's items as a reference set of alleles: distances are between alleles, never between individuals."""
    return t.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("seq"))


@query("""WITH s AS (SELECT item_id::VARCHAR AS id, string_split(text, '') AS seq FROM benchmark), x AS (SELECT id, unnest(seq) AS c, generate_subscripts(seq, 1) AS i FROM s)
SELECT a.id AS a, b.id AS b, round(count(*) FILTER (a.c <> b.c) / count(*)::DOUBLE, 9) AS d FROM x a JOIN x b ON a.i = b.i AND a.id < b.id WHERE a.c <> '-' AND b.c <> '-' GROUP BY a.id, b.id""")
def pairwise_distances(spark, sf):
    return profiles.pairwise(_alleles(spark, sf)).select("a", "b", F.round("d", 9).alias("d"))


@query("""WITH s AS (SELECT item_id::VARCHAR AS id, string_split(text, '') AS seq FROM benchmark), x AS (SELECT id, unnest(seq) AS c, generate_subscripts(seq, 1) AS i FROM s),
d AS (SELECT a.id AS query, b.id AS reference, count(*) FILTER (a.c <> b.c) / count(*)::DOUBLE AS d FROM x a JOIN x b ON a.i = b.i WHERE a.id::INTEGER % 2 = 1 AND b.id::INTEGER % 2 = 0 AND a.c NOT IN ('-', 'X') AND b.c NOT IN ('-', 'X') GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY d, reference)::INTEGER AS pl, reference, round(d, 9) AS d FROM d QUALIFY pl <= 2""")
def nearest_references(spark, sf):
    s = _alleles(spark, sf)  # odd items are the queries, even ones the references
    return profiles.nearest(s.where("cast(id as int) % 2 = 1"), s.where("cast(id as int) % 2 = 0")).select("query", F.col("at").alias("pl"), "reference", F.round("d", 9).alias("d"))


@query()
def allele_clusters(spark, sf):
    return clusters.clustered(profiles.pairwise(_alleles(spark, sf)), clusters=12)


@query()
def functional_groups(spark, sf):
    return clusters.clustered(profiles.pairwise(_alleles(spark, sf)), gap=True)


@query()
def cluster_medoids(spark, sf):
    d = profiles.pairwise(_alleles(spark, sf))
    return profiles.medoids(d, clusters.clustered(d, clusters=12))


@query()
def cluster_sensitivity(spark, sf):
    return clusters.clusters_by_threshold(clusters.average_linkage(profiles.pairwise(_alleles(spark, sf))), _alleles(spark, sf).count(), [i / 40 for i in range(41)])


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - p_partkey % (p_size + 1) AS b FROM part), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT node, node AS other FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a) SELECT node, min(other) AS root FROM r GROUP BY node""")
def connected_components(spark, sf):
    e = t.table(spark, sf, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - F.col("p_partkey") % (F.col("p_size") + 1)).alias("b"))
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    return clusters.components(e, nodes)


# --- calibration and bookkeeping ---


@query("""WITH p AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), b AS (SELECT *, CASE WHEN n_chars BETWEEN 0 AND 500 THEN '[0, 500]' WHEN n_chars <= 1000 THEN '(500, 1000]' WHEN n_chars <= 2000 THEN '(1000, 2000]' WHEN n_chars <= 5000 THEN '(2000, 5000]' WHEN n_chars <= 100000 THEN '(5000, 100000]' END AS bin FROM p)
SELECT bin, count(*) AS n, sum(quality)::BIGINT AS n_pass, round(median(n_chars), 6) AS median, round(100 * avg(quality), 6) AS percent FROM b GROUP BY bin""")
def dose_response(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "n_chars").join(t.table(spark, sf, "labels"), "doc_id").withColumn("bin", labels.bucket("n_chars", [0, 500, 1000, 2000, 5000, 100000]).cast("string"))
    d = d.withColumn("bin", F.when(F.col("n_chars") > 5000, F.when(F.col("n_chars") <= 100000, "(5000, 100000]")).otherwise(F.col("bin")))
    return profiles.dose_response(d, "bin", "n_chars", "quality").select("bin", "n", "n_pass", *r6("median", "percent"))


@query("""WITH p AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT n_chars, count(*) AS n, sum(quality) AS k FROM p GROUP BY 1), c AS (SELECT n_chars, sum(n) OVER (ORDER BY n_chars DESC) AS a, sum(k) OVER (ORDER BY n_chars DESC) AS b FROM g) SELECT min(n_chars) AS threshold FROM c WHERE a >= 10 AND b >= 0.8 * a""")
def least_threshold(spark, sf):
    return profiles.least_threshold(t.table(spark, sf, "documents").select("doc_id", "n_chars").join(t.table(spark, sf, "labels"), "doc_id"), "n_chars", "quality", 0.8)


@query("""WITH p AS (SELECT n_chars::DOUBLE AS x, toxic + 2 * quality AS y FROM documents JOIN labels USING (doc_id)), a AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p) SELECT round(corr(rx, ry), 9) AS rho, count(*) AS n FROM a""")
def spearman_rho(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "n_chars").join(t.table(spark, sf, "labels"), "doc_id").withColumn("y", F.col("toxic") + 2 * F.col("quality"))
    return statistics.spearman(d, "n_chars", "y").select(F.round("rho", 9).alias("rho"), "n")


@query("""WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT a, b, coalesce(n, 0) AS observed FROM (SELECT DISTINCT a FROM o) CROSS JOIN (SELECT DISTINCT b FROM o) LEFT JOIN o USING (a, b)), e AS (SELECT *, sum(observed) OVER (PARTITION BY a)::DOUBLE AS r, sum(observed) OVER (PARTITION BY b)::DOUBLE AS c, sum(observed) OVER ()::DOUBLE AS t FROM g)
SELECT a, b, observed, round(r * c / t, 6) AS expected, round((observed - r * c / t) / sqrt(r * c / t * (1 - r / t) * (1 - c / t)), 6) AS residual FROM e""")
def contingency_residuals(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    return statistics.contingency(o, "a", "b").select("a", "b", "observed", *r6("expected", "residual"))


@query()
def contingency_test(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    return statistics.contingency_test(statistics.contingency(o, "a", "b"), "a", "b")


@query()
def fisher_by_site(spark, sf):
    m = t.members(spark, sf).join(t.genotyped(spark, sf), "individual").withColumn("focus", F.col("individual") % 2 == 0).withColumn("hom", F.col("zygosity") == "Homozygous")
    g = m.groupBy("site").agg(*[F.count_if((F.col("focus") == a) & (F.col("hom") == b)).alias(n) for n, a, b in (("a", True, True), ("b", True, False), ("c", False, True), ("d", False, False))])
    return g.where("a + b >= 3 and c + d >= 3").withColumn("p", statistics.fisher_p_value("a", "b", "c", "d"))


@query()
def rank_tests(spark, sf):
    return statistics.rank_tests(t.table(spark, sf, "part"), "p_type", "p_size")


@query("SELECT lang, mode FROM (SELECT lang, source AS mode, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS pl FROM documents GROUP BY lang, source) WHERE pl = 1")
def modal_source(spark, sf):
    return quality.modes(t.table(spark, sf, "documents"), "lang", "source")


@query("SELECT s.s_suppkey AS s_suppkey, s_nationkey, c.copies FROM supplier s JOIN (SELECT s_nationkey AS k, count(*) AS copies FROM supplier GROUP BY 1 HAVING count(*) > 1) c ON c.k = s.s_nationkey")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(t.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "s_nationkey", "copies")


@query("""WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '15' WHEN o_orderkey % 7 = 2 THEN (o_custkey % 30)::VARCHAR WHEN o_orderkey % 7 = 3 THEN (o_custkey % 30) || '-x' WHEN o_orderkey % 7 = 4 THEN ' ' || (o_custkey % 9) || ' ' ELSE 'abc' END AS pop FROM orders), q AS (SELECT id, trim(pop) AS pop, regexp_extract(trim(pop), '^(\\d+)-', 1) AS pre FROM p), k AS (SELECT 'EO' || lpad(n_nationkey::VARCHAR, 2, '0') AS site FROM nation)
SELECT id, CASE WHEN pop = '' THEN NULL WHEN pop = '15' THEN 'EO18' WHEN regexp_full_match(pop, '\\d+') AND 'EO' || CASE WHEN length(pop) < 2 THEN '0' || pop ELSE pop END IN (SELECT site FROM k) THEN 'EO' || CASE WHEN length(pop) < 2 THEN '0' || pop ELSE pop END WHEN pre <> '' AND 'EO' || CASE WHEN length(pre) < 2 THEN '0' || pre ELSE pre END IN (SELECT site FROM k) THEN 'EO' || CASE WHEN length(pre) < 2 THEN '0' || pre ELSE pre END END AS site,
CASE WHEN pop = '' THEN 'Unassigned' WHEN pop = '15' THEN 'Inferred' WHEN regexp_full_match(pop, '\\d+') AND 'EO' || CASE WHEN length(pop) < 2 THEN '0' || pop ELSE pop END IN (SELECT site FROM k) THEN 'Assigned' WHEN pre <> '' AND 'EO' || CASE WHEN length(pre) < 2 THEN '0' || pre ELSE pre END IN (SELECT site FROM k) THEN 'Inferred' ELSE 'Unassigned' END AS site_status FROM q""".replace("\\\\d", "\\d"))
def site_assignment(spark, sf):
    m = F.col("o_orderkey") % 7
    pop = F.when(m == 0, "").when(m == 1, "15").when(m == 2, (F.col("o_custkey") % 30).cast("string")).when(m == 3, F.concat((F.col("o_custkey") % 30).cast("string"), F.lit("-x"))).when(m == 4, F.concat(F.lit(" "), (F.col("o_custkey") % 9).cast("string"), F.lit(" "))).otherwise("abc")
    samples = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), pop.alias("pop"))
    sites = t.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("lineage"), F.concat(F.lit("EO"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("site"), F.lit(1.0).alias("drift"))
    return quality.assigned_sites(samples, sites).select("id", "site", "site_status")


@query("""WITH a AS (SELECT r_name AS lineage, s_acctbal AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT lineage, row_number() OVER (ORDER BY round(sum(area), 4) DESC, lineage)::INTEGER AS rank FROM a GROUP BY lineage""")
def lineage_order(spark, sf):
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("lineage"), F.col("s_acctbal").cast("double").alias("area"), F.lit(1).alias("places"))
    return quality.lineage_order(s).select("lineage", "rank")


@query("""SELECT coalesce(o_orderpriority, 'TOTAL') AS hypothesis, count(*) AS crosses, sum(attempts)::BIGINT AS attempts FROM (SELECT o_orderpriority, o_custkey % 7 AS attempts FROM orders) GROUP BY ROLLUP (o_orderpriority)""")
def plan_summary(spark, sf):
    return breeding.plan_summary(t.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("hypothesis"), (F.col("o_custkey") % 7).alias("attempts")))


@query("""SELECT doc_id, (length(text) - length(translate(text, 'Nn', '')))::INTEGER AS n_count, array_to_string(list_filter([CASE WHEN length(regexp_replace(text, '[*]$', '')) < 500 THEN 'too_short' END, CASE WHEN contains(text, 'X') THEN 'contains_X' END, CASE WHEN contains(regexp_replace(text, '[*]$', ''), '*') THEN 'internal_stop' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def validity_reasons(spark, sf):
    d = t.table(spark, sf, "documents")
    return d.select("doc_id", sequence.count_of("text", "Nn").alias("n_count"), F.array_join(sequence.failures("text", 500), ",").alias("reasons"))


@query("""SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source""")
def category_shares(spark, sf):
    d = t.table(spark, sf, "documents")
    out = quality.category_matrix(d, "lang", "source", [f"src{i}" for i in range(20)])
    return out.where("n > 0").select("lang", "source", "n", *r6("share"))


# --- crosses and simulations ---


def _genotypes(spark, sf):
    """The distinct genotypes of all individuals with part types as alleles: at most 126 of six alleles, whatever the data."""
    part = t.table(spark, sf, "part").select(F.col("p_partkey").alias("protein"), F.col("p_type").alias("allele"))
    c = genotype.copy_counts(t.facts(spark, sf).drop("allele").join(part, "protein"))
    w = F.flatten(F.collect_list(F.array_repeat(F.col("allele"), F.col("n"))))
    return genotype.four_copies(c).groupBy("individual").agg(F.array_sort(w).alias("genotype")).where("size(genotype) = 4")


_FOUR = """WITH cp AS (SELECT l_orderkey AS individual, p_type AS allele, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY n DESC, allele) AS pl, count(*) OVER (PARTITION BY individual) AS k, max(n) OVER (PARTITION BY individual) AS top FROM cp), s AS (SELECT *, max(CASE WHEN pl = 2 THEN n END) OVER (PARTITION BY individual) AS second FROM r),
f AS (SELECT individual, allele, CASE k WHEN 1 THEN 4 WHEN 2 THEN CASE WHEN top >= 2 * second THEN CASE WHEN pl = 1 THEN 3 ELSE 1 END ELSE 2 END WHEN 3 THEN CASE WHEN pl = 1 THEN 2 ELSE 1 END ELSE 1 END AS n FROM s WHERE pl <= 4),
gt AS (SELECT individual, list_sort(flatten(list(list_transform(range(n), lambda i: allele)))) AS g FROM f GROUP BY individual), gd AS (SELECT g, array_to_string(g, '+') AS name, count(*) AS plants FROM gt GROUP BY g),
ga AS (SELECT name, g, list_sort([g[i], g[j]]) AS gam, count(*) / 6.0::DOUBLE AS p FROM gd, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) t(i, j) GROUP BY ALL)
"""


@query(_FOUR + ", " + t.SQL["members"] + ", w AS (SELECT lineage, g, count(*) AS w FROM gt JOIN members USING (individual) GROUP BY ALL), q AS (SELECT a.lineage, sum(x) AS whole, sum(CASE WHEN len(list_filter(fg, lambda z: NOT list_contains(mg, z))) >= 2 THEN x ELSE 0 END) AS free FROM (SELECT a.lineage, a.g AS mg, b.g AS fg, CASE WHEN a.g = b.g THEN a.w * (b.w - 1) ELSE a.w * b.w END AS x FROM w a JOIN w b ON a.lineage = b.lineage) a GROUP BY 1) SELECT lineage, round(CASE WHEN whole > 0 THEN free / whole + 0.1 * (1 - free / whole) ELSE 0 END, 9) AS compatibility FROM q")
def individual_compatibility(spark, sf):
    g = _genotypes(spark, sf).withColumnRenamed("genotype", "alleles").join(t.members(spark, sf), "individual")
    return diversity.individual_compatibility(g, "lineage", 0.1).select("lineage", F.round("compatibility", 9).alias("compatibility"))


@query(_FOUR + "SELECT name AS genotype, array_to_string(gam, '+') AS gamete, p FROM ga")
def gamete_distribution(spark, sf):
    return breeding.gametes(_genotypes(spark, sf).select("genotype").distinct()).withColumn("gamete", F.array_join("gamete", "+")).withColumn("genotype", F.array_join("genotype", "+"))


@query(_FOUR + ", made AS (SELECT m.name || ' x ' || f.name AS \"cross\", list_sort(list_concat(m.gam, f.gam)) AS o, sum(m.p * f.p * CASE WHEN list_has_any(f.gam, m.g) THEN 0.1::DOUBLE ELSE 1 END) AS q FROM ga m JOIN ga f ON m.name < f.name GROUP BY ALL) SELECT \"cross\", array_to_string(o, '+') AS genotype, round(q / sum(q) OVER (PARTITION BY \"cross\"), 9) AS p, round(sum(q) OVER (PARTITION BY \"cross\"), 9) AS compatibility FROM made")
def cross_offspring(spark, sf):
    g = _genotypes(spark, sf).select("genotype").distinct().withColumn("name", F.array_join("genotype", "+"))
    a, b = g.select(F.col("name").alias("i"), F.col("genotype").alias("mother")), g.select(F.col("name").alias("j"), F.col("genotype").alias("father"))
    c = a.join(b, F.col("i") < F.col("j")).select(F.concat_ws(" x ", "i", "j").alias("cross"), "mother", "father")
    return breeding.offspring(c, leakage=0.1).select("cross", F.array_join("genotype", "+").alias("genotype"), F.round("p", 9).alias("p"), F.round("compatibility", 9).alias("compatibility"))


@query(_FOUR + "SELECT m.name AS mother, f.name AS father, round(CASE WHEN m.name = f.name AND m.plants = 1 THEN 0 ELSE coalesce(sum(f.p) FILTER (NOT list_has_any(f.gam, m.g)), 0) END, 9) AS compatibility FROM gd m JOIN ga f ON true GROUP BY m.name, f.name, m.plants")
def crossing_matrix(spark, sf):
    m = breeding.crossing_matrix(_genotypes(spark, sf))
    return m.select(F.array_join("mother", "+").alias("mother"), F.array_join("father", "+").alias("father"), F.round("compatibility", 9).alias("compatibility"))


@query(cte("facts", "copies") + "SELECT allele, count(DISTINCT individual) AS carriers, round(sum(n) / (SELECT sum(n) FROM copies)::DOUBLE, 9) AS p FROM copies GROUP BY allele HAVING count(DISTINCT individual) <= 2 OR sum(n) / (SELECT sum(n) FROM copies)::DOUBLE < 0.04")
def rare_alleles(spark, sf):
    return breeding.rare_alleles(t.copies(spark, sf), share=0.04).select("allele", "carriers", F.round("p", 9).alias("p"))


def _aaaa(spark, sf):
    g = t.genotyped(spark, sf).where("genotype = 'AAAA'").select("individual", F.substring_index("composition", "(", 1).alias("allele"))
    return g.join(t.members(spark, sf), "individual")


@query(cte("facts", "copies", "geno", "members") + """, m AS (SELECT individual, site, min(allele) AS allele FROM copies JOIN geno USING (individual) JOIN members USING (individual) WHERE genotype = 'AAAA' GROUP BY ALL), n AS (SELECT site, allele, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT individual AS father, site, list(allele) AS alleles FROM copies JOIN geno USING (individual) JOIN members USING (individual) WHERE genotype = 'AABC' GROUP BY individual, site)
SELECT father, f.site, coalesce(sum(n), 0)::BIGINT AS mothers FROM f LEFT JOIN n ON f.site <> n.site AND NOT list_contains(alleles, allele) GROUP BY father, f.site""")
def rescue_options(spark, sf):
    c = t.copies(spark, sf).join(t.genotyped(spark, sf).where("genotype = 'AABC'").select("individual"), "individual").groupBy("individual").agg(F.collect_set("allele").alias("alleles"))
    return breeding.rescue_options(c.join(t.members(spark, sf), "individual").select("individual", "site", "alleles"), _aaaa(spark, sf).select("individual", "site", "allele"))


def _plan_inputs(spark, sf):
    """Parents, alleles with class and group, and distances of alleles: those of one group are equal, the nearer their numbers the nearer the groups."""
    g = t.copies(spark, sf).groupBy("individual").agg(F.sort_array(F.collect_list(F.struct("allele", "n"))).alias("rows")).join(t.genotyped(spark, sf).select("individual", "genotype"), "individual")
    parents = g.join(t.members(spark, sf).select("individual", "lineage"), "individual", "left").select(F.format_string("I%08d", "individual").alias("individual"), "lineage", "genotype", "rows")
    k = F.substring("allele", 7, 2).cast("int")
    alleles = t.table(spark, sf, "part").select(F.col("p_brand").alias("allele")).distinct().withColumn("k", k)
    alleles = alleles.select("allele", "k", F.when(F.col("k") % 10 == 5, "FG02").otherwise("FG01").alias("cls"), F.when(F.col("k") % 10 < 4, F.concat(F.lit("Group_"), F.floor(F.col("k") / 10).cast("string"))).otherwise("Isolated").alias("grp"))
    x, y = (alleles.select(F.col("allele").alias(c), F.col("k").alias("k" + c), F.col("grp").alias("g" + c)) for c in "ab")
    d = x.join(y, F.col("a") < F.col("b")).select("a", "b", F.when((F.col("ga") == F.col("gb")) & (F.col("ga") != "Isolated"), 0.0).otherwise(F.abs(F.col("ka") - F.col("kb")) / 300).alias("d"))  # two brands, few
    return parents, alleles.drop("k"), d


@query()
def cross_plan(spark, sf):
    """All hypotheses of the plan."""
    from polyloom.operators import crossplan

    return crossplan.whole_plan(*_plan_inputs(spark, sf))


@query(cte("facts", "copies", "geno", "members") + """, f AS (SELECT individual, site, list(allele) AS alleles FROM copies JOIN geno USING (individual) JOIN members USING (individual) WHERE genotype = 'AABC' GROUP BY ALL), m AS (SELECT individual, site, min(allele) AS allele FROM copies JOIN geno USING (individual) JOIN members USING (individual) WHERE genotype = 'AAAA' GROUP BY ALL),
c AS (SELECT site AS mother_site, allele, count(*) AS n_mothers, min(individual) AS first_mother FROM m GROUP BY ALL) SELECT f.individual AS father, f.site AS father_site, mother_site, allele, n_mothers, first_mother FROM f JOIN c ON f.site <> mother_site AND NOT list_contains(f.alleles, allele)""")
def rescue_crosses(spark, sf):
    g = t.genotyped(spark, sf).select("individual", "genotype").join(t.members(spark, sf).select("individual", "site"), "individual")
    own = t.copies(spark, sf).join(g, "individual").groupBy("individual", "genotype", "site").agg(F.collect_set("allele").alias("alleles"))
    return breeding.rescue_crosses(own.where("genotype = 'AABC'"), own.where("genotype = 'AAAA'").select("individual", "site", F.array_min("alleles").alias("allele")))


@query()
def bootstrap_compatibility(spark, sf):
    own = t.copies(spark, sf).join(t.members(spark, sf), "individual")
    return simulation.bootstrap_compatibility(own, "lineage", replicates=200)


def _plants(spark, sf, group: str):
    """Genotypes with nulls by group: group, genotype, n."""
    own = genotype.apportioned(t.copies(spark, sf).withColumn("target", F.lit(4))).withColumn("genotype", F.explode(F.array_repeat("allele", F.col("n"))))
    four = own.groupBy("individual").agg(F.sort_array(F.collect_list("genotype")).alias("genotype")).join(t.members(spark, sf), "individual")
    return four.groupBy(F.col(group).alias("group"), "genotype").agg(F.count("*").alias("n"))


@query()
def inheritance_simulation(spark, sf):
    """Time to collapse of every lineage's whole population, over few replicates and generations, with a high mutation rate so that something happens."""
    runs = simulation.inheritance(_plants(spark, sf, "lineage"), replicates=2, generations=12, rates=simulation.Rates(mutation=0.05))
    return profiles.passage_quantiles(simulation.time_to_collapse(runs).withColumnRenamed("time_to_sc", "time"), ["scenario", "group"], horizon=12)


@query()
def inheritance_ribbons(spark, sf):
    return simulation.ribbons(simulation.inheritance(_plants(spark, sf, "lineage"), replicates=3, generations=4, scenarios=("baseline", "high_drift")))


def _viability_runs(spark, sf, scenarios: tuple[str, ...]):
    own = _plants(spark, sf, "site").groupBy(F.col("group").alias("site")).agg(F.sort_array(F.collect_list(F.struct("genotype", "n"))).alias("genotypes"), F.sum("n").alias("census"))
    sites = own.select("site", "genotypes", "census", F.lit(20.0).alias("fecundity"), F.lit(500.0).alias("banked"), F.lit(0.02).alias("area"), F.array(*map(F.lit, (0.6, 0.13, 0.25, 0.02))).alias("shares"), F.lit(2).alias("sc"), F.lit(0.4).alias("spread"), simulation.disaster_rate(F.lit("1999, 2004"), F.lit(12)).alias("disasters"))
    return simulation.viability(sites, replicates=2, years=6, scenarios=scenarios)


@query()
def viability_model(spark, sf):
    return simulation.against_baseline(simulation.viability_summary(_viability_runs(spark, sf, ("baseline", "worst_case", "prediction", "maternal")), (3, 6)))


@query()
def viability_allele_losses(spark, sf):
    return simulation.allele_losses(_viability_runs(spark, sf, ("baseline", "K_decline_1pct")), (3, 6))


def _strategy_runs(spark, sf):
    from polyloom.operators import strategies

    plants = _plants(spark, sf, "lineage").groupBy("genotype").agg(F.sum("n").alias("n"))
    return strategies.compare(plants, generations=3, trials=2, size=16)


@query()
def strategy_comparison(spark, sf):
    return _strategy_runs(spark, sf).groupBy("strategy", "generation").agg(*[F.avg(c).alias(c) for c in ("variance", "mean_score", "compatibility", "share_aaaa")], F.avg("extinct").alias("extinct"))


@query()
def collapse_prediction(spark, sf):
    from polyloom.operators import strategies

    return strategies.collapse_times(_strategy_runs(spark, sf).withColumn("n_alleles", F.lit(20)))


@query()
def presence_clusters(spark, sf):
    return clusters.presence_clusters(t.copies(spark, sf), k=8)


from polyloom.plans import further, more  # noqa: E402, F401  further queries add themselves
