"""Queries over the remaining operators, each with its SQL: names, sequences, alignments, joins, groups, crosses, estimates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polyloom.functions import labels, sequence
from polyloom.operators import breeding, clusters, crossplan, diversity, genotype, profiles, quality, sets, simulation
from polyloom.plans import tables as t
from polyloom.plans.registry import _plan_inputs, query, r6
from polyloom.plans.tables import cte
from polyloom.operators.shared import checkpoint_dir
from polyloom.sources import files

# --- names and samples ---


@query("SELECT split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS individual, count(*) AS n FROM (SELECT 'L' || (o_custkey % 3) || '_b' || (o_orderkey % 97) || '_h' || o_orderkey AS name FROM orders) GROUP BY 1")
def individual_ids(spark, sf):
    o = t.table(spark, sf, "orders").select(F.concat(F.lit("L"), F.col("o_custkey") % 3, F.lit("_b"), F.col("o_orderkey") % 97, F.lit("_h"), "o_orderkey").alias("name"))
    return o.groupBy(labels.individual_id("name").alias("individual")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'OUT_' WHEN l_orderkey % 5 = 1 THEN 'Library9_' ELSE 'Library1_' END || l_orderkey AS individual, l_partkey AS protein FROM lineitem) SELECT individual, count(*) AS n FROM f WHERE individual LIKE 'Library%' AND individual NOT LIKE 'Library9%' AND CAST(split_part(individual, '_', 2) AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 > 0) GROUP BY 1")
def ingroup_facts(spark, sf):
    name = lambda k: F.concat(F.when(k % 5 == 0, "OUT_").when(k % 5 == 1, "Library9_").otherwise("Library1_"), k.cast("string"))
    f = t.table(spark, sf, "lineitem").select(name(F.col("l_orderkey")).alias("individual"), F.col("l_partkey").alias("protein"))
    s = t.table(spark, sf, "orders").select(name(F.col("o_orderkey")).alias("individual"), F.when(F.col("o_custkey") % 4 > 0, "1").otherwise("0").alias("ingroup"))
    return genotype.ingroup(f, s, exclude="Library9").groupBy("individual").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS allele, count(*) AS n, count(DISTINCT l_orderkey) AS individuals, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25) AS dropped FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY 1")
def joined_alleles(spark, sf):
    keys = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("individual"), F.col("l_partkey").alias("protein"))
    own, dropped = genotype.joined_alleles(keys, t.table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("protein"), F.col("p_brand").alias("allele")))
    return own.groupBy("allele").agg(F.count("*").alias("n"), F.count_distinct("individual").alias("individuals")).crossJoin(F.broadcast(dropped))  # one row


@query("SELECT 'known' AS kind, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'missing', count(*), min(k) FROM (SELECT DISTINCT l_orderkey + 1 AS k FROM lineitem WHERE l_quantity > 49) WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def split_samples(spark, sf):
    o, li = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("individual")), t.table(spark, sf, "lineitem")
    known, _ = quality.split_samples(o, li.where("l_quantity > 45").select(F.col("l_orderkey").alias("individual")))
    _, missing = quality.split_samples(o, li.where("l_quantity > 49").select((F.col("l_orderkey") + 1).alias("individual")).distinct())
    parts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min("individual").alias("first")) for kind, df in (("known", known), ("missing", missing))]
    return parts[0].unionByName(parts[1])


@query(cte("hap", "st") + "SELECT individual, 4 AS null_copies FROM st WHERE status = 'SC' AND individual % 3 > 0")
def failed_samples(spark, sf):
    s = genotype.haplotype_status(t.logs(spark, sf))
    return quality.failed_samples(s, s.where(F.col("individual") % 3 == 0).select("individual"))


@query("WITH s AS (SELECT r_name AS lineage, n_name AS site, avg(c_acctbal) AS drift FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), l AS (SELECT lineage, row_number() OVER (ORDER BY sum(area) DESC, sum(places) - count(*) DESC, lineage) AS rank FROM (SELECT r_name AS lineage, 1 + n_nationkey % 3 AS places, 1.0 + n_nationkey % 2 AS area FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY lineage) SELECT site, row_number() OVER (ORDER BY rank, drift, site) AS site_rank FROM s JOIN l USING (lineage)")
def site_ranks(spark, sf):
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("drift"))
    return quality.site_order(n.join(c, "n_nationkey").select(F.col("r_name").alias("lineage"), F.col("n_name").alias("site"), "drift", (1.0 + F.col("n_nationkey") % 2).alias("area"), (1 + F.col("n_nationkey") % 3).alias("places"))).select("site", "site_rank")


# --- sequences: order keys and texts stand for them ---

_DNA = "d AS (SELECT o_orderkey AS id, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACG-') || CASE WHEN o_orderkey % 3 = 0 THEN 'TAA' ELSE '' END AS seq FROM orders)"


def _dna(spark, sf):
    """Strings of A, C, G, T and gaps made from the order's key."""
    k = F.col("o_orderkey")
    return t.table(spark, sf, "orders").select(k.alias("id"), F.concat(F.translate(F.md5(k.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACG-"), F.when(k % 3 == 0, "TAA").otherwise("")).alias("seq"))


@query("SELECT doc_id, len(regexp_replace(translate(text, 'c', 'C'), '[^C]', '', 'g')) >= 60 AND (regexp_matches(text, 'e[a-z]n') OR regexp_matches(text, 'th[eai]s')) AS domains FROM documents WHERE text IS NOT NULL")
def domain_checks(spark, sf):
    d = t.table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", sequence.has_domains(F.translate("text", "c", "C"), 60, ("e[a-z]n", "th[eai]s")).alias("domains"))


@query("SELECT o_orderkey, CASE WHEN d <= 0.005 AND s <= 3 THEN 'high' WHEN d <= 0.05 AND s <= 10 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT o_orderkey, (o_orderkey % 80) / 1000.0 AS d, o_custkey % 13 AS s FROM orders)")
def broken_confidences(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", labels.broken_confidence((F.col("o_orderkey") % 80) / 1000, F.col("o_custkey") % 13).alias("confidence"))


@query("WITH p AS (SELECT o_orderkey AS id, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACDEFGHIKLMNP*QR') AS aa FROM orders) SELECT id, list_filter(list_transform(range(1, length(aa)), lambda i: CASE WHEN substr(aa, i, 1) = '*' THEN i END), lambda x: x IS NOT NULL)::VARCHAR AS stops, CASE WHEN instr(left(aa, length(aa) - 1), '*') > 0 THEN 'REMOVED' ELSE 'OK' END AS state FROM p")
def stop_log(spark, sf):
    k = F.col("o_orderkey").cast("string").cast("binary")
    p = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.translate(F.md5(k), "0123456789abcdef", "ACDEFGHIKLMNP*QR").alias("aa"))
    return p.select("id", F.concat(F.lit("["), F.array_join(F.transform(sequence.stop_positions("aa"), lambda x: x.cast("string")), ", "), F.lit("]")).alias("stops"), sequence.stop_status("aa").alias("state"))


@query("SELECT source, count(*) AS n FROM documents WHERE length(text) BETWEEN 500 AND 5000 GROUP BY source")
def length_filter(spark, sf):
    return t.table(spark, sf, "documents").where(sequence.length_between("text", 500, 5000)).groupBy("source").agg(F.count("*").alias("n"))


@query("WITH " + _DNA + ", w AS (SELECT id, '--' || seq AS seq, repeat('T', 2 + length(seq)) AS ref FROM d), e AS (SELECT id, seq, length(regexp_extract(seq, '^(-*)', 1)) AS a, length(seq) - length(regexp_extract(seq, '(-*)$', 1)) AS z, length(seq) AS n FROM w) SELECT id, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(seq, i, 1) <> '-' THEN substr(seq, i, 1) WHEN i <= 1 OR i > n - 1 THEN 'T' WHEN i <= a OR i > z THEN 'N' ELSE '-' END), '') AS filled FROM e")
def backfilled_ends(spark, sf):
    d = _dna(spark, sf).select("id", F.concat(F.lit("--"), "seq").alias("seq"))
    return d.select("id", sequence.backfill_ends("seq", F.expr("repeat('T', length(seq))"), edge=1).alias("filled"))


@query("WITH " + _DNA + " SELECT id, reverse(translate(replace(substr(seq, 3, 8) || substr(seq, 15, 6), '-', ''), 'ACGT', 'TGCA')) AS exons, replace(substr(seq, 3, 8) || substr(seq, 15, 6), '-', '') AS forward FROM d")
def projected_exons(spark, sf):
    return _dna(spark, sf).select("id", sequence.project_exons("seq", [(3, 10), (15, 20)], reverse=True).alias("exons"), sequence.project_exons("seq", [(3, 10), (15, 20)]).alias("forward"))


@query("WITH " + _DNA + " SELECT key, count(*) AS n, min(id) AS representative, list(id ORDER BY id)::VARCHAR AS members FROM (SELECT id, translate(replace(substr(seq, 3, 4), '-', ''), 'X', '*') AS key FROM d) GROUP BY key")
def collapsed_region(spark, sf):
    c = genotype.collapsed(_dna(spark, sf), sequence.region("seq", 3, 6))
    return c.select("key", "n", "representative", F.concat(F.lit("["), F.array_join(F.transform("members", lambda x: x.cast("string")), ", "), F.lit("]")).alias("members"))


@query("WITH k AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'ATG-GCC' WHEN 1 THEN 'ATGGCA' WHEN 2 THEN 'ATGTAAGGG' ELSE 'TAA' END AS seq FROM orders) SELECT CASE WHEN id % 4 < 2 THEN 'MA' ELSE 'M' END AS key, count(*) AS n, min(id) AS representative FROM k WHERE id % 4 < 3 GROUP BY 1")
def collapsed_translation(spark, sf):
    k = F.col("o_orderkey")
    d = t.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 4 == 0, "ATG-GCC").when(k % 4 == 1, "ATGGCA").when(k % 4 == 2, "ATGTAAGGG").otherwise("TAA").alias("seq"))
    return genotype.collapsed(d, sequence.translated_key("seq")).drop("members")


@query("WITH " + _DNA + ", s AS (SELECT id, replace(seq, '-', '') AS seq, id % 2 = 1 AS turned FROM d) SELECT id, seq, turned AS reversed FROM s")
def oriented_haplotypes(spark, sf):
    """Every other haplotype is given as the other strand, and comes back."""
    d = _dna(spark, sf).select("id", F.regexp_replace("seq", "-", "").alias("right"))
    d = d.withColumn("given", F.when(F.col("id") % 2 == 1, sequence.reverse_complement("right")).otherwise(F.col("right")))
    return d.select("id", sequence.oriented("given", F.concat(F.col("right"), F.lit("ACCA")), 8).alias("o")).select("id", "o.seq", "o.reversed")


@query("WITH " + _DNA + " SELECT is_reference, count(*) AS n, min(id) AS first FROM (SELECT id, true AS is_reference FROM d WHERE id % 10 = 0 UNION ALL SELECT id, false FROM d WHERE id % 10 > 0) GROUP BY 1")
def merged_references(spark, sf):
    d = _dna(spark, sf)
    return genotype.with_references(d, d.where(F.col("id") % 10 == 0)).groupBy("is_reference").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("WITH " + _DNA + " SELECT id, rpad(seq, (SELECT max(length(seq)) FROM d)::INTEGER, '-') AS seq FROM d")
def padded_rows(spark, sf):
    d = _dna(spark, sf)
    return d.crossJoin(F.broadcast(d.agg(F.max(F.length("seq")).alias("most")))).select("id", sequence.padded("seq", "most").alias("seq"))  # one row


# --- readers, over files that they write into the shared folder ---


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/polyloom-files/{uuid.uuid4().hex}"


@query("SELECT p_partkey::VARCHAR || '|>' || p_size AS id, 'count=' || p_size || ' of > ' || p_brand AS description, p_name || '-' || p_type AS seq FROM part")
def fasta_round_trip(spark, sf):
    """Headers with marks in them, written and read again (white space is no part of a sequence)."""
    path = _folder(spark)
    p = t.table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("|>"), F.col("p_size").cast("string")).alias("id"), F.concat(F.lit("count="), F.col("p_size").cast("string"), F.lit(" of > "), "p_brand").alias("description"), F.concat_ws("-", "p_name", "p_type").alias("seq"))
    files.write_fasta(p.withColumn("seq", F.translate("seq", " ", "~")), path)
    return files.read_fasta(spark, path).select("id", "description", F.translate("seq", "~", " ").alias("seq"))


@query("SELECT count(*) AS reads, sum(length(p_type)) AS bases, count(*) FILTER (length(p_type) >= 20) AS long_reads, round(sum(length(p_type) * (7 + p_size % 20)) / sum(length(p_type))::DOUBLE, 2) AS quality FROM part")
def fastq_statistics(spark, sf):
    path = _folder(spark)
    t.table(spark, sf, "part").select(F.concat_ws("\n", F.concat(F.lit("@r"), F.col("p_partkey").cast("string")), F.translate("p_type", " ", "N"), F.lit("+"), F.expr("repeat(char(p_size % 20 + 40), length(p_type))")).alias("value")).write.text(path)
    s = files.read_stats(files.read_fastq(spark, path), long=20)
    whole = files.read_fastq(spark, path).select(F.sum(F.aggregate(F.transform(F.split("quality", ""), lambda c: F.ascii(c) - 33), F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    return s.agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), F.sum("long_reads").alias("long_reads")).crossJoin(F.broadcast(whole)).select("reads", "bases", "long_reads", F.round(F.col("total") / F.col("bases"), 2).alias("quality"))  # one row each


@query("SELECT p_partkey AS k, p_name AS name, round(p_retailprice, 1) AS price, CASE WHEN p_size % 5 > 0 THEN p_size END AS size FROM part")
def table_round_trip(spark, sf):
    """Typed columns, missing values and rounding of the table sink and reader."""
    path = _folder(spark)
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("size"))
    files.write_table(p, path, ["k"], {"price": 1}, sep=",")
    return files.require_columns(files.read_table(spark, path, ",", {"k": "bigint", "price": "double", "size": "int"}), ["k", "size"])


@query("SELECT 1000 + max(s_suppkey) AS reads FROM supplier")
def report_count(spark, sf):
    """The first number of a report, here of one file."""
    path = _folder(spark)
    s = t.table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("k")).select(F.concat(F.lit("x\n -- Found "), F.format_number(F.col("k") + 1000, 0), F.lit(" reads.\nFound 7 reads")).alias("value"))
    s.coalesce(1).write.text(path)
    return files.report_count(spark, path).select("reads")


@query("WITH d AS (SELECT l_suppkey AS contig, l_linenumber * 3 AS pos, max(l_partkey) AS depth FROM lineitem GROUP BY ALL), m AS (SELECT contig, max(pos) AS n FROM d GROUP BY contig) SELECT m.contig, p.pos, coalesce(d.depth, 0) AS depth FROM m, LATERAL (SELECT unnest(range(1, n + 1)) AS pos) p LEFT JOIN d ON d.contig = m.contig AND d.pos = p.pos")
def dense_depth(spark, sf):
    li = t.table(spark, sf, "lineitem")
    return files.dense_depth(li.groupBy(F.col("l_suppkey").alias("contig"), (F.col("l_linenumber") * 3).alias("pos")).agg(F.max("l_partkey").alias("depth")))


@query("SELECT p_partkey AS k, p_size AS start FROM part WHERE p_size % 3 = 0 AND 5 + p_partkey % 20 >= 12")
def long_exons(spark, sf):
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 == 0, "exon").otherwise("gene").alias("V3"), F.col("p_size").cast("string").alias("V4"), (F.col("p_size") + 4 + F.col("p_partkey") % 20).cast("string").alias("V5"))
    return files.exons(p, 12).select("k", F.col("V4").cast("int").alias("start"))


# --- alignments: customers are rows, months of a year are columns ---

_ALIGNED = "c AS (SELECT o_custkey % 40 AS id, o_orderkey % 60 AS pos, CASE WHEN min(o_totalprice) < 20000 THEN '-' ELSE substr('ACDEFGHIKL', CAST(min(o_orderkey) % (1 + o_orderkey % 60 % 4) AS INTEGER) + 1, 1) END AS aa FROM orders GROUP BY o_custkey % 40, o_orderkey % 60)"


def _aligned(spark, sf):
    g = t.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("id"), (F.col("o_orderkey") % 60).alias("pos")).agg(F.min("o_totalprice").alias("price"), F.min("o_orderkey").alias("first"))
    aa = F.substring(F.lit("ACDEFGHIKL"), (F.col("first") % (1 + F.col("pos") % 4)).cast("int") + 1, F.lit(1))
    return g.select("id", "pos", F.when(F.col("price") < 20000, "-").otherwise(aa).alias("aa"))


@query("WITH " + _ALIGNED + " SELECT id, pos, aa FROM c WHERE pos IN (SELECT pos FROM c WHERE aa <> 'X' GROUP BY pos HAVING count(DISTINCT aa) > 1)")
def variable_cells(spark, sf):
    return profiles.variable_cells(_aligned(spark, sf))


@query("WITH " + _ALIGNED + " SELECT pos, residue, aa FROM (SELECT pos, aa, count(*) FILTER (aa <> '-') OVER (ORDER BY pos) AS residue FROM c WHERE id = 3) WHERE aa <> '-'")
def alignment_map(spark, sf):
    return profiles.alignment_map(_aligned(spark, sf), 3)


@query("WITH " + _ALIGNED + " SELECT pos FROM c WHERE id IN (1, 2) GROUP BY pos HAVING bool_and(aa = '-')")
def insertion_columns(spark, sf):
    return profiles.insertion_columns(_aligned(spark, sf), t.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("id")).where("id in (1, 2)").distinct())


@query("SELECT contig, count(*) AS n FROM (SELECT l_suppkey AS contig FROM lineitem WHERE l_suppkey % 3 = 1) GROUP BY contig")
def kept_contigs(spark, sf):
    li = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"))
    report = li.distinct().withColumn("decision", F.when(F.col("contig") % 3 == 1, "KEEP").otherwise("DROP"))
    return profiles.kept_contigs(li, report).groupBy("contig").agg(F.count("*").alias("n"))


@query("WITH " + _ALIGNED + """, e AS (SELECT pos, -sum(p * log2(p)) AS h FROM (SELECT pos, count(*) / sum(count(*)) OVER (PARTITION BY pos)::DOUBLE AS p FROM c WHERE aa IN ('A','C','D','E','F','G','H','I','K','L') GROUP BY pos, aa) GROUP BY pos), k AS (SELECT pos, -sum(p * log2(p)) AS h FROM (SELECT pos, count(*) / sum(count(*)) OVER (PARTITION BY pos)::DOUBLE AS p FROM c WHERE aa IN ('A','C','D','E','F','G','H','I','K','L') AND id < 20 GROUP BY pos, aa) GROUP BY pos)
SELECT round(w, 6) AS whole, round(x, 6) AS collapsed, CASE WHEN abs(x - w) < 0.05 THEN 'negligible' WHEN x > w AND x >= 0.5 THEN 'substantial' WHEN x > w THEN 'partial' ELSE 'decreased' END AS verdict FROM (SELECT (SELECT median(h) FROM e) AS w, (SELECT median(h) FROM k) AS x)""")
def collapsed_entropy(spark, sf):
    c = _aligned(spark, sf)
    groups = c.select("id").distinct().withColumn("representative", F.col("id") % 20)
    x = profiles.collapsed_entropy(c, groups)
    return x.select(*r6("whole", "collapsed"), labels.collapse_verdict("whole", "collapsed", F.lit(1.0)).alias("verdict"))


# --- groups and crosses ---


@query(cte("facts", "members") + "SELECT site AS name, lineage AS parent, count(DISTINCT individual) AS n, list_sort(list(DISTINCT allele))::VARCHAR AS alleles FROM facts JOIN members USING (individual) GROUP BY site, lineage")
def allele_sets(spark, sf):
    s = sets.allele_sets(t.copies(spark, sf), t.members(spark, sf), "site", "lineage")
    return s.select("name", "parent", "n", F.concat(F.lit("["), F.array_join("alleles", ", "), F.lit("]")).alias("alleles"))


@query(cte("facts", "copies") + "SELECT substr(allele, 7, 1) AS \"group\", arg_min(allele, (-n, allele)) AS representative FROM (SELECT allele, count(*) AS n FROM copies GROUP BY allele) GROUP BY 1")
def representatives(spark, sf):
    a = t.copies(spark, sf).groupBy("allele").agg(F.count("*").alias("carriers")).withColumn("group", F.substring("allele", 7, 1))
    return clusters.representatives(a)


_EDGES = "e AS (SELECT DISTINCT c_nationkey % 9 AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50 WHERE c_nationkey % 9 < s_nationkey), g AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 7 = 6 THEN 'Isolated' ELSE 'Group_' || (n_nationkey % 7) END AS grp FROM nation)"


@query("WITH " + _EDGES + " SELECT least(x.grp, y.grp) AS x, greatest(x.grp, y.grp) AS y, count(*) AS bridges FROM e JOIN g x ON a = x.node JOIN g y ON b = y.node WHERE x.grp <> y.grp AND x.grp <> 'Isolated' AND y.grp <> 'Isolated' GROUP BY 1, 2")
def group_links(spark, sf):
    c, s = t.table(spark, sf, "customer"), t.table(spark, sf, "supplier")
    e = c.join(s, F.col("c_custkey") % 50 == F.col("s_suppkey") % 50).select((F.col("c_nationkey") % 9).alias("a"), F.col("s_nationkey").alias("b")).where("a < b").distinct()
    k = F.col("n_nationkey")
    g = t.table(spark, sf, "nation").select(k.alias("node"), F.when(k % 7 == 6, "Isolated").otherwise(F.concat(F.lit("Group_"), (k % 7).cast("string"))).alias("group"))
    return clusters.group_links(g, e)


_CLASSES = cte("facts", "copies", "geno", "members") + """, al AS (SELECT DISTINCT p_brand AS allele, CAST(substr(p_brand, 7, 2) AS INTEGER) AS k FROM part), a2 AS (SELECT allele, k, CASE WHEN k % 10 = 5 THEN 'FG02' ELSE 'FG01' END AS cls, CASE WHEN k % 10 < 4 THEN 'Group_' || (k // 10) ELSE 'Isolated' END AS grp FROM al),
d AS (SELECT x.allele AS a, y.allele AS b, CASE WHEN x.grp = y.grp AND x.grp <> 'Isolated' THEN 0.0::DOUBLE ELSE abs(x.k - y.k) / 300.0::DOUBLE END AS d FROM a2 x JOIN a2 y ON x.allele < y.allele UNION ALL SELECT allele, allele, 0.0 FROM a2),
h AS (SELECT allele, lineage, count(*) AS n FROM (SELECT individual, min(allele) AS allele FROM copies JOIN geno USING (individual) WHERE genotype = 'AAAA' GROUP BY 1) JOIN members USING (individual) GROUP BY ALL)"""


@query(_CLASSES + """ SELECT * FROM (SELECT a, b, x.lineage AS lineage_a, y.lineage AS lineage_b, CAST(CASE WHEN a = b AND x.lineage = y.lineage THEN x.n * (x.n - 1) / 2 ELSE x.n * y.n END AS BIGINT) AS pairs, d, CASE WHEN p.cls <> q.cls THEN 'Compatible_cross' WHEN d = 0 THEN 'Incompatible' WHEN d < 0.04 THEN 'Synonymy_test' ELSE 'Compatible_within' END AS category, CASE WHEN x.lineage = y.lineage THEN 'within-BL' ELSE 'between-BL' END AS pairing
FROM d JOIN h x ON x.allele = a JOIN h y ON y.allele = b JOIN a2 p ON p.allele = a JOIN a2 q ON q.allele = b WHERE a <> b OR x.lineage <= y.lineage) WHERE pairs > 0""")
def homozygote_pair_classes(spark, sf):
    return crossplan.pair_classes(*_plan_inputs(spark, sf))


@query(_CLASSES + """, c AS (SELECT allele, lineage, individual FROM (SELECT individual, min(allele) AS allele FROM copies JOIN geno USING (individual) WHERE genotype = 'AAAA' GROUP BY 1) JOIN members USING (individual)),
w AS (SELECT x.allele AS a, x.individual AS m, y.individual AS f, (x.lineage <> y.lineage)::INTEGER AS s, row_number() OVER (PARTITION BY x.allele ORDER BY (x.lineage <> y.lineage) DESC, x.individual, y.individual) AS pl FROM c x JOIN c y ON x.allele = y.allele AND x.individual <> y.individual JOIN a2 ON a2.allele = x.allele WHERE grp = 'Group_1'),
r AS (SELECT a2.allele, row_number() OVER (ORDER BY coalesce(n, 0) DESC, a2.allele) AS pos FROM a2 LEFT JOIN (SELECT allele, sum(n) AS n FROM h GROUP BY 1) t ON t.allele = a2.allele WHERE grp = 'Group_1')
SELECT row_number() OVER (ORDER BY pos) AS priority, 'I' || lpad(m::VARCHAR, 8, '0') AS mother, 'I' || lpad(f::VARCHAR, 8, '0') AS father, a AS allele FROM w JOIN r ON a = allele WHERE pl = 1 AND pos <= 8 ORDER BY pos LIMIT 5""")
def same_allele_crosses(spark, sf):
    """The first block of the plan's first hypothesis."""
    p, a, _ = _plan_inputs(spark, sf)
    h = crossplan.self_incompatibility(p, a).where(F.array_contains("father_alleles", F.col("mother_allele")) & (F.col("priority") <= 5) & (F.col("kind") == "same allele"))
    return h.select(F.col("priority").cast("bigint").alias("priority"), "mother", "father", F.col("mother_allele").alias("allele"))


@query(cte("facts", "copies", "members", "own", "totals") + ", i AS (SELECT lineage, individual, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS fixed FROM (SELECT lineage, individual, count(*) OVER (PARTITION BY individual) AS k FROM own) GROUP BY ALL) SELECT lineage, round(avg(fixed) / 3.5, 6) AS leakage, round(greatest(1, count(*) * avg(fixed)), 6) AS effective FROM i GROUP BY lineage")
def leakage_and_effective_size(spark, sf):
    own = t.copies(spark, sf).groupBy("individual").agg(F.count("*").alias("k")).join(t.members(spark, sf), "individual")
    g = own.groupBy("lineage").agg(F.avg((F.col("k") == 1).cast("double")).alias("share"), F.count("*").alias("n"))
    return g.select("lineage", F.round(diversity.estimated_leakage("share"), 6).alias("leakage"), F.round(diversity.effective_size("n", "share"), 6).alias("effective"))


@query(cte("facts", "copies", "geno", "score") + """, f AS (SELECT allele, sum(n) / sum(sum(n)) OVER ()::DOUBLE AS p FROM copies GROUP BY allele), v AS (SELECT individual, score * sum(1 / p) AS value FROM copies JOIN f USING (allele) JOIN score USING (individual) GROUP BY individual, score) SELECT individual, round(value, 6) AS value FROM (SELECT *, row_number() OVER (ORDER BY round(value, 9) DESC, individual) AS pl, count(*) OVER () AS n FROM v) WHERE pl <= greatest(1, floor(n * 0.1)) AND value > 0""")
def elites(spark, sf):
    s = t.genotyped(spark, sf).select("individual", labels.class_score("genotype").alias("score"))
    return breeding.elites(t.copies(spark, sf), s).select("individual", F.round("value", 6).alias("value"))


@query("SELECT lineage, ceil((x + y + coalesce(z, (x + y) / 2)) / 3) AS k FROM (SELECT lineage, n * 1.5::DOUBLE AS x, n + 2.0::DOUBLE AS y, CASE WHEN r % 2 = 0 THEN n * 3.0::DOUBLE END AS z FROM (SELECT r_name AS lineage, r_regionkey AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL))")
def consensus_richness(spark, sf):
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("lineage"), "r_regionkey").agg(F.count("*").alias("n"))
    n = n.select("lineage", (F.col("n") * 1.5).alias("x"), (F.col("n") + 2.0).alias("y"), F.when(F.col("r_regionkey") % 2 == 0, F.col("n") * 3.0).alias("z"))
    return n.select("lineage", diversity.consensus_richness("x", "y", "z").alias("k"))


@query(cte("facts", "copies") + ", x AS (SELECT individual, allele, CASE WHEN CAST(substr(allele, 7, 1) AS INTEGER) < 3 THEN 'I' WHEN CAST(substr(allele, 7, 1) AS INTEGER) < 5 THEN 'II' END AS cls FROM copies) SELECT individual, coalesce(string_agg(DISTINCT cls, '+' ORDER BY cls), '') AS classes, count(*) AS n_alleles, count(cls) AS n_classed FROM x GROUP BY individual")
def individual_classes(spark, sf):
    k = F.substring("allele", 7, 1).cast("int")
    c = t.copies(spark, sf).select("allele").distinct().select("allele", F.when(k < 3, "I").when(k < 5, "II").alias("cls"))
    return clusters.individual_classes(t.copies(spark, sf), c)


@query("WITH s AS (SELECT item_id::VARCHAR AS id, string_split(text, '') AS seq, item_id % 5 AS cluster FROM benchmark), x AS (SELECT id, unnest(seq) AS c, generate_subscripts(seq, 1) AS i FROM s), d AS (SELECT a.id AS a, b.id AS b, count(*) FILTER (a.c <> b.c) / count(*)::DOUBLE AS d FROM x a JOIN x b ON a.i = b.i AND a.id <> b.id WHERE a.c <> '-' AND b.c <> '-' GROUP BY a.id, b.id), m AS (SELECT a AS id, s.cluster, o.cluster AS c, avg(d) AS mean FROM d JOIN s ON s.id = a JOIN s o ON o.id = b GROUP BY ALL), z AS (SELECT id, cluster, min(mean) FILTER (c = cluster) AS own, min(mean) FILTER (c <> cluster) AS other FROM m GROUP BY ALL) SELECT id, cluster, round(coalesce((other - own) / greatest(own, other), 0), 6) AS silhouette FROM z")
def silhouettes(spark, sf):
    from polyloom.plans.registry import _alleles

    own = t.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), (F.col("item_id") % 5).alias("cluster"))
    return clusters.silhouettes(profiles.pairwise(_alleles(spark, sf)), own).select("id", "cluster", F.round("silhouette", 6).alias("silhouette"))


@query()
def cluster_numbers(spark, sf):
    from polyloom.plans.registry import _alleles

    return clusters.cluster_numbers(profiles.pairwise(_alleles(spark, sf)), 6)


@query()
def accumulation_spread(spark, sf):
    return diversity.accumulation_spread(t.copies(spark, sf).join(t.members(spark, sf), "individual").select("site", "individual", "allele"), "site", [1, 5, 10, 20])


@query()
def overlap_tests(spark, sf):
    s = t.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("na"), F.count_distinct("l_suppkey").alias("nb"))
    pairs = s.select(F.col("l_returnflag").alias("name"), F.least("na", F.lit(300)).cast("bigint").alias("na"), F.least("nb", F.lit(60)).cast("bigint").alias("nb"), F.lit(400).cast("bigint").alias("total"), F.lit(50).cast("bigint").alias("observed"))
    return simulation.overlap_test(pairs)


@query("SELECT CAST(time_bucket(INTERVAL '10 minutes', ts) AS VARCHAR) AS start, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_states(spark, sf):
    """The stream's counts by event time, over a table."""
    from polyloom.streaming import status

    e = t.table(spark, sf, "events").select(F.concat(F.lit("L_b"), "user_id", F.lit("_"), "event_id").alias("sequence_id"), F.col("event_type").alias("state"), "ts")
    return status.windowed_counts(e).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "state", "n")
