"""The driver's tables as genotype data: an order is an individual, a part a protein, its brand an allele, nations are sites, regions lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.operators import genotype


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """individual, protein, allele."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("protein"), F.col("p_brand").alias("allele"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("individual"), F.col("l_partkey").alias("protein")).join(part, "protein")


def copies(spark: SparkSession, sf: str) -> DataFrame:
    return genotype.copy_counts(facts(spark, sf))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """individual, site, lineage."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    site = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("site"), F.col("r_name").alias("lineage"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(site), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "site", "lineage")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("individual"), "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("individual", "site", "lineage")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "N", "OK").when(F.col("l_returnflag") == "R", "REMOVED").otherwise("CHIMERIC")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("individual"), state.alias("state"))


def genotyped(spark: SparkSession, sf: str) -> DataFrame:
    return genotype.genotypes(copies(spark, sf))


#: The same in SQL, as common table expressions.
SQL = {
    "facts": "facts AS (SELECT l_orderkey AS individual, l_partkey AS protein, p_brand AS allele FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "copies": "copies AS (SELECT individual, allele, count(DISTINCT protein) AS n FROM facts GROUP BY ALL)",
    "members": "members AS (SELECT o_orderkey AS individual, n_name AS site, r_name AS lineage FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "geno": "geno AS (SELECT individual, count(*) AS k, list_sort(list(n), 'DESC') AS c, CASE WHEN count(*) = 1 THEN 'AAAA' WHEN count(*) = 2 THEN CASE WHEN max(n) >= 2 * min(n) THEN 'AAAB' ELSE 'AABB' END WHEN count(*) = 3 THEN 'AABC' ELSE 'ABCD' END AS genotype FROM copies GROUP BY individual)",
    "score": "score AS (SELECT individual, genotype, CASE genotype WHEN 'ABCD' THEN 1.0::DOUBLE WHEN 'AABC' THEN 5.0::DOUBLE / 6 WHEN 'AABB' THEN 4.0::DOUBLE / 6 WHEN 'AAAB' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM geno)",
    "own": "own AS (SELECT * FROM copies JOIN members USING (individual))",
    "totals": "totals AS (SELECT lineage, allele, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY lineage)::DOUBLE AS total, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY lineage)::DOUBLE AS p FROM own GROUP BY lineage, allele)",
    "hap": "hap AS (SELECT l_orderkey AS individual, count(*) FILTER (l_returnflag = 'N') AS ok, count(*) FILTER (l_returnflag = 'R') AS removed, count(*) FILTER (l_returnflag NOT IN ('N', 'R')) AS chimeric FROM lineitem GROUP BY 1)",
    "st": "st AS (SELECT *, ok + removed AS total, CASE WHEN ok + removed >= 4 THEN CAST(round_even(4.0::DOUBLE * (removed::DOUBLE / (ok + removed)), 0) AS INTEGER) END AS copies, CASE WHEN ok + removed < 4 THEN 'Insufficient_data' WHEN round_even(4.0::DOUBLE * (removed::DOUBLE / (ok + removed)), 0) = 4 THEN 'SC' WHEN round_even(4.0::DOUBLE * (removed::DOUBLE / (ok + removed)), 0) = 0 OR removed < 2 THEN 'SI' ELSE 'pSI' END AS status FROM hap)",
}


def cte(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
