"""From sequences to genotypes. Tables stay long: (individual, protein, allele) or (individual, allele, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.functions import labels
from polyloom.operators.shared import checkpoint_dir


def named_proteins(seqs: DataFrame, order: str = "ord", least: int = 1, prefix: str = "protein_", digits: int = 3) -> DataFrame:
    """Distinct sequences, those of ``least`` copies or more, numbered by first appearance: seq, n, first, number, name.

    Numbering is by ranges: places within a range and the sizes of the ranges before, so no window has all rows in one task.
    """
    own = seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") >= least)
    return numbered(own, ["first", "seq"]).withColumn("name", F.concat(F.lit(prefix), F.when(F.length(F.col("number").cast("string")) < digits, F.lpad(F.col("number").cast("string"), digits, "0")).otherwise(F.col("number").cast("string"))))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Global row numbers from 1 in an order: a range sort that is written once, then each partition's offset from the counts of those before it (one small row each)."""
    checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    sizes = placed.groupBy("part_").agg((F.max("at_") + 1).alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part_", before.alias("start_"))
    return placed.join(F.broadcast(starts), "part_").withColumn(name, F.col("start_") + F.col("at_") + 1).drop("part_", "at_", "size_", "start_")


def without_overloaded(facts: DataFrame, most: int = 4, individual: str = "individual", protein: str = "protein") -> DataFrame:
    """Facts of the individuals with at most so many distinct proteins."""
    over = facts.groupBy(individual).agg(F.count_distinct(protein).alias("n_")).where(F.col("n_") > most)
    return facts.join(over, individual, "left_anti")


def joined_alleles(keys: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(individual, protein) with their allele, and the number of rows whose protein has none."""
    return keys.join(assignments, "protein"), keys.join(assignments, "protein", "left_anti").agg(F.count("*").alias("dropped"))


def copy_counts(facts: DataFrame) -> DataFrame:
    """individual, allele, n: distinct proteins of each."""
    return facts.groupBy("individual", "allele").agg(F.count_distinct("protein").alias("n"))


def wide(copies: DataFrame, alleles: list[str]) -> DataFrame:
    """The matrix of a sink: a column for each allele, zeros filled."""
    return copies.groupBy("individual").pivot("allele", sorted(alleles)).sum("n").fillna(0)


def genotypes(copies: DataFrame) -> DataFrame:
    """individual, n_alleles, n_proteins, genotype, zygosity, composition (``allele(n)+...`` by allele)."""
    rows = F.sort_array(F.collect_list(F.struct("allele", "n")))
    g = copies.groupBy("individual").agg(F.count("*").cast("int").alias("n_alleles"), F.sum("n").alias("n_proteins"), rows.alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: F.concat(x["allele"], F.lit("("), x["n"].cast("string"), F.lit(")"))), "+")
    return g.select("individual", "n_alleles", "n_proteins", labels.genotype_class(F.col("rows.n")).alias("genotype"), labels.zygosity("n_alleles").alias("zygosity"), text.alias("composition"))


def parsed_composition(df: DataFrame, column: str = "composition") -> DataFrame:
    """Back to long rows: individual, allele, n."""
    return df.select("individual", F.explode(labels.parsed_counts(column)).alias("x")).select("individual", F.col("x.key").alias("allele"), F.col("x.n").alias("n"))


def four_copies(copies: DataFrame) -> DataFrame:
    """individual, allele, n with four copies in all: one allele 4; two 3 + 1 or 2 + 2; three 2 + 1 + 1; more: the first four once. Ties by allele."""
    w = Window.partitionBy("individual")
    r = copies.withColumn("at", F.row_number().over(w.orderBy(F.desc("n"), "allele"))).withColumn("k", F.count("*").over(w)).withColumn("top", F.max("n").over(w))
    second = F.max(F.when(F.col("at") == 2, F.col("n"))).over(w)
    r = r.withColumn("second", second)
    n = (
        F.when(F.col("k") == 1, 4)
        .when(F.col("k") == 2, F.when(F.col("top") >= 2 * F.col("second"), F.when(F.col("at") == 1, 3).otherwise(1)).otherwise(2))
        .when(F.col("k") == 3, F.when(F.col("at") == 1, 2).otherwise(1))
        .otherwise(1)
    )
    return r.where("at <= 4").select("individual", "allele", n.cast("int").alias("n"))


def apportioned(counts: DataFrame, target: str = "target", key: str = "individual") -> DataFrame:
    """Largest remainder: whole counts in proportion to ``n`` that sum to the individual's target. Ties by allele."""
    w = Window.partitionBy(key)
    quota = F.col("n") * F.col(target) / F.sum("n").over(w)
    r = counts.withColumn("quota", quota).withColumn("low", F.floor("quota"))
    r = r.withColumn("left", F.col(target) - F.sum("low").over(w)).withColumn("at", F.row_number().over(w.orderBy(F.desc(F.round(F.col("quota") - F.col("low"), 9)), "allele")))
    return r.select(key, "allele", (F.col("low") + F.when(F.col("at") <= F.col("left"), 1).otherwise(0)).cast("int").alias("n")).where("n > 0")


def null_aware(copies: DataFrame, status: DataFrame) -> DataFrame:
    """individual, status, functional, null_copies, flag, composition, label: four copies of each genotyped individual with the null ones, and the self-compatible ones that were not genotyped, all null.

    ``status``: individual, status, confidence, copies (broken); an individual without one keeps its working copies.
    """
    have = copies.select("individual").distinct()
    t = have.join(status.select("individual", "status", "confidence", "copies"), "individual", "left").withColumn("t", labels.target_copies("status", "confidence", "copies")).select("individual", "status", "t.*")
    added = status.where("status = 'SC'").join(have, "individual", "left_anti").select("individual", "status", F.lit(0).alias("functional"), F.lit(4).alias("null_copies"), F.lit(labels.wording.FLAGS[-1]).alias("flag"))
    t = t.unionByName(added)
    own = apportioned(copies.join(t.select("individual", F.col("functional").alias("target")).where("target > 0"), "individual"))
    g = own.groupBy("individual").agg(F.sort_array(F.collect_list(F.struct("allele", "n"))).alias("rows"))
    out = t.join(g, "individual", "left")
    text = F.array_join(F.concat(F.transform(F.coalesce("rows", F.array().cast("array<struct<allele:string,n:int>>")), lambda x: F.concat(x["allele"], F.lit("("), x["n"].cast("string"), F.lit(")"))), F.when(F.col("null_copies") > 0, F.array(F.concat(F.lit("Allele_NULL("), F.col("null_copies").cast("string"), F.lit(")")))).otherwise(F.array().cast("array<string>"))), "+")
    return out.where("rows is not null or functional = 0").select("individual", "status", "functional", "null_copies", "flag", text.alias("composition"), labels.null_label(F.coalesce(F.col("rows.n"), F.array().cast("array<int>")), "null_copies").alias("label"))


def haplotype_status(logs: DataFrame) -> DataFrame:
    """individual, ok, removed, chimeric, total, status, confidence, copies, share: from logs (individual, state)."""
    c = logs.groupBy("individual").agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("OK", "ok"), ("REMOVED", "removed"), ("CHIMERIC", "chimeric"))])
    c = c.withColumn("total", F.col("ok") + F.col("removed"))
    s = labels.si_status("removed", "total")
    return c.withColumn("s", s).select("individual", "ok", "removed", "chimeric", "total", (F.col("removed") / F.col("total")).alias("share"), "s.status", "s.confidence", "s.copies")


def best_hits(hits: DataFrame, coverage: float = 0.90, identity: float = 95.0, order: str = "sseqid") -> DataFrame:
    """Queries whose best hit by bit score is long and alike enough. Of tied hits the first by ``order`` counts: the reference's id, or a column with the hit's place in its file."""
    best = hits.groupBy("qseqid").agg(F.min_by(F.struct("sseqid", "pident", "length", "qlen", "bitscore"), F.struct((-F.col("bitscore")).alias("b"), F.col(order).alias("o"))).alias("h"))
    return best.select("qseqid", "h.*").where((F.col("length") / F.col("qlen") >= coverage) & (F.col("pident") >= identity))


def top_reasons(reasons: DataFrame, k: int = 3) -> DataFrame:
    """individual and ``reason(n)`` of its k most frequent, first seen first on ties. ``reasons``: individual, reason, ord."""
    c = reasons.groupBy("individual", "reason").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    rows = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "ord", "reason"))), 1, k)
    return c.groupBy("individual").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["reason"], F.lit("("), (-x["m"]).cast("string"), F.lit(")"))), "; ").alias("reasons"))


def haplotype_sets(facts: DataFrame) -> DataFrame:
    """Older form: each individual's set of haplotypes as letters by first appearance within its contig."""
    w = Window.partitionBy("individual", "contig").orderBy("haplotype")
    at = F.row_number().over(w) - 1  # after Z come AA, AB, ...
    letter = F.concat(F.when(at >= 26, F.char((at / 26).cast("int") + 64)).otherwise(""), F.char(at % 26 + 65))
    rows = facts.select("individual", "contig", "haplotype").distinct().withColumn("letter", letter)
    return rows.groupBy("individual", "contig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.length("letter").alias("n"), "letter"))), lambda x: x["letter"]), "").alias("genotype"))


def dense_ids(df: DataFrame, column: str, prefix: str = "A") -> DataFrame:
    """Ids over the sorted distinct values."""
    ids = numbered(df.select(column).distinct(), [column])
    return df.join(ids, column).withColumn("dense_id", F.concat(F.lit(prefix), F.col("number").cast("string"))).drop("number")


def ingroup(facts: DataFrame, samples: DataFrame, prefix: str = "Library", exclude: str | None = None, key: str = "individual") -> DataFrame:
    """Facts of individuals with a name prefix that are listed as ingroup, without those of an outgroup prefix."""
    out = facts.where(F.col(key).startswith(prefix)).join(samples.where(F.col("ingroup") == "1").select(key), key, "left_semi")
    return out.where(~F.col(key).startswith(exclude)) if exclude else out


def checked_patterns(genotypes: DataFrame) -> DataFrame:
    """The rows, after a check that pattern and number of alleles agree; raises with an example where not. genotypes: individual, genotype, n_alleles."""
    kinds = F.when(F.col("genotype") == "AAAA", 1).when(F.col("genotype").isin("AAAB", "AABB"), 2).when(F.col("genotype") == "AABC", 3).when(F.col("genotype") == "ABCD", 4)
    bad = genotypes.where(~F.coalesce(F.least(F.col("n_alleles"), F.lit(4)) == kinds, F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"pattern and alleles disagree: {bad[0]}")
    return genotypes


def collapsed(seqs: DataFrame, key, name: str = "id") -> DataFrame:
    """Haplotypes with one key as one: key, n, representative (the first by name), members. Rows without a key are left out; ``key`` is a column expression such as ``sequence.region`` or ``sequence.translated_key``."""
    return seqs.select(key.alias("key"), name).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(name).alias("representative"), F.sort_array(F.collect_list(name)).alias("members"))


def with_references(haplotypes: DataFrame, references: DataFrame) -> DataFrame:
    """id, seq, is_reference: references and haplotypes in one table; of equal ids the reference stays."""
    own = haplotypes.join(references.select("id"), "id", "left_anti")
    return references.select("id", "seq", F.lit(True).alias("is_reference")).unionByName(own.select("id", "seq", F.lit(False).alias("is_reference")))
