"""Sample bookkeeping: audits, outcome categories, redo lists, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.functions import labels


def assigned_sites(samples: DataFrame, sites: DataFrame, raw: str = "pop", override: dict[str, str] | None = None) -> DataFrame:
    """Samples with site, status and the site's lineage and mean drift index. sites: lineage, site (may be a list with ``;`` or ``,``), drift; several rows for a site are averaged first."""
    one = sites.select("lineage", F.explode(F.transform(F.split("site", "[;,]"), lambda x: F.trim(x))).alias("site"), "drift").where("site <> ''")
    dim = one.groupBy("site").agg(F.min("lineage").alias("lineage"), F.avg("drift").alias("drift"))
    known = dim.agg(F.sort_array(F.collect_set("site")).alias("known"))  # a dimension of sites
    out = samples.crossJoin(F.broadcast(known)).withColumn("s", labels.site_status(raw, "known", override)).drop("known")
    out = out.withColumn("site", F.col("s.site")).withColumn("site_status", F.col("s.status")).drop("s")
    return out.join(dim, "site", "left").withColumn("lineage", F.coalesce("lineage", F.lit("Unassigned")))


def lineage_order(sites: DataFrame) -> DataFrame:
    """lineage, rank: by total area, then more places than groups, then name. sites: lineage, area, places."""
    g = sites.groupBy("lineage").agg(F.sum("area").alias("area"), (F.sum("places") - F.count("*")).alias("spread"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("area"), F.desc("spread"), "lineage")))  # a handful of lineages


def site_order(sites: DataFrame) -> DataFrame:
    """site, rank: by the lineage's rank, mean drift, name. A dimension table."""
    s = sites.groupBy("lineage", "site").agg(F.avg("drift").alias("drift")).join(lineage_order(sites), "lineage", "left")
    return s.select("site", F.row_number().over(Window.orderBy(F.asc_nulls_last("rank"), "drift", "site")).alias("site_rank"))


def split_samples(samples: DataFrame, genotyped: DataFrame, key: str = "individual") -> tuple[DataFrame, DataFrame]:
    """The samples with a genotype, and the genotypes without a sample."""
    return samples.join(genotyped, key, "left_semi"), genotyped.join(samples, key, "left_anti")


def first_match(facts: DataFrame, dimension: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first row of each key."""
    first = dimension.groupBy(key).agg(F.min_by(F.struct(*[c for c in dimension.columns if c != key]), order).alias("d"))
    return facts.join(first, key, "left").select(*facts.columns, *[F.col(f"d.{c}").alias(c) for c in dimension.columns if c != key])


def redo_list(redo: DataFrame, samples: DataFrame, key: str = "individual") -> DataFrame:
    """The redo list with the samples of too few data that it lacks; further columns are null there. Ordered by action, site and name."""
    more = samples.where("status = 'Insufficient_data'").join(redo, key, "left_anti")
    out = redo.unionByName(more.withColumn("action", F.lit("Re-sequence at higher depth")), allowMissingColumns=True)
    return out.orderBy(*[c for c in ("action", "site", key) if c in out.columns])


def failed_samples(copies_status: DataFrame, genotyped: DataFrame, key: str = "individual") -> DataFrame:
    """Samples whose copies are all broken and that have no genotype: four null copies."""
    return copies_status.where("status = 'SC'").join(genotyped, key, "left_anti").select(key, F.lit(4).alias("null_copies"))


def category_matrix(df: DataFrame, row: str, column: str, order: list[str]) -> DataFrame:
    """Counts and shares of each row by category, in a fixed order, zeros filled: long form."""
    grid = df.select(row).distinct().crossJoin(F.broadcast(df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], f"{column} string, place int")))  # levels
    n = grid.join(df.groupBy(row, column).agg(F.count("*").alias("n")), [row, column], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(row))
    return n.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def modes(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least on ties."""
    return df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n")).groupBy(group).agg(F.min_by(value, F.struct((-F.col("n")).alias("m"), value)).alias("mode"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands more than once."""
    return df.join(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1"), key)


def concordance(cells: DataFrame, group: str, others: list[str]) -> DataFrame:
    """For each column the dominant residue of each group, the consensus over groups, how many agree with it, and whether each of ``others`` has it."""
    c = cells.where("aa <> '-'").groupBy("pos", group, "aa").agg(F.count("*").alias("n"))
    d = c.groupBy("pos", group).agg(F.min_by("aa", F.struct((-F.col("n")).alias("m"), "aa")).alias("aa"))
    own = d.where(~F.col(group).isin(others)) if others else d
    v = own.groupBy("pos", "aa").agg(F.count("*").alias("n")).groupBy("pos").agg(F.min_by(F.struct("aa", "n"), F.struct((-F.col("n")).alias("m"), "aa")).alias("c"), F.sum("n").alias("groups"))
    out = v.select("pos", F.col("c.aa").alias("consensus"), F.col("c.n").alias("concordant"), "groups")
    for o in others:
        out = out.join(d.where(F.col(group) == o).select("pos", F.col("aa").alias("o_")), "pos", "left").withColumn(f"match_{o}", F.col("o_") == F.col("consensus")).drop("o_")
    return out
