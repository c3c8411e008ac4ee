"""Diversity, compatibility and fitness of groups, all from long copy counts by grouped aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.functions import labels


def allele_totals(copies: DataFrame, group: str) -> DataFrame:
    """group, allele, n (copies), p (their share), total."""
    t = copies.groupBy(group, "allele").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return t.withColumn("total", total).withColumn("p", F.col("n") / F.col("total"))


def diversity(totals: DataFrame, group: str) -> DataFrame:
    """Richness, effective number 1 / sum p^2, Shannon H (nats) and evenness J (null for one allele)."""
    h = -F.sum(F.col("p") * F.ln("p"))
    d = totals.groupBy(group).agg(F.count("*").alias("richness"), F.sum("n").alias("copies"), (1 / F.sum(F.col("p") ** 2)).alias("effective"), h.alias("shannon"))
    return d.withColumn("evenness", F.when(F.col("richness") > 1, F.col("shannon") / F.ln("richness")))


def population_summary(copies: DataFrame, members: DataFrame, group: str, top: int = 3) -> DataFrame:
    """group, n, n_with, richness, effective, share_het, mean_alleles, top alleles ``a(n); ...``. members: individual, group."""
    own = copies.join(members, "individual")
    each = own.groupBy(group, "individual").agg(F.count("*").alias("k"))
    people = members.groupBy(group).agg(F.count("*").alias("n"))
    counts = each.groupBy(group).agg(F.count("*").alias("n_with"), F.avg((F.col("k") > 1).cast("double")).alias("share_het"), F.avg("k").alias("mean_alleles"))
    totals = allele_totals(own, group)
    rows = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "allele"))), 1, top)
    best = totals.groupBy(group).agg(F.array_join(F.transform(rows, lambda x: F.concat(x["allele"], F.lit("("), (-x["m"]).cast("string"), F.lit(")"))), "; ").alias("top_alleles"))
    return people.join(counts, group, "left").join(diversity(totals, group).select(group, "richness", "effective"), group, "left").join(best, group, "left")


def null_aware_summary(copies: DataFrame, status: DataFrame, group: str) -> DataFrame:
    """group: n, counts of SI, pSI and SC, mean null copies, their share, effective number with nulls, share of heterozygotes among those with a working copy. copies: individual, group, allele, n with the allele NULL."""
    working = F.col("allele") != "NULL"
    each = copies.groupBy(group, "individual").agg(F.count_if(working).alias("k"), F.sum(F.when(~working, F.col("n")).otherwise(0)).alias("nulls"), F.sum("n").alias("all"))
    g = each.groupBy(group).agg(F.count("*").alias("n"), F.avg("nulls").alias("mean_null"), (F.sum("nulls") / F.sum("all")).alias("share_null"), (F.count_if(F.col("k") > 1) / F.count_if(F.col("k") > 0)).alias("share_het"))
    s = status.groupBy(group).agg(*[F.count_if(F.col("status") == x).alias("n_" + x.lower()) for x in ("SI", "pSI", "SC")])
    return g.join(s, group, "left").join(diversity(allele_totals(copies, group), group).select(group, "effective"), group)


def uniform_chi2(totals: DataFrame, group: str) -> DataFrame:
    """Chi-square of allele copies against equal shares: x2 and df."""
    e = F.col("copies") / F.col("richness")
    g = totals.groupBy(group).agg(F.sum("n").alias("copies"), F.count("*").alias("richness"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return g.select(group, (F.col("squares") / e - F.col("copies")).alias("x2"), (F.col("richness") - 1).alias("df"))


def compatibility(totals: DataFrame, group: str) -> DataFrame:
    """P = sum over ordered pairs (a, b) of p_a p_b (1 - p_a - [a <> b] p_b)^4, not below 0 in the bracket. Alleles of one group are paired, never individuals."""
    a = totals.select(group, F.col("allele").alias("a"), F.col("p").alias("pa"))
    b = totals.select(group, F.col("allele").alias("b"), F.col("p").alias("pb"))
    free = F.greatest(F.lit(0.0), 1 - F.col("pa") - F.when(F.col("a") != F.col("b"), F.col("pb")).otherwise(0.0))
    return a.join(b, group).groupBy(group).agg(F.sum(F.col("pa") * F.col("pb") * F.pow(free, F.lit(4))).alias("compatibility"))


def leakage_ladder(df: DataFrame, levels: tuple[float, ...] = (0.0, 0.10, 0.25, 0.50), value: str = "compatibility") -> DataFrame:
    """Each row at each leakage L: P + L (1 - P)."""
    return df.withColumn("leakage", F.explode(F.array(*map(F.lit, levels)))).withColumn("leaky", F.col(value) + F.col("leakage") * (1 - F.col(value)))


def estimated_leakage(share_aaaa: str | Column) -> Column:
    return (F.col(share_aaaa) if isinstance(share_aaaa, str) else share_aaaa) / 3.5


def uniform_benchmark(k: str | Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 8 / (F.col(k) if isinstance(k, str) else k))


def depletion(richness: str | Column, species: int = 59) -> Column:
    return 1 - (F.col(richness) if isinstance(richness, str) else richness) / species


def chao1(totals: DataFrame, group: str) -> DataFrame:
    """Estimated richness from alleles of one and two copies: estimate, se (where f2 > 0), ceiling."""
    g = totals.groupBy(group).agg(F.count("*").alias("s"), F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2"))
    r = F.col("f1") / F.col("f2")
    estimate = F.when(F.col("f2") > 0, F.col("s") + F.col("f1") ** 2 / (2 * F.col("f2"))).when(F.col("f1") > 0, F.col("s") + F.col("f1") * (F.col("f1") - 1) / 2).otherwise(F.col("s").cast("double"))
    se = F.when(F.col("f2") > 0, F.sqrt(F.col("f2") * (0.5 * r**2 + r**3 + 0.25 * r**4)))
    return g.select(group, "s", "f1", "f2", estimate.alias("chao1"), se.alias("se"), F.ceil(estimate).alias("chao1_ceiling"))


def rarefied_richness(carriers: DataFrame, group: str, n: int = 30) -> DataFrame:
    """Expected distinct alleles among n individuals, in closed form: sum of 1 - C(N - m, n) / C(N, n) over alleles with m carriers among N. All where N <= n.

    carriers: group, allele, carriers, people (of the group).
    """
    # C(N-m, n) / C(N, n) = product over i < n of (N - m - i) / (N - i)
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0.0), (F.col("people") - F.col("carriers") - i) / (F.col("people") - i)))
    seen = F.when(F.col("people") <= n, 1.0).otherwise(1 - miss)
    return carriers.groupBy(group).agg(F.sum(seen).alias("rarefied"))


def accumulation_curve(carriers: DataFrame, group: str, most: int = 400) -> DataFrame:
    """group, n, mean distinct alleles of n of its individuals, in closed form for every n up to N or ``most``."""
    sizes = carriers.select(group, "people").distinct().select(group, F.explode(F.sequence(F.lit(1), F.least("people", F.lit(most)).cast("int"))).alias("n"))
    logs = lambda x: F.expr(f"aggregate(sequence(0, n - 1), 0D, (a, i) -> a + ln({x} - i))")
    r = carriers.join(sizes, group).withColumn("gone", F.when(F.col("people") - F.col("carriers") < F.col("n"), 0.0).otherwise(F.exp(logs("(people - carriers)") - logs("people"))))
    return r.groupBy(group, "n").agg(F.sum(1 - F.col("gone")).alias("alleles"))


def ln_factorial(n: str | Column) -> Column:
    """Natural logarithm of n! of a whole number: a table below 20, Stirling's series (to 1e-12) from there."""
    x = (F.col(n) if isinstance(n, str) else n).cast("double")
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(x < 20, F.get(table, x.cast("int"))).otherwise(series)


def accumulation_spread(carriers: DataFrame, group: str, sizes: list[int]) -> DataFrame:
    """group, n, mean, sd: distinct alleles among n of a group's individuals drawn at random, exactly: no permutations.

    The variance is the sum over pairs of alleles of the probability that both are missed less the product of missing either, which needs how many
    individuals carry one or the other. An individual has few alleles, so its pairs are few. carriers: group, individual, allele, distinct.
    """
    own = carriers.select(group, "individual", "allele").distinct()
    people = own.groupBy(group).agg(F.count_distinct("individual").alias("people"))
    one = own.groupBy(group, "allele").agg(F.count("*").alias("m"))
    a, b = one.select(group, F.col("allele").alias("a"), F.col("m").alias("ma")), one.select(group, F.col("allele").alias("b"), F.col("m").alias("mb"))
    both = own.withColumnRenamed("allele", "a").join(own.withColumnRenamed("allele", "b"), [group, "individual"]).groupBy(group, "a", "b").agg(F.count("*").alias("k"))
    p = a.join(b, group).join(both, [group, "a", "b"], "left").withColumn("either", F.col("ma") + F.col("mb") - F.coalesce("k", F.lit(0)))  # pairs of a group's alleles
    p = p.groupBy(group, "ma", "mb", "either").agg(F.count("*").alias("times"), F.count_if(F.col("a") == F.col("b")).alias("same")).join(people, group).withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where("n <= people")
    lf = ln_factorial

    def missed(m: Column) -> Column:
        rest = F.col("people") - m - F.col("n")
        return F.when(rest < 0, 0.0).otherwise(F.exp(lf(F.col("people") - m) - lf(F.greatest(rest, F.lit(0))) - lf("people") + lf(F.col("people") - F.col("n"))))

    x, y, z = missed(F.col("ma")), missed(F.col("mb")), missed(F.col("either"))
    g = p.groupBy(group, "n").agg(F.sum(F.col("times") * (z - x * y)).alias("v"), F.sum(F.col("same") * (1 - x)).alias("mean"))
    return g.select(group, "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("v"))).alias("sd"))


def accumulation_slopes(curve: DataFrame, group: str, ends: int = 5) -> DataFrame:
    """Mean step of the first and last ``ends`` steps, and the late one as a share of the first."""
    w = Window.partitionBy(group).orderBy("n")
    s = curve.withColumn("step", F.col("alleles") - F.lag("alleles").over(w)).withColumn("last", F.max("n").over(Window.partitionBy(group)))
    g = s.groupBy(group).agg(F.avg(F.when(F.col("n") <= ends + 1, F.col("step"))).alias("initial_slope"), F.avg(F.when(F.col("n") > F.col("last") - ends, F.col("step"))).alias("final_slope"))
    return g.withColumn("late_share", F.col("final_slope") / F.col("initial_slope"))


def samples_to(top: str | Column, half: str | Column, target: str | Column) -> Column:
    """Individuals until the fitted curve top * n / (half + n) reaches a richness; null beyond its top."""
    t, h, x = (F.col(c) if isinstance(c, str) else c for c in (top, half, target))
    return F.when(x < t, F.ceil(h * x / (t - x)))


def frequencies_with_pool(copies: DataFrame, pool: DataFrame) -> DataFrame:
    """allele, p for every allele of the pool, zeros included."""
    t = copies.groupBy("allele").agg(F.sum("n").alias("n"))
    total = copies.agg(F.sum("n").alias("total"))
    return pool.join(t, "allele", "left").crossJoin(total).select("allele", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))  # one row of totals


def equilibrium_distance(freq: DataFrame, rare: float = 0.02, eps: float = 1e-12) -> DataFrame:
    """Variance of the shares, chi-square and Kullback-Leibler distance from equal shares, extinct and endangered alleles. freq: allele, p."""
    k = freq.agg(F.count("*").alias("k"))
    f = freq.crossJoin(k).withColumn("t", 1 / F.col("k"))  # one row
    return f.agg(
        F.var_pop("p").alias("variance"),
        F.sum((F.col("p") - F.col("t")) ** 2 / F.col("t")).alias("chi2"),
        F.sum((F.col("p") + eps) * F.ln((F.col("p") + eps) / F.col("t"))).alias("divergence"),
        F.count_if(F.col("p") == 0).alias("extinct"),
        F.count_if((F.col("p") > 0) & (F.col("p") < rare)).alias("endangered"),
    )


def copy_score(counts: str | Column) -> Column:
    """1 - sum n (n - 1) / 12 of the four copies."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return 1 - F.aggregate(c, F.lit(0.0), lambda a, n: a + n * (n - 1)) / 12


def null_aware_score(counts: str | Column) -> Column:
    """(1 - sum n (n - 1) / (N (N - 1))) N / 4 over working copies N; 0 for one or none."""
    c = F.col(counts) if isinstance(counts, str) else counts
    n = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.when(n <= 1, 0.0).otherwise((1 - F.aggregate(c, F.lit(0.0), lambda a, x: a + x * (x - 1)) / (n * (n - 1))) * n / 4)


def score_summary(individuals: DataFrame, group: str, score: str = "score", cls: str = "genotype") -> DataFrame:
    """n, mean, sd, se of the score; share and count of each class; status. A null score makes the group's mean null."""
    each = [F.count_if(F.col(cls) == c).alias("n_" + c) for c in ("AAAA", "AAAB", "AABB", "AABC", "ABCD")]
    whole = F.count(score) == F.count("*")
    g = individuals.groupBy(group).agg(F.count("*").alias("n"), F.when(whole, F.avg(score)).alias("mean_score"), F.when(whole, F.stddev_samp(score)).alias("sd_score"), *each)
    g = g.withColumn("se_score", F.col("sd_score") / F.sqrt("n"))
    for c in ("AAAA", "AAAB", "AABB", "AABC", "ABCD"):
        g = g.withColumn("share_" + c, F.col("n_" + c) / F.col("n"))
    return g.withColumn("status", labels.group_status("mean_score", "share_AAAA"))


def reproductive_support(individuals: DataFrame, group: str, score: str = "score", cls: str = "genotype") -> DataFrame:
    """Each group and each class, empty ones too: n, share of the group and of all, n with a score above 0."""
    classes = individuals.sparkSession.createDataFrame([(c,) for c in ("AAAA", "AAAB", "AABB", "AABC", "ABCD")], f"{cls} string")
    grid = individuals.select(group).distinct().crossJoin(F.broadcast(classes))  # five classes
    n = individuals.groupBy(group, cls).agg(F.count("*").alias("n"), F.count_if(F.col(score) > 0).alias("supporting"))
    n = grid.join(n, [group, cls], "left").fillna(0, ["n", "supporting"])
    total = n.agg(F.sum("n").alias("total"))
    return n.withColumn("share_of_group", F.col("n") / F.sum("n").over(Window.partitionBy(group))).crossJoin(F.broadcast(total)).withColumn("share_of_all", F.col("n") / F.col("total")).drop("total")


def pan_group_alleles(copies: DataFrame, group: str, share: float = 0.8) -> DataFrame:
    """Alleles that stand in at least ceil(share * groups) groups: allele, n_groups."""
    groups = copies.agg(F.ceil(share * F.count_distinct(group)).alias("need"))
    return copies.groupBy("allele").agg(F.count_distinct(group).alias("n_groups")).crossJoin(F.broadcast(groups)).where("n_groups >= need").select("allele", "n_groups")


#: Parts into which a group's pairs are dealt.
SALTS = 32


def individual_compatibility(genotypes: DataFrame, group: str, leakage: float = 0.0) -> DataFrame:
    """Share of ordered pairs of two individuals where the mother accepts a gamete of the father: one with no allele of hers. Below two individuals 0.

    Pairs are of distinct genotypes, weighted by how many individuals have each. genotypes: individual, group, alleles (four, sorted).
    """
    g = genotypes.groupBy(group, "alleles").agg(F.count("*").alias("w"))
    m = g.select(group, F.col("alleles").alias("mother"), F.col("w").alias("wm"), F.pmod(F.xxhash64("alleles"), F.lit(SALTS)).alias("salt"))  # a group's mothers in many parts
    f = g.select(group, F.col("alleles").alias("father"), F.col("w").alias("wf"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    free = F.size(F.filter("father", lambda a: ~F.array_contains(F.col("mother"), a))) >= 2
    pairs = m.join(f, [group, "salt"]).withColumn("weight", F.when(F.col("mother") == F.col("father"), F.col("wm") * (F.col("wf") - 1)).otherwise(F.col("wm") * F.col("wf")))
    p = pairs.groupBy(group).agg((F.sum(F.when(free, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("p"), F.sum("weight").alias("pairs"))
    return p.select(group, F.when(F.col("pairs") > 0, F.col("p") + leakage * (1 - F.col("p"))).otherwise(0.0).alias("compatibility"))


def effective_size(breeders: str | Column, mean_compatibility: str | Column) -> Column:
    b, c = (F.col(x) if isinstance(x, str) else x for x in (breeders, mean_compatibility))
    return F.greatest(F.lit(1.0), b * c)


def harmonic_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Of the values above 0."""
    return df.where(F.col(value) > 0).groupBy(group).agg((F.count("*") / F.sum(1 / F.col(value))).alias("harmonic_mean"))


def fitted_asymptotes(curve: DataFrame, group: str) -> DataFrame:
    """group, top, half, ceiling of the saturation curve fitted to (n, alleles) of each group; null where the fit fails. A curve is a few hundred points."""
    import pandas as pd

    from polyloom.functions.statistics import saturation_fit

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("n")
        top, half = saturation_fit(t["n"].to_numpy(), t["alleles"].to_numpy())
        ok = top == top
        return pd.DataFrame({group: [t[group].iloc[0]], "top": [top if ok else None], "half": [half if ok else None], "ceiling": [float(int(-(-top // 1))) if ok else None]})

    kind = curve.schema[group].dataType.simpleString()
    return curve.select(group, "n", "alleles").groupBy(group).applyInPandas(run, f"{group} {kind}, top double, half double, ceiling double")


def consensus_richness(*estimates: str) -> Column:
    """The mean of the estimates that are known, rounded up."""
    known = F.array_compact(F.array(*[F.col(e).cast("double") for e in estimates]))
    return F.when(F.size(known) > 0, F.ceil(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))
