"""Crosses: gametes, offspring, candidate pairs, plans. Genotypes are sorted arrays of four alleles; pairs are of genotypes or chosen parents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.operators.genotype import numbered

# The pairs of four copies, and the three ways to part four copies into two pairs.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
PARTITIONS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))


def _pair(g, i: int, j: int):
    return F.array_sort(F.array(F.get(g, F.lit(i)), F.get(g, F.lit(j))))


def gametes(df: DataFrame, genotype: str = "genotype", mode: str = "tetrasomic") -> DataFrame:
    """Each row's gametes (sorted pairs) with their probability.

    Tetrasomic: the six pairs alike. Disomic: the mean over the distinct partitions into two pairs of partners, where a gamete has one of each.
    """
    g = F.col(genotype)
    keys = df.columns
    if mode == "tetrasomic":
        rows = df.withColumn("gamete", F.explode(F.array(*[_pair(g, i, j) for i, j in PAIRS])))
        return rows.groupBy(*keys, "gamete").agg((F.count("*") / 6).alias("p"))
    kinds = F.array_distinct(F.array(*[F.array_sort(F.array(_pair(g, *a), _pair(g, *b))) for a, b in PARTITIONS]))
    rows = df.withColumn("kinds", F.size(kinds)).withColumn("kind", F.explode(kinds))
    four = F.array(*[F.array_sort(F.array(F.get(F.get(F.col("kind"), F.lit(0)), F.lit(i)), F.get(F.get(F.col("kind"), F.lit(1)), F.lit(j)))) for i in (0, 1) for j in (0, 1)])
    return rows.withColumn("gamete", F.explode(four)).groupBy(*keys, "gamete").agg(F.sum(1 / (4 * F.col("kinds"))).alias("p"))


def offspring(crosses: DataFrame, leakage: float = 0.0, mode: str = "tetrasomic") -> DataFrame:
    """cross, genotype, p (given that one is made), compatibility. crosses: cross, mother, father (arrays of four).

    A pollen gamete with an allele of the mother is accepted with probability ``leakage``, another one always.
    """
    m = gametes(crosses.select("cross", F.col("mother").alias("genotype")), mode=mode).select("cross", F.col("gamete").alias("egg"), F.col("p").alias("pm"))
    f = gametes(crosses.select("cross", "mother", F.col("father").alias("genotype")), mode=mode).select("cross", "mother", F.col("gamete").alias("pollen"), F.col("p").alias("pf"))
    f = f.withColumn("pf", F.col("pf") * F.when(F.arrays_overlap("pollen", "mother"), leakage).otherwise(1.0)).drop("mother")
    made = m.join(f, "cross").withColumn("genotype", F.array_sort(F.concat("egg", "pollen"))).groupBy("cross", "genotype").agg(F.sum(F.col("pm") * F.col("pf")).alias("q"))
    total = F.sum("q").over(Window.partitionBy("cross"))
    return made.withColumn("compatibility", total).where("compatibility > 0 and q > 0").select("cross", "genotype", (F.col("q") / F.col("compatibility")).alias("p"), "compatibility")


def crossing_matrix(genotypes: DataFrame, leakage: float = 0.0) -> DataFrame:
    """mother, father, compatibility of distinct genotypes; 0 for a genotype of one plant with itself. genotypes: a row for each plant."""
    g = genotypes.groupBy("genotype").agg(F.count("*").alias("plants"))
    pairs = g.select(F.col("genotype").alias("mother"), "plants").join(g.select(F.col("genotype").alias("father")))  # distinct genotypes only: a matrix is what is asked for
    f = gametes(pairs.withColumnRenamed("father", "genotype")).withColumn("ok", F.when(F.arrays_overlap("gamete", "mother"), leakage).otherwise(1.0))
    p = f.groupBy("mother", "plants", F.col("genotype").alias("father")).agg(F.sum(F.col("p") * F.col("ok")).alias("p"))
    return p.select("mother", "father", F.when((F.col("mother") == F.col("father")) & (F.col("plants") == 1), 0.0).otherwise(F.col("p")).alias("compatibility"))


def cross_weights(crosses: DataFrame, target: DataFrame) -> DataFrame:
    """cross, weight: sum over alleles of the deficit to the target times the expected share among the offspring. target: allele, p, target."""
    o = offspring(crosses).withColumn("allele", F.explode("genotype")).groupBy("cross", "allele").agg(F.sum(F.col("p") / 4).alias("share"))
    t = target.withColumn("deficit", F.greatest(F.col("target") - F.col("p"), F.lit(0.0))).withColumn("now", F.col("p")).drop("p")
    return o.join(t, "allele").groupBy("cross").agg(F.sum(F.col("deficit") * F.greatest(F.col("share") - F.col("now"), F.lit(0.0))).alias("weight"))


def rare_alleles(copies: DataFrame, carriers: int = 2, share: float = 0.02) -> DataFrame:
    total = copies.agg(F.sum("n").alias("total"))
    a = copies.groupBy("allele").agg(F.count_distinct("individual").alias("carriers"), F.sum("n").alias("n")).crossJoin(F.broadcast(total))  # one row
    return a.withColumn("p", F.col("n") / F.col("total")).where((F.col("carriers") <= carriers) | (F.col("p") < share)).select("allele", "carriers", "p")


def elites(copies: DataFrame, scores: DataFrame, share: float = 0.10) -> DataFrame:
    """The top share of individuals (one at least) by score times the sum of 1 / allele frequency, those with 0 left out; ties by individual. Places come from a range sort."""
    total = copies.agg(F.sum("n").alias("total"))
    p = copies.groupBy("allele").agg(F.sum("n").alias("a")).crossJoin(F.broadcast(total)).select("allele", (F.col("a") / F.col("total")).alias("p"))
    v = copies.select("individual", "allele").distinct().join(p, "allele").groupBy("individual").agg(F.sum(1 / F.col("p")).alias("rarity")).join(scores, "individual")
    v = numbered(v.select("individual", (F.col("score") * F.col("rarity")).alias("value")).withColumn("by_", -F.round("value", 9)), ["by_", "individual"], "place_")
    most = v.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("most_"))  # one row
    return v.crossJoin(F.broadcast(most)).where("place_ <= most_ and value > 0").select("individual", "value")


def homozygote_pairs(parents: DataFrame, distances: DataFrame, near: float = 0.04) -> DataFrame:
    """Pairs a < b of AAAA individuals with category by class and by their own alleles' distance. Alleles are paired, then carriers joined."""
    from polyloom.functions.labels import cross_category, pairing

    d = distances.unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    own = parents.select("allele").distinct().select(F.col("allele").alias("a"), F.col("allele").alias("b"), F.lit(0.0).alias("d"))
    d = d.unionByName(own)
    x = parents.select(F.col("individual").alias("i"), F.col("allele").alias("a"), F.col("cls").alias("ci"), F.col("lineage").alias("li"))
    y = parents.select(F.col("individual").alias("j"), F.col("allele").alias("b"), F.col("cls").alias("cj"), F.col("lineage").alias("lj"))
    p = x.join(d, "a").join(y, "b").where("i < j")
    return p.select("i", "j", "a", "b", "d", cross_category("ci", "cj", "d", near).alias("category"), pairing("li", "lj").alias("pairing"))


def rescue_options(fathers: DataFrame, mothers: DataFrame) -> DataFrame:
    """For each AABC father the number of AAAA mothers of another site whose allele it lacks: father, site, mothers. fathers: individual, site, alleles; mothers: individual, site, allele.

    Counted as all, less those of its site, less those of its alleles, and those of both once more; no father meets a mother.
    """
    n = mothers.groupBy("site", "allele").agg(F.count("*").alias("n"))
    total = mothers.agg(F.count("*").alias("total"))
    at = n.groupBy("site").agg(F.sum("n").alias("at_site"))
    of = n.groupBy("allele").agg(F.sum("n").alias("of_allele"))
    each = fathers.select(F.col("individual").alias("father"), "site", F.explode("alleles").alias("allele"))
    each = each.join(of, "allele", "left").join(n, ["site", "allele"], "left").groupBy("father", "site").agg(F.sum(F.coalesce("of_allele", F.lit(0)) - F.coalesce("n", F.lit(0))).alias("known"))
    return each.join(at, "site", "left").crossJoin(F.broadcast(total)).select("father", "site", (F.col("total") - F.coalesce("at_site", F.lit(0)) - F.col("known")).alias("mothers"))  # one row of totals


def rescue_crosses(fathers: DataFrame, mothers: DataFrame) -> DataFrame:
    """The same crosses themselves, mothers of one site and allele together: father, father_site, site, allele, n_mothers, first_mother. Fathers (AABC) and classes of mothers are paired, never plants."""
    m = mothers.groupBy(F.col("site").alias("mother_site"), "allele").agg(F.count("*").alias("n_mothers"), F.min("individual").alias("first_mother"))
    return fathers.select(F.col("individual").alias("father"), F.col("site").alias("father_site"), "alleles").join(m, (F.col("father_site") != F.col("mother_site")) & ~F.array_contains("alleles", F.col("allele"))).drop("alleles")


def shared_alleles(crosses: DataFrame, sets: DataFrame) -> DataFrame:
    """Observed crosses with the number of alleles that both parents have; null where a parent isn't known. sets: individual, alleles."""
    m, f = sets.select(F.col("individual").alias("mother"), F.col("alleles").alias("am")), sets.select(F.col("individual").alias("father"), F.col("alleles").alias("af"))
    return crosses.join(m, "mother", "left").join(f, "father", "left").withColumn("shared", F.when(F.col("am").isNotNull() & F.col("af").isNotNull(), F.size(F.array_intersect("am", "af")))).drop("am", "af")


def split_area(sites: DataFrame) -> DataFrame:
    """Area of rows with several sites (``;`` or ``,``) shared equally, summed by site."""
    s = sites.withColumn("list", F.filter(F.transform(F.split("sites", "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))
    return s.select(F.explode("list").alias("site"), (F.col("area") / F.size("list")).alias("area")).groupBy("site").agg(F.sum("area").alias("area"))


# --- plans: candidates are made and ranked in parallel; the scan that uses each parent once is serial by its nature ---


def greedy(candidates: pd.DataFrame, limit: int, reuse: bool = False, per: dict[str, int] | None = None) -> pd.DataFrame:
    """The first rows, in order, whose parents aren't used yet (or whose pair isn't, with ``reuse``), at most ``per[group]`` of a group."""
    used, pairs, count, keep = set(), set(), {}, []
    for row in candidates.itertuples():
        pair = frozenset((row.mother, row.father))
        if len(keep) >= limit or pair in pairs or len(pair) < 2 or (not reuse and (row.mother in used or row.father in used)):
            continue
        g = getattr(row, "group", None)
        if per is not None and count.get(g, 0) >= per.get(g, per.get("*", limit)):
            continue
        keep.append(row.Index)
        pairs.add(pair)
        used |= pair
        count[g] = count.get(g, 0) + 1
    return candidates.loc[keep]


def plan(candidates: DataFrame, order: list[str], limit: int, reuse: bool = False, per: dict[str, int] | None = None) -> DataFrame:
    """A cross plan by hypothesis: of each the greedy pick over its candidates in order.

    candidates: hypothesis, mother, father, group (where ``per`` is given) and the columns of ``order`` (``-name`` descending). A pick of ``limit``
    pairs uses 2 * limit parents at most, so a pair that it takes is among the first 2 * limit of its mother, and of its father (in its group):
    each keeps those beforehand, and what reaches the scan is bounded by parents and not by pairs.
    """
    keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order] + [F.asc("mother"), F.asc("father")]
    c = candidates
    for parent in ("mother", "father"):
        c = c.withColumn("at_", F.row_number().over(Window.partitionBy("hypothesis", parent, *(["group"] if per else [])).orderBy(*keys))).where(F.col("at_") <= 2 * limit).drop("at_")
    schema = c.schema

    def run(t: pd.DataFrame) -> pd.DataFrame:
        by, up = [x.lstrip("-") for x in order] + ["mother", "father"], [x[0] != "-" for x in order] + [True, True]
        return greedy(t.sort_values(by, ascending=up, kind="stable").reset_index(drop=True), limit, reuse, per)

    return c.groupBy("hypothesis").applyInPandas(run, schema)


def excluded_parents(crosses: DataFrame, excluded: DataFrame) -> DataFrame:
    """individual, crosses, as_mother, as_father, alleles: excluded individuals whose alleles a cross needs. crosses: cross, mother, father, alleles; excluded: individual, alleles."""
    c = crosses.select("cross", "mother", "father", F.explode("alleles").alias("allele"))
    e = excluded.select("individual", F.explode("alleles").alias("allele"))
    hit = c.join(e, "allele")
    return hit.groupBy("individual").agg(F.count_distinct("cross").alias("crosses"), F.count_if(F.col("mother") == F.col("individual")).alias("as_mother"), F.count_if(F.col("father") == F.col("individual")).alias("as_father"), F.array_join(F.array_sort(F.collect_set("allele")), ", ").alias("alleles"))


def plan_summary(plan_: DataFrame) -> DataFrame:
    """hypothesis, crosses, attempts and a TOTAL row."""
    return plan_.rollup("hypothesis").agg(F.count("*").alias("crosses"), F.sum("attempts").alias("attempts")).withColumn("hypothesis", F.coalesce("hypothesis", F.lit("TOTAL")))


def best_weights(effect: np.ndarray, now: np.ndarray, target: np.ndarray, score: np.ndarray, rare: float = 0.02, floor: float = 10.0, fitness: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of crosses (on the simplex) by projected gradient: chi-square of the mixed shares to the target, a penalty below ``rare``, less the mean score.

    effect: crosses x alleles, the shares among a cross's offspring.
    """
    w = np.full(len(effect), 1 / len(effect))
    t = np.maximum(target, 1e-9)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = (now + w @ effect) / 2
        low = np.maximum(rare - p, 0)
        v = ((p - t) ** 2 / t).sum() + floor * (low**2).sum() - fitness * (w @ score)
        g = effect @ ((p - t) / t - floor * low) - fitness * score
        return float(v), g

    v, g = value(w)
    rate = 1.0
    for _ in range(steps):
        new = on_simplex(w - rate * g)
        nv, ng = value(new)
        if nv < v - 1e-15:
            w, v, g, rate = new, nv, ng, rate * 1.5
        else:
            rate /= 2
            if rate < 1e-10:
                break
    return w, v


def on_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point with weights of at least 0 that sum to 1."""
    u = np.sort(x)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(x) + 1)
    return np.maximum(x - c[np.flatnonzero(u > c)[-1]], 0)
