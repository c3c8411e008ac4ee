"""The cross plan by hypothesis. Carriers of an allele stand for each other but for their lineage, so a few of each allele and lineage are all that a pick can need.

Tables: parents (individual, lineage, genotype, rows: array of struct(allele, n)); alleles (allele, cls, grp: ``Isolated`` or null where it has none); distances (a, b, d).
Every function returns hypothesis, priority, mother, father, mother_allele, father_alleles, category, d, kind. Ties are broken by individual.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.functions import labels
from polyloom.operators.breeding import plan

COLUMNS = "hypothesis string, priority int, mother string, father string, mother_allele string, father_alleles array<string>, category string, d double, kind string"
#: Crosses of each kind.
SAME, TRIED, DIFFERENT, OTHERS, EACH, FAR, BETWEEN = 5, 8, 8, 12, 2, 10, 5
NEAR = 0.04


def different_lineages(a: str | Column, b: str | Column) -> Column:
    """1 where both lineages are known and differ, else 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((a != b) & (a != "Unassigned") & (b != "Unassigned"), 1).otherwise(0)


def homozygotes(parents: DataFrame) -> DataFrame:
    """individual, lineage, allele of the plants with one allele."""
    return parents.where("genotype = 'AAAA'").select(F.col("individual").cast("string").alias("individual"), F.coalesce("lineage", F.lit("Unassigned")).alias("lineage"), F.get("rows", F.lit(0))["allele"].alias("allele"))


def first_carriers(own: DataFrame, k: int, by: tuple[str, ...] = ("allele", "lineage")) -> DataFrame:
    """The first k individuals of each allele and lineage."""
    return own.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy("individual"))).where(F.col("k_") <= k).drop("k_")


def both_ways(distances: DataFrame) -> DataFrame:
    return distances.select("a", "b", "d").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def pair_classes(parents: DataFrame, alleles: DataFrame, distances: DataFrame) -> DataFrame:
    """All pairs of AAAA plants, as classes: a <= b, lineage_a, lineage_b, pairs, d, category, pairing. Plants of one allele and lineage stand for each other; ``homozygotes`` has the members."""
    n = homozygotes(parents).groupBy("allele", "lineage").agg(F.count("*").alias("n")).join(alleles.select("allele", "cls"), "allele")
    side = lambda c: n.select(*[F.col(x).alias(f"{x}_{c}") for x in ("allele", "lineage", "cls", "n")])
    d = distances.select("a", "b", "d").unionByName(alleles.select(F.col("allele").alias("a"), F.col("allele").alias("b"), F.lit(0.0).alias("d")))
    p = d.join(side("a"), F.col("a") == F.col("allele_a")).join(side("b"), F.col("b") == F.col("allele_b")).where((F.col("a") != F.col("b")) | (F.col("lineage_a") <= F.col("lineage_b")))
    pairs = F.when((F.col("a") == F.col("b")) & (F.col("lineage_a") == F.col("lineage_b")), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("bigint")
    return p.select("a", "b", "lineage_a", "lineage_b", pairs.alias("pairs"), "d", labels.cross_category("cls_a", "cls_b", "d", NEAR).alias("category"), labels.pairing("lineage_a", "lineage_b").alias("pairing")).where("pairs > 0")


def best_pairs(wanted: DataFrame, few: DataFrame) -> DataFrame:
    """For each wanted pair of alleles (a, b) one pair of carriers, of different lineages where there are such: the wanted columns, mother, father. ``few``: at least the first two carriers of each allele and lineage."""
    m = few.select(F.col("allele").alias("a"), F.col("individual").alias("mother"), F.col("lineage").alias("lm"))
    f = few.select(F.col("allele").alias("b"), F.col("individual").alias("father"), F.col("lineage").alias("lf"))
    c = wanted.join(m, "a").join(f, "b").where("mother <> father")
    best = F.min_by(F.struct("mother", "father"), F.struct((-different_lineages("lm", "lf")).alias("s"), "mother", "father"))
    return c.groupBy(*wanted.columns).agg(best.alias("x")).select(*wanted.columns, "x.mother", "x.father")


def _rows(df: DataFrame, hypothesis: str, order: list, mother_allele, father_alleles, category, d, kind) -> DataFrame:
    """The plan's columns; priorities by ``order`` over the hypothesis's few rows."""
    at = F.row_number().over(Window.partitionBy(F.lit(hypothesis)).orderBy(*order))
    return df.select(F.lit(hypothesis).alias("hypothesis"), at.alias("priority"), F.col("mother").cast("string").alias("mother"), F.col("father").cast("string").alias("father"), mother_allele.alias("mother_allele"), father_alleles.alias("father_alleles"), category.alias("category"), d.cast("double").alias("d"), kind.alias("kind"))


def self_incompatibility(parents: DataFrame, alleles: DataFrame, first: str = "Group_1") -> DataFrame:
    """H0: crosses that must fail. Of the group ``first`` one allele with itself (its ``TRIED`` most common alleles, at most ``SAME`` crosses) and different alleles (``DIFFERENT``); of
    the others, most carriers first, the two most common alleles with themselves, or where fewer than ``EACH`` can be, the two with each other (``OTHERS`` in all)."""
    own = homozygotes(parents)
    few = first_carriers(own, 2)
    a = alleles.where("grp is not null and grp <> 'Isolated'").select("allele", "grp").join(own.groupBy("allele").agg(F.count("*").alias("n")), "allele", "left").fillna(0, ["n"])
    w = Window.partitionBy("grp")
    a = a.withColumn("at", F.row_number().over(w.orderBy(F.desc("n"), "allele"))).withColumn("total", F.sum("n").over(w))
    one = a.where(F.col("grp") == first)
    x, y = (one.where((F.col("n") > 0) & (F.col("at") <= DIFFERENT + 1)).select(F.col("allele").alias(c), F.col("at").alias("i" + c)) for c in "ab")
    zero = F.lit(0).cast("bigint")
    same = one.where(F.col("at") <= TRIED).select(F.lit("same allele").alias("kind"), F.lit(1).alias("block"), zero.alias("rank"), F.lit("").alias("grp"), "at", F.lit(0).alias("then"), F.col("allele").alias("a"), F.col("allele").alias("b"))
    other = x.join(y, F.col("ia") < F.col("ib")).select(F.lit("different alleles").alias("kind"), F.lit(2).alias("block"), zero.alias("rank"), F.lit("").alias("grp"), F.col("ia").alias("at"), F.col("ib").alias("then"), "a", "b")
    two = a.where((F.col("grp") != first) & (F.col("at") <= 2)).groupBy("grp", "total").agg(F.sort_array(F.collect_list(F.struct("at", "allele", "n"))).alias("r"))
    itself = F.filter("r", lambda z: z["n"] >= 2)
    pairs = F.transform(itself, lambda z: F.struct(z["at"].alias("at"), F.lit("same allele").alias("kind"), z["allele"].alias("a"), z["allele"].alias("b")))
    mixed = F.when((F.size(itself) < EACH) & (F.size("r") == 2), F.array(F.struct(F.lit(3).alias("at"), F.lit("different alleles").alias("kind"), F.get("r", F.lit(0))["allele"].alias("a"), F.get("r", F.lit(1))["allele"].alias("b")))).otherwise(F.array().cast("array<struct<at:int,kind:string,a:string,b:string>>"))
    rest = two.withColumn("p", F.explode(F.concat(pairs, mixed))).select("p.kind", F.lit(3).alias("block"), (-F.col("total")).alias("rank"), "grp", "p.at", F.lit(0).alias("then"), "p.a", "p.b")
    order = ["rank", "grp", "at", "then"]
    made = best_pairs(same.unionByName(other).unionByName(rest), few)
    made = made.withColumn("k_", F.row_number().over(Window.partitionBy("block").orderBy(*order))).where(F.col("k_") <= F.when(F.col("block") == 1, SAME).when(F.col("block") == 2, DIFFERENT).otherwise(OTHERS))
    return _rows(made, "H0", ["block", "k_"], F.col("a"), F.array("b"), F.lit("Incompatible"), F.lit(0.0), F.col("kind"))


def within_class(parents: DataFrame, alleles: DataFrame, distances: DataFrame, limit: int = FAR) -> DataFrame:
    """H1a: compatible crosses within a class, the most distant alleles first, each plant once."""
    own = first_carriers(homozygotes(parents).drop("lineage"), 2 * limit, ("allele",)).join(alleles.select("allele", "cls"), "allele")
    m = own.select(F.col("individual").alias("i"), F.col("allele").alias("a"), "cls")
    f = own.select(F.col("individual").alias("j"), F.col("allele").alias("b"), F.col("cls").alias("other"))
    c = m.join(both_ways(distances).where(F.col("d") >= NEAR), "a").join(f, "b").where("cls = other and i < j")
    c = c.select(F.lit("H1a").alias("hypothesis"), F.col("i").alias("mother"), F.col("j").alias("father"), "a", "b", "d")
    return _rows(plan(c, ["-d"], limit), "H1a", [F.desc("d"), "mother", "father"], F.col("a"), F.array("b"), F.lit("Compatible_within"), F.col("d"), F.lit("distant alleles"))


def between_classes(parents: DataFrame, alleles: DataFrame, limit: int = BETWEEN) -> DataFrame:
    """H1b: a plant with an allele of the smaller class as father, an AAAA plant of the larger class whose allele it lacks as mother, of another lineage where there is one.

    A father has at most three further alleles, so the first four alleles of each lineage hold a mother for it if any do.
    """
    size = alleles.groupBy("cls").agg(F.count("*").alias("k"))
    small = F.broadcast(size.orderBy(F.desc("k"), "cls").limit(1).withColumnRenamed("cls", "major"))  # one row
    second = alleles.crossJoin(small).where("cls <> major").select("allele")
    first = homozygotes(parents).join(alleles, "allele").crossJoin(small).where("cls = major").select("individual", "lineage", "allele")
    mothers = first_carriers(first_carriers(first, 1), 4, ("lineage",))
    het = parents.where("genotype in ('AAAB', 'AABB', 'AABC', 'ABCD')").select(F.col("individual").cast("string").alias("father"), F.coalesce("lineage", F.lit("Unassigned")).alias("lf"), F.col("rows.allele").alias("all"), F.explode("rows.allele").alias("allele"))
    fathers = het.join(second, "allele").groupBy("father", "lf", "all").agg(F.min("allele").alias("rare"))
    c = fathers.join(F.broadcast(mothers)).where(~F.array_contains("all", F.col("allele")))  # four mothers of each lineage
    best = F.min_by(F.struct(F.col("individual").alias("mother"), "allele"), F.struct((-different_lineages("lineage", "lf")).alias("s"), F.col("individual")))
    made = c.groupBy("father", "all", "rare").agg(best.alias("x")).orderBy("rare", "father").limit(limit)
    return _rows(made.select("father", "all", "rare", "x.mother", "x.allele"), "H1b", ["rare", "father"], F.col("allele"), F.col("all"), F.lit("Compatible_cross"), F.lit(None), F.lit("rare class"))


def synonymy(parents: DataFrame, alleles: DataFrame, distances: DataFrame) -> DataFrame:
    """H2: one cross for each pair of groups with near alleles of one class, of different lineages and with many carriers first; each plant once, and plants again where a pair of groups is left over.

    With P pairs of groups at most 2 P plants are ever used, so 2 P + 1 carriers of an allele and lineage are all that the scan can need.
    """
    own = homozygotes(parents)
    n = own.groupBy("allele").agg(F.count("*").alias("n"))
    g = alleles.select("allele", "cls", F.coalesce("grp", F.lit("Isolated")).alias("grp"))
    side = lambda c: g.join(n, "allele").select(F.col("allele").alias(c), F.col("cls").alias("c" + c), F.col("grp").alias("g" + c), F.col("n").alias("n" + c))
    near = distances.where((F.col("d") > 0) & (F.col("d") < NEAR)).join(side("a"), "a").join(side("b"), "b").where("ca = cb and ga <> gb")
    near = near.select("a", "b", "d", F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y"), (F.col("na") + F.col("nb")).alias("carriers"))
    pairs = near.select("x", "y").distinct().count()
    few = first_carriers(own, 2 * pairs + 1)
    i, j = (few.select(F.col("allele").alias(c), F.col("individual").alias("i" + c), F.col("lineage").alias("l" + c)) for c in "ab")
    c = near.join(i, "a").join(j, "b").select("x", "y", "d", "carriers", different_lineages("la", "lb").alias("between"), F.when(F.col("ia") < F.col("ib"), F.struct(F.col("ia").alias("m"), F.col("ib").alias("f"), F.col("a").alias("p"), F.col("b").alias("q"))).otherwise(F.struct(F.col("ib").alias("m"), F.col("ia").alias("f"), F.col("b").alias("p"), F.col("a").alias("q"))).alias("s"))
    c = c.select("x", "y", "d", "carriers", "between", F.col("s.m").alias("mother"), F.col("s.f").alias("father"), F.col("s.p").alias("ma"), F.col("s.q").alias("fa"))
    for parent in ("mother", "father"):
        w = Window.partitionBy("x", "y", parent).orderBy(F.desc("between"), F.desc("carriers"), "mother", "father")
        c = c.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= 2 * pairs + 1).drop("k_")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["between", "carriers", "mother", "father"], ascending=[False, False, True, True], kind="stable").reset_index(drop=True)
        done, used, out = set(), set(), []
        for again in (False, True):
            for row in t.itertuples():
                if (row.x, row.y) in done or (not again and (row.mother in used or row.father in used)):
                    continue
                done.add((row.x, row.y))
                used |= {row.mother, row.father}
                out.append((row.Index, again))
        return t.loc[[k for k, _ in out]].assign(at=range(len(out)), kind=["plants again" if x else "near alleles" for _, x in out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema) + ", at int, kind string"
    made = c.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(lambda t: run(t.drop(columns="all_")), schema)  # candidates of the pairs of groups, bounded by P
    return _rows(made, "H2", ["at"], F.col("ma"), F.array("fa"), F.lit("Synonymy_test"), F.col("d"), F.col("kind"))


def hidden_alleles(parents: DataFrame, alleles: DataFrame, distances: DataFrame) -> DataFrame:
    """H3: for each allele without an AAAA plant its first carrier as father (AAAB with the allele as the lesser one, else any other), an AAAA mother whose allele is of the class of the
    father's main allele and ``NEAR`` or more away from it, of another lineage where there is one, and before it a control: the same mother with an AAAA carrier of the main allele."""
    own = homozygotes(parents)
    few = first_carriers(own, 2)
    hidden = alleles.select("allele", "cls").join(own.select("allele").distinct(), "allele", "left_anti")
    het = parents.where("genotype in ('AAAB', 'AABB', 'AABC', 'ABCD')").select(F.col("individual").cast("string").alias("father"), F.coalesce("lineage", F.lit("Unassigned")).alias("lf"), "genotype", "rows", F.explode("rows").alias("x")).select("*", F.col("x.allele").alias("allele"), F.col("x.n").alias("n")).drop("x")
    minor = (F.col("genotype") == "AAAB") & (F.col("n") == F.array_min(F.col("rows.n")))
    others = F.filter("rows", lambda r: r["allele"] != F.col("allele"))
    main = F.element_at(F.sort_array(F.transform(others, lambda r: F.struct((-r["n"]).alias("k"), r["allele"].alias("allele")))), 1)["allele"]
    fathers = het.join(hidden, "allele").groupBy("allele", "cls").agg(F.min_by(F.struct("father", "lf", main.alias("main")), F.struct((~minor).alias("s"), "father")).alias("x")).select(F.col("allele").alias("hidden"), F.col("cls").alias("hc"), "x.*")
    cls = alleles.select("allele", "cls")
    m = few.join(cls, "allele").select(F.col("individual").alias("mother"), F.col("lineage").alias("lm"), F.col("allele").alias("b"), F.col("cls").alias("mc"))
    c = fathers.join(cls.select(F.col("allele").alias("main"), F.col("cls").alias("ac")), "main").join(both_ways(distances).where(F.col("d") >= NEAR).select(F.col("a").alias("main"), "b"), "main").join(m, "b").where("ac = mc and b <> hidden and mother <> father")
    best = F.min_by(F.struct("mother", "b", "mc"), F.struct((-different_lineages("lm", "lf")).alias("s"), "mother"))
    c = c.groupBy("hidden", "hc", "father", "main").agg(best.alias("x")).select("hidden", "hc", "father", "main", "x.*")
    c = c.join(both_ways(distances).select(F.col("a").alias("b"), F.col("b").alias("hidden"), F.col("d").alias("dh")), ["b", "hidden"], "left").join(both_ways(distances).select(F.col("a").alias("b"), F.col("b").alias("main"), F.col("d").alias("dm")), ["b", "main"])
    c = c.join(few.groupBy(F.col("allele").alias("main")).agg(F.min("individual").alias("control")), "main", "left")
    test = c.select("hidden", F.lit(2).alias("at"), "mother", "father", "b", F.array("main", "hidden").alias("fa"), F.when(F.col("mc") == F.col("hc"), "Compatible_within").otherwise("Compatible_cross").alias("category"), F.col("dh").alias("d"), F.lit("test").alias("kind"))
    control = c.where("control is not null").select("hidden", F.lit(1).alias("at"), "mother", F.col("control").alias("father"), "b", F.array("main").alias("fa"), F.lit("Compatible_within").alias("category"), F.col("dm").alias("d"), F.lit("control").alias("kind"))
    return _rows(control.unionByName(test), "H3", ["hidden", "at"], F.col("b"), F.col("fa"), F.col("category"), F.col("d"), F.concat("kind", F.lit(" of "), "hidden"))


def whole_plan(parents: DataFrame, alleles: DataFrame, distances: DataFrame, first: str = "Group_1") -> DataFrame:
    """All hypotheses."""
    parts = [self_incompatibility(parents, alleles, first), within_class(parents, alleles, distances), between_classes(parents, alleles), synonymy(parents, alleles, distances), hidden_alleles(parents, alleles, distances)]
    return reduce(DataFrame.unionByName, parts)
