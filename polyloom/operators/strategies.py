"""Breeding strategies compared by seeded simulation. A population is an n x 4 array of allele codes and small enough to cross all with all; one trial is one row of the grid.

Per ordered pair all gametes are weighed: an egg is one of the mother's six pairs of copies, a pollen grain one of the father's, taken with
probability ``leakage`` where it has an allele of the mother and always otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.operators.breeding import on_simplex
from polyloom.operators.simulation import frequency_compatibility, seed_of

# Pairs of copies; share of elites and of children from mandatory crosses, carriers up to which an allele is endangered, weight of its
# loss, tries for each child, and the weight of an elite by class (AAAA, AAAB, others).
PAIRS = np.array([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])
ELITES, MANDATORY, ENDANGERED, PRESERVE, TRIES = 0.10, 0.15, 2, 10.0, 20
QUALITY = np.array([0.0, 0.5, 1.0, 1.0, 1.0])
STRATEGIES = ("random", "greedy", "optimised", "preservation", "gfs_preservation")


def equal_pairs(people: np.ndarray) -> np.ndarray:
    """Of the six pairs of copies those of one allele: 6 AAAA, 3 AAAB, 2 AABB, 1 AABC, 0 ABCD."""
    return (people[:, PAIRS[:, 0]] == people[:, PAIRS[:, 1]]).sum(1)


def tiers(people: np.ndarray) -> np.ndarray:
    """0 AAAA, 1 AAAB, 2 AABB, 3 AABC, 4 ABCD."""
    return np.array([4, 3, 2, 1, 0, 0, 0])[equal_pairs(people)]


def scores(people: np.ndarray) -> np.ndarray:
    """The share of gametes with two different alleles."""
    return 1 - equal_pairs(people) / 6


class Crosses:
    """All ordered pairs of different plants: how each pollen pair is taken, compatibility, the offspring's allele shares and mean score."""

    def __init__(self, people: np.ndarray, alleles: int, leakage: float):
        n = len(people)
        pollen = people[:, PAIRS]  # father, pair, copy
        mine = np.zeros((n, alleles), bool)
        mine[np.arange(n)[:, None], people] = True
        hit = mine[:, pollen].any(-1)  # mother, father, pair
        self.taken = np.where(hit, leakage, 1.0)
        self.taken[np.arange(n), np.arange(n)] = 0
        self.compatibility = self.taken.mean(2)
        own = np.zeros((n, alleles))
        np.add.at(own, (np.arange(n)[:, None], people), 0.25)
        mother, father = np.nonzero(self.compatibility > 0)
        self.mother, self.father = mother, father
        w = self.taken[mother, father]
        w = w / w.sum(1, keepdims=True)
        grain = np.zeros((len(mother), alleles))
        for k in range(6):
            for c in range(2):
                np.add.at(grain, (np.arange(len(mother)), pollen[father, k, c]), w[:, k] / 2)
        egg = own[mother]
        self.effect = (egg + grain) / 2
        same = equal_pairs(people)[mother] / 6 + (w * (pollen[father, :, 0] == pollen[father, :, 1])).sum(1) + 4 * (egg * grain).sum(1)
        self.score = 1 - same / 6
        self.people, self.pollen = people, pollen

    def carrying(self, i: int, allele: int) -> tuple[np.ndarray, np.ndarray]:
        """For plant i as mother and every other as father: the probability that a child has the allele (-1 where there is no child)."""
        egg = 1 - (self.people[i][PAIRS] == allele).any(1).mean()
        w = self.taken[i]
        total = w.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            without = (w * ~(self.pollen == allele).any(2)).sum(1) / total
        return np.where(total > 0, 1 - egg * np.nan_to_num(without), -1.0)


def child(r: np.random.Generator, c: Crosses, i: int, j: int) -> np.ndarray | None:
    w = c.taken[i, j]
    if w.sum() <= 0:
        return None
    return np.concatenate([c.people[i][PAIRS[r.integers(6)]], c.pollen[j, r.choice(6, p=w / w.sum())]])


def greedy_weights(effect: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Crosses by the deficits to equal shares times what their offspring have above them."""
    target = 1 / len(now)
    w = np.maximum(effect - target, 0) @ np.maximum(target - now, 0)
    return w / w.sum() if w.sum() > 0 else np.full(len(effect), 1 / len(effect))


def optimal_weights(effect: np.ndarray, rare: np.ndarray | None = None, score: np.ndarray | None = None, score_weight: float = 0.0, preserve: float = PRESERVE, steps: int = 300) -> np.ndarray:
    """Weights on the simplex with the least chi-square of the offspring's shares to equal ones, a penalty for ``rare`` alleles below them, and one for a low mean score. The objective is convex: projected gradient with a step that adapts."""
    target = 1 / effect.shape[1]
    rare = np.zeros(0, int) if rare is None else rare

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        share = w @ effect
        low = np.maximum(target - share[rare], 0)
        slope = 2 * (share - target) / target
        slope[rare] -= 2 * preserve * low
        v = ((share - target) ** 2 / target).sum() + preserve * (low**2).sum()
        g = effect @ slope
        if score is not None and score_weight:
            v += score_weight * (1 - w @ score)
            g = g - score_weight * score
        return float(v), g

    w = np.full(len(effect), 1 / len(effect))
    v, g = value(w)
    rate = 1.0
    for _ in range(steps):
        new = on_simplex(w - rate * g)
        nv, ng = value(new)
        if nv < v - 1e-13:
            w, v, g, rate = new, nv, ng, rate * 1.5
        else:
            rate /= 2
            if rate < 1e-9:
                break
    return w


def elite_plants(people: np.ndarray, p: np.ndarray, share: float = ELITES, by_class: bool = True) -> np.ndarray:
    """The best plants by the sum of 1 / share of their alleles, weighted by class."""
    s = (1 / np.maximum(p, 1e-12))[people].sum(1) * (QUALITY[tiers(people)] if by_class else 1.0)
    best = np.lexsort((-np.arange(len(people)), -s))[: max(1, int(share * len(people)))]
    return best[s[best] > 0]


def mandatory_crosses(people: np.ndarray, c: Crosses, covered: set[int], least_tier: int = 2) -> list[tuple[int, int]]:
    """For each allele with at most ``ENDANGERED`` carriers that is not covered yet: the carrier as mother and the partner of that class at least whose children have it most often."""
    carriers = {}
    for a in np.unique(people).tolist():
        own = np.flatnonzero((people == a).any(1))
        if len(own) <= ENDANGERED:
            carriers[a] = own
    able = tiers(people) >= least_tier
    out, done = [], set(covered)
    for a, own in sorted(carriers.items()):
        if a in done:
            continue
        best = (0.0, -1, -1)
        for i in own.tolist():
            chance = np.where(able, c.carrying(i, a), -1.0)
            j = int(chance.argmax())
            if chance[j] > best[0]:
                best = (float(chance[j]), i, j)
        if best[1] >= 0:
            _, i, j = best
            out.append((i, j))
            done |= set(people[i].tolist()) | set(c.pollen[j][c.taken[i, j] > 0].ravel().tolist())
    return out


def next_generation(r: np.random.Generator, people: np.ndarray, alleles: int, strategy: str, leakage: float, size: int | None = None, safety_net: bool = False) -> np.ndarray:
    """The next generation of ``size`` plants. Elites and mandatory crosses come first where the strategy preserves; the parents stay where fewer than two children can be made; with a safety net a carrier of each lost allele is added."""
    n, size = len(people), size or len(people)
    c = Crosses(people, alleles, leakage)
    p = np.bincount(people.ravel(), minlength=alleles) / people.size
    preserves = strategy.endswith("preservation")
    kids: list[np.ndarray] = []
    if preserves:
        best = elite_plants(people, p)
        kids += list(people[best])
        for i, j in mandatory_crosses(people, c, set(people[best].ravel().tolist()))[: max(1, int(size * MANDATORY))]:
            x = child(r, c, i, j) if len(kids) < size else None
            kids += [] if x is None else [x]
    if strategy == "random":
        pairs, w = None, None
    elif len(c.mother):
        rare = np.flatnonzero((p > 0) & (np.array([(people == a).any(1).sum() for a in range(alleles)]) <= ENDANGERED))
        w = greedy_weights(c.effect, p) if strategy == "greedy" else optimal_weights(c.effect, rare if preserves else None, c.score, 1.0 if strategy == "gfs_preservation" else 0.0)
        pairs = np.stack([c.mother, c.father], 1)
        w = w / w.sum()
    else:
        pairs, w = np.zeros((0, 2), int), None
    for _ in range(TRIES * size):
        if len(kids) >= size or n < 2 or (pairs is not None and not len(pairs)):
            break
        i, j = r.choice(n, 2, replace=False) if pairs is None else pairs[r.choice(len(pairs), p=w)]
        x = child(r, c, i, j)
        if x is not None:
            kids.append(x)
    if len(kids) < 2:
        return people
    out = np.array(kids)
    if safety_net and preserves:
        for a in np.setdiff1d(people, out):
            out = np.concatenate([out, people[[r.choice(np.flatnonzero((people == a).any(1)))]]])
    return out


def logistic_size(r: np.random.Generator, n: int, capacity: float, growth: float = 0.5) -> int:
    """The number of plants of the next generation: Poisson about the logistic expectation, two at least."""
    return max(2, int(r.poisson(max(2.0, n + growth * n * (1 - n / capacity)))))


def compare(plants: DataFrame, names: tuple[str, ...] = STRATEGIES, generations: int = 10, trials: int = 20, size: int = 40, seed: int = 5, leakage: float = 0.0, capacity: float | None = None) -> DataFrame:
    """strategy, trial, generation, plants, variance of shares, extinct alleles, evenness, compatibility (of all pairs), frequency_compatibility, mean_score, share_aaaa.

    plants: genotype (array of four), n. ``size`` founders are drawn from them; with a ``capacity`` sizes follow the logistic rule, else they stay.
    """
    rows = plants.groupBy(F.lit(1)).agg(F.sort_array(F.collect_list(F.struct("genotype", "n"))).alias("rows")).select("rows")  # distinct genotypes with counts
    own = rows.crossJoin(F.broadcast(plants.sparkSession.createDataFrame([(s,) for s in names], "strategy string"))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))

    def run(batches):
        for t in batches:
            for rows_, s, k in zip(t["rows"], t["strategy"], t["trial"], strict=True):
                r = np.random.default_rng(seed_of(seed, k))  # the same founders for every strategy
                known = sorted({a for x in rows_ for a in x["genotype"]})
                code = {a: i for i, a in enumerate(known)}
                n = np.array([x["n"] for x in rows_], float)
                all_ = np.array([[code[a] for a in x["genotype"]] for x in rows_])
                people = all_[r.choice(len(all_), size, p=n / n.sum())]
                r = np.random.default_rng(seed_of(seed, k, s))
                first = np.unique(people)
                out = []
                for g in range(generations + 1):
                    p = np.bincount(people.ravel(), minlength=len(known)) / people.size
                    own_ = p[first]
                    h = -(own_[own_ > 0] * np.log(own_[own_ > 0])).sum()
                    m = len(people)
                    fit = Crosses(people, len(known), leakage).compatibility.sum() / max(1, m * (m - 1))
                    out.append((s, k, g, m, float(own_.var()), int((own_ == 0).sum()), float(h / np.log(len(first))) if len(first) > 1 else 0.0, float(fit), frequency_compatibility(p), float(scores(people).mean()), float((tiers(people) == 0).mean())))
                    if g < generations:
                        people = next_generation(r, people, len(known), s, leakage, logistic_size(r, m, capacity) if capacity else None)
                yield pd.DataFrame(out, columns=["strategy", "trial", "generation", "plants", "variance", "extinct", "evenness", "compatibility", "frequency_compatibility", "mean_score", "share_aaaa"])

    return own.repartition("strategy", "trial").mapInPandas(run, "strategy string, trial int, generation int, plants int, variance double, extinct int, evenness double, compatibility double, frequency_compatibility double, mean_score double, share_aaaa double")


def collapse_times(runs: DataFrame, alleles_left: float = 0.75, compatible: float = 0.25) -> DataFrame:
    """strategy, trial, warning (the first generation with less than ``alleles_left`` of the founders' alleles), degraded (the first after the founders' with a compatibility below ``compatible``); null where never. runs: as ``compare`` returns, and n_alleles of the founders."""
    return runs.groupBy("strategy", "trial").agg(
        F.min(F.when(F.col("extinct") > (1 - alleles_left) * F.col("n_alleles"), F.col("generation"))).alias("warning"),
        F.min(F.when((F.col("generation") > 0) & (F.col("compatibility") < compatible), F.col("generation"))).alias("degraded"),
    )
