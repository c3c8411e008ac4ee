"""Breeding strategies: gametes by enumeration, weights by plain search, elites and mandatory crosses by definition."""

import itertools

import numpy as np
import pytest

from polyloom.operators import strategies as st


def brute(mother, father, leakage):
    """Offspring of a pair by enumeration: genotype to probability, and compatibility."""
    out, total = {}, 0.0
    for e in itertools.combinations(mother, 2):
        for g in itertools.combinations(father, 2):
            w = leakage if set(g) & set(mother) else 1.0
            total += w / 36
            out[tuple(sorted(e + g))] = out.get(tuple(sorted(e + g)), 0) + w / 36
    return {k: v / total for k, v in out.items() if v} if total else {}, total


@pytest.mark.parametrize("leakage", [0.0, 0.2])
def test_crosses_equal_enumeration(leakage):
    r = np.random.default_rng(1)
    people = r.integers(0, 6, (9, 4))
    c = st.Crosses(people, 6, leakage)
    at = {(i, j): k for k, (i, j) in enumerate(zip(c.mother.tolist(), c.father.tolist(), strict=True))}
    for i, j in itertools.permutations(range(9), 2):
        kids, total = brute(people[i].tolist(), people[j].tolist(), leakage)
        assert c.compatibility[i, j] == pytest.approx(total)
        assert ((i, j) in at) == bool(kids)
        if kids:
            share = [sum(p * g.count(a) / 4 for g, p in kids.items()) for a in range(6)]
            assert c.effect[at[i, j]] == pytest.approx(share)
            assert c.score[at[i, j]] == pytest.approx(sum(p * st.scores(np.array([g]))[0] for g, p in kids.items()))
            for a in range(6):
                assert c.carrying(i, a)[j] == pytest.approx(sum(p for g, p in kids.items() if a in g))
        else:
            assert c.carrying(i, 0)[j] == -1


def test_tiers_and_scores():
    people = np.array([[1, 1, 1, 1], [1, 1, 1, 2], [1, 2, 1, 2], [1, 2, 3, 1], [1, 2, 3, 4]])
    assert st.tiers(people).tolist() == [0, 1, 2, 3, 4] and st.scores(people) == pytest.approx([0, 3 / 6, 4 / 6, 5 / 6, 1])


def test_weights():
    effect = np.array([[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5], [0.25, 0.25, 0.25, 0.25], [1, 0, 0, 0]])
    w = st.optimal_weights(effect)
    assert w.sum() == pytest.approx(1) and w @ effect == pytest.approx([0.25] * 4, abs=1e-3)
    low = st.optimal_weights(effect[[0, 3]], rare=np.array([1]))
    assert low[0] > st.optimal_weights(effect[[0, 3]])[0] - 1e-9
    g = st.greedy_weights(effect, np.array([0.7, 0.3, 0.0, 0.0]))
    assert g == pytest.approx([0, 1, 0, 0])
    best = st.optimal_weights(effect[:2], score=np.array([0.0, 1.0]), score_weight=100.0)
    assert best == pytest.approx([0, 1], abs=1e-6)


def test_elites_and_mandatory_crosses():
    people = np.array([[9, 9, 9, 9], [1, 1, 1, 8], [1, 2, 3, 4], [1, 2, 3, 3], [5, 5, 6, 6], [5, 6, 5, 6], [1, 2, 5, 5], [2, 3, 5, 6], [1, 3, 5, 6], [2, 2, 3, 3]])
    p = np.bincount(people.ravel(), minlength=10) / people.size
    s = [(1 / p[g]).sum() * st.QUALITY[t] for g, t in zip(people, st.tiers(people), strict=True)]
    assert st.elite_plants(people, p, 0.2).tolist() == sorted(range(10), key=lambda i: (-s[i], -i))[:2] and 0 not in st.elite_plants(people, p, 1.0)
    c = st.Crosses(people, 10, 0.0)
    pairs = st.mandatory_crosses(people, c, set())
    assert {i for i, _ in pairs} >= {0, 1, 2} and all(st.tiers(people)[j] >= 2 and c.compatibility[i, j] > 0 for i, j in pairs)
    assert not any(i == 0 for i, _ in st.mandatory_crosses(people, c, {9}))


def test_generations():
    r = np.random.default_rng(3)
    people = r.integers(0, 12, (14, 4))
    for name in st.STRATEGIES:
        new = st.next_generation(np.random.default_rng(1), people, 12, name, 0.0)
        assert new.shape == people.shape and set(new.ravel()) <= set(people.ravel())
    same = np.tile([1, 1, 2, 2], (5, 1))
    assert (st.next_generation(r, same, 3, "random", 0.0) == same).all()  # nothing is compatible: the parents stay
    assert set(st.next_generation(np.random.default_rng(2), people, 12, "preservation", 0.0, safety_net=True).ravel()) == set(people.ravel())
    sizes = [st.logistic_size(np.random.default_rng(i), 50, 100) for i in range(400)]
    assert np.mean(sizes) == pytest.approx(62.5, rel=0.03) and min(st.logistic_size(np.random.default_rng(i), 2, 1) for i in range(50)) >= 2


def test_compare_is_repeatable_and_starts_alike(spark):
    plants = spark.createDataFrame([([f"a{i}", f"a{(i * 7 + 1) % 15}", f"a{(i * 3 + 2) % 15}", f"a{(i * 5 + 3) % 15}"], 1 + i % 3) for i in range(15)], "genotype array<string>, n long")
    runs = [sorted(map(tuple, st.compare(plants.repartition(k), generations=2, trials=2, size=10).collect())) for k in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 5 * 2 * 3
    founders = {}
    for x in runs[0]:
        if x[2] == 0:
            founders.setdefault(x[1], set()).add(x[3:])
    assert all(len(x) == 1 for x in founders.values())
