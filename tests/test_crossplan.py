"""The cross plan against plain loops over all pairs."""

import itertools
import random

import pytest

from polyloom.operators import crossplan as cp


@pytest.fixture(scope="module", params=[1, 2, 3])
def world(spark, request):
    """Parents, alleles and distances, as tables and as plain Python."""
    r = random.Random(request.param)
    alleles = {f"al{i:02d}": ("C2" if i in (3, 11) else "C1", "Group_1" if i < 5 else "Group_2" if i < 8 else "Group_3" if i < 10 else "Isolated") for i in range(16)}
    parents = {}
    for k in range(90):
        n = r.choice([1, 1, 1, 2, 2, 3, 4])
        own = sorted(r.sample([a for a in alleles if a not in ("al12", "al13") or n > 1], n))
        counts = [r.randint(1, 4) for _ in own]
        kind = {1: "AAAA", 2: "AAAB" if max(counts) >= 2 * min(counts) else "AABB", 3: "AABC", 4: "ABCD"}[n]
        parents[f"p{k:03d}"] = (r.choice(["L1", "L2", None]), kind, list(zip(own, counts)))
    d = {}
    for a, b in itertools.combinations(sorted(alleles), 2):
        same = alleles[a][1] == alleles[b][1] != "Isolated"
        d[a, b] = 0.0 if same else r.choice([0.01, 0.03, 0.05, 0.1, 0.2, 0.35])
    tables = (
        spark.createDataFrame([(i, l_, g, [(a, n) for a, n in rows]) for i, (l_, g, rows) in parents.items()], "individual string, lineage string, genotype string, rows array<struct<allele:string,n:long>>"),
        spark.createDataFrame([(a, c, g) for a, (c, g) in alleles.items()], "allele string, cls string, grp string"),
        spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "a string, b string, d double"),
    )
    return tables, parents, alleles, d


def homs(parents):
    out = {}
    for i, (_, g, rows) in sorted(parents.items()):
        if g == "AAAA":
            out.setdefault(rows[0][0], []).append(i)
    return out


def apart(parents, i, j):
    a, b = parents[i][0], parents[j][0]
    return int(a is not None and b is not None and a != b)


def pick(parents, carriers, a, b):
    own = [(-apart(parents, m, f), m, f) for m in carriers.get(a, []) for f in carriers.get(b, []) if m != f]
    return min(own)[1:] if own else None


def rows(df):
    return [(r.mother, r.father, r.mother_allele, tuple(r.father_alleles)) for r in df.orderBy("priority").collect()]


def test_self_incompatibility(world):
    (p, a, d), parents, alleles, _ = world
    carriers = homs(parents)
    n = {x: len(carriers.get(x, [])) for x in alleles}
    groups = {}
    for x, (_, g) in alleles.items():
        if g != "Isolated":
            groups.setdefault(g, []).append(x)
    groups = {g: sorted(x, key=lambda y: (-n[y], y)) for g, x in groups.items()}
    want = []
    for x in groups["Group_1"][:8]:
        if len(want) < cp.SAME and (hit := pick(parents, carriers, x, x)):
            want.append((*hit, x, (x,)))
    for x, y in itertools.islice(((x, y) for x, y in itertools.combinations(groups["Group_1"], 2) if pick(parents, carriers, x, y)), cp.DIFFERENT):
        want.append((*pick(parents, carriers, x, y), x, (y,)))
    rest = []
    for g in sorted((g for g in groups if g != "Group_1"), key=lambda g: (-sum(n[x] for x in groups[g]), g)):
        own = [(*pick(parents, carriers, x, x), x, (x,)) for x in groups[g][:2] if n[x] >= 2]
        if len(own) < 2 and len(groups[g]) > 1 and (hit := pick(parents, carriers, *groups[g][:2])):
            own.append((*hit, groups[g][0], (groups[g][1],)))
        rest += own
    assert rows(cp.self_incompatibility(p, a)) == want + rest[: cp.OTHERS]


def test_within_class(world):
    (p, a, d), parents, alleles, dist = world
    own = [(i, rows_[0][0]) for i, (_, g, rows_) in sorted(parents.items()) if g == "AAAA"]
    pool = [(-dist[min(x, y), max(x, y)], i, j, x, y) for (i, x), (j, y) in itertools.combinations(own, 2) if x != y and alleles[x][0] == alleles[y][0] and dist[min(x, y), max(x, y)] >= 0.04]
    used, want = set(), []
    for _, i, j, x, y in sorted(pool):
        if len(want) < 4 and not {i, j} & used:
            used |= {i, j}
            want.append((i, j, x, (y,)))
    assert rows(cp.within_class(p, a, d, 4)) == want


def test_between_classes(world):
    (p, a, d), parents, alleles, _ = world
    first = [(i, rows_[0][0]) for i, (_, g, rows_) in sorted(parents.items()) if g == "AAAA" and alleles[rows_[0][0]][0] == "C1"]
    want = []
    fathers = sorted((min(x for x, _ in rows_ if alleles[x][0] == "C2"), i) for i, (_, g, rows_) in parents.items() if g != "AAAA" and any(alleles[x][0] == "C2" for x, _ in rows_))
    for _, f in fathers:
        has = [x for x, _ in parents[f][2]]
        own = [(-apart(parents, m, f), m, x) for m, x in first if x not in has]
        if own and len(want) < cp.BETWEEN:
            want.append((min(own)[1], f, min(own)[2], tuple(has)))
    assert rows(cp.between_classes(p, a)) == want


def test_synonymy(world):
    (p, a, d), parents, alleles, dist = world
    carriers = homs(parents)
    own = [(i, rows_[0][0]) for i, (_, g, rows_) in sorted(parents.items()) if g == "AAAA"]
    pool = []
    for (i, x), (j, y) in itertools.combinations(own, 2):
        near = 0 < dist.get((min(x, y), max(x, y)), 0) < 0.04
        if near and alleles[x][0] == alleles[y][0] and alleles[x][1] != alleles[y][1]:
            pool.append((-apart(parents, i, j), -(len(carriers[x]) + len(carriers[y])), i, j, x, y, tuple(sorted((alleles[x][1], alleles[y][1])))))
    done, used, want = set(), set(), []
    for again in (False, True):
        for _, _, i, j, x, y, g in sorted(pool):
            if g not in done and (again or not {i, j} & used):
                done.add(g)
                used |= {i, j}
                want.append((i, j, x, (y,)))
    assert rows(cp.synonymy(p, a, d)) == want


def test_hidden_alleles(world):
    (p, a, d), parents, alleles, dist = world
    carriers = homs(parents)
    want = []
    for h in sorted(x for x in alleles if x not in carriers):
        het = [(not (g == "AAAB" and dict(rows_)[h] == min(n for _, n in rows_)), i) for i, (_, g, rows_) in parents.items() if g != "AAAA" and h in dict(rows_)]
        if not het:
            continue
        f = min(het)[1]
        main = min((-n, x) for x, n in parents[f][2] if x != h)[1]
        own = [(-apart(parents, m, f), m, x) for x, ms in carriers.items() for m in ms if x not in (main, h) and alleles[x][0] == alleles[main][0] and dist[min(x, main), max(x, main)] >= 0.04]
        if not own:
            continue
        _, m, x = min(own)
        if main in carriers:
            want.append((m, carriers[main][0], x, (main,)))
        want.append((m, f, x, (main, h)))
    got = cp.hidden_alleles(p, a, d)
    assert rows(got) == want and {r.kind.split(" of ")[0] for r in got.collect()} <= {"control", "test"}


def test_whole_plan(world):
    (p, a, d), *_ = world
    assert cp.whole_plan(p, a, d).groupBy("hypothesis", "priority").count().where("count > 1").count() == 0
