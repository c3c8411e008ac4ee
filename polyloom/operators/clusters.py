"""Clusters of alleles: average linkage, graph components, trees. Alleles are a checked, small set; individuals never enter here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.operators.shared import checkpoint_dir

#: Alleles whose distances one task holds as a matrix (8 bytes a pair: 3.2 GB); more need a cluster method without all pairs.
MOST = 20_000


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Average or Ward's linkage by nearest-neighbour chains, in time and memory of n squared: rows (a, b, height, size), a < b, by height; clusters are numbered from n on in that order. NaN distances count as the mean."""
    n = len(d)
    d = np.array(d, float)
    if np.isnan(d).any():
        d[np.isnan(d)] = np.nanmean(d) if not np.isnan(d).all() else 0.0
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    alive = np.ones(n, bool)
    chain: list[int] = []
    merges = []  # two members, height
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            y = int(np.argmin(d[x]))
            if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
                y = chain[-2]
                break
            chain.append(y)
        del chain[-2:]
        i, j = sorted((x, y))
        merges.append((i, j, float(d[i, j])))
        if method == "ward":
            with np.errstate(invalid="ignore"):
                d[i] = np.sqrt(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * d[i, j] ** 2) / (size[i] + size[j] + size))
            d[i, ~alive] = np.inf
        else:
            d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    up, name, count = list(range(n)), list(range(n)), [1] * n

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for step, (i, j, h) in enumerate(sorted(merges, key=lambda m: (m[2], m[0], m[1]))):
        i, j = root(i), root(j)
        a, b = sorted((name[i], name[j]))
        count[i] += count[j]
        out.append((a, b, h, count[i]))
        up[j], name[i] = i, n + step
    return np.array(out, float).reshape(-1, 4)


def cut(tree: np.ndarray, n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels 1, 2, ... by first member, of so many clusters or of merges up to a height."""
    up = list(range(n + len(tree)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    keep = len(tree) - (max(1, clusters) - 1) if clusters is not None else int((tree[:, 2] <= height).sum()) if len(tree) else 0
    for k in range(keep):
        up[root(int(tree[k, 0]))] = n + k
        up[root(int(tree[k, 1]))] = n + k
    roots = [root(i) for i in range(n)]
    order = {r: i + 1 for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def largest_gap(heights: np.ndarray) -> float:
    """The middle of the largest gap between merge heights."""
    h = np.sort(heights)
    if len(h) < 2:
        return float(h[0]) if len(h) else 0.0
    i = int(np.argmax(np.diff(h)))
    return float((h[i] + h[i + 1]) / 2)


def _matrix(ids: list, t: pd.DataFrame) -> np.ndarray:
    at = {x: i for i, x in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.nan)
    i, j = t["a"].map(at).to_numpy(int), t["b"].map(at).to_numpy(int)
    d[i, j] = d[j, i] = t["d"].to_numpy(float)
    np.fill_diagonal(d, 0)
    return d


def average_linkage(distances: DataFrame) -> DataFrame:
    """step, left, right, height, size of the merges. distances: a < b, d; the number of alleles is checked in the task."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(t["a"]) | set(t["b"]))
        if len(ids) > MOST:
            raise ValueError(f"{len(ids)} alleles")
        tree = linkage(_matrix(ids, t))
        return pd.DataFrame({"step": np.arange(1, len(tree) + 1), "left": tree[:, 0].astype(int), "right": tree[:, 1].astype(int), "height": tree[:, 2], "size": tree[:, 3].astype(int)})

    return distances.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(run, "step int, left int, right int, height double, size int")


def clustered(distances: DataFrame, clusters: int | None = None, height: float | None = None, gap: bool = False, method: str = "average") -> DataFrame:
    """id, cluster (numbered by the smallest member)."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(t["a"]) | set(t["b"]))
        if len(ids) > MOST:
            raise ValueError(f"{len(ids)} alleles")
        tree = linkage(_matrix(ids, t), method)
        at = largest_gap(tree[:, 2]) if gap else height
        return pd.DataFrame({"id": ids, "cluster": cut(tree, len(ids), clusters, at)})

    return distances.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(run, "id string, cluster int")


def silhouettes(distances: DataFrame, members: DataFrame) -> DataFrame:
    """id, cluster, own (mean distance to its cluster's others), other (least mean distance to another cluster), silhouette: (other - own) / the larger; 0 for a cluster of one. members: id, cluster."""
    both = distances.select("a", "b", "d").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    m = members.select("id", "cluster")
    mean = both.join(m.select(F.col("id").alias("b"), F.col("cluster").alias("c")), "b").groupBy(F.col("a").alias("id"), "c").agg(F.avg("d").alias("mean"))
    x = m.join(mean, "id").groupBy("id", "cluster").agg(F.min(F.when(F.col("c") == F.col("cluster"), F.col("mean"))).alias("own"), F.min(F.when(F.col("c") != F.col("cluster"), F.col("mean"))).alias("other"))
    return x.withColumn("silhouette", F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).when(F.greatest("own", "other") == 0, 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other")))


def cluster_numbers(distances: DataFrame, most: int, method: str = "ward") -> DataFrame:
    """clusters (2 to ``most``), silhouette (mean over all ids), within (sum over clusters of the squared distances of their pairs over their size): for choosing a number by the best silhouette or the elbow."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(t["a"]) | set(t["b"]))
        if len(ids) > MOST:
            raise ValueError(f"{len(ids)} alleles")
        tree = linkage(_matrix(ids, t), method)
        return pd.DataFrame([(x, k, int(c)) for k in range(2, min(most, len(ids)) + 1) for x, c in zip(ids, cut(tree, len(ids), k), strict=True)], columns=["id", "k", "cluster"])

    cuts = distances.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(run, "id string, k int, cluster int")
    both = distances.select("a", "b", "d").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    p = both.join(cuts.select(F.col("id").alias("a"), "k", "cluster"), "a").join(cuts.select(F.col("id").alias("b"), "k", F.col("cluster").alias("c")), ["b", "k"])
    mean = p.groupBy("k", F.col("a").alias("id"), "cluster", "c").agg(F.avg("d").alias("mean"))
    x = mean.groupBy("k", "id", "cluster").agg(F.min(F.when(F.col("c") == F.col("cluster"), F.col("mean"))).alias("own"), F.min(F.when(F.col("c") != F.col("cluster"), F.col("mean"))).alias("other"))
    s = x.withColumn("s", F.when(F.col("own").isNull() | F.col("other").isNull() | (F.greatest("own", "other") == 0), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))).groupBy("k").agg(F.avg("s").alias("silhouette"))
    size = cuts.groupBy("k", "cluster").agg(F.count("*").alias("n"))
    w = p.where("cluster = c").groupBy("k", "cluster").agg((F.sum(F.col("d") ** 2) / 2).alias("ss")).join(size, ["k", "cluster"]).groupBy("k").agg(F.sum(F.col("ss") / F.col("n")).alias("within"))
    return s.join(w, "k", "left").select(F.col("k").alias("clusters"), "silhouette", F.coalesce("within", F.lit(0.0)).alias("within"))


def individual_classes(copies: DataFrame, classes: DataFrame) -> DataFrame:
    """individual, classes (sorted, of its alleles), n_alleles, n_classed (those whose class is known). classes: allele, cls."""
    c = copies.select("individual", "allele").distinct().join(classes.select("allele", "cls"), "allele", "left")
    return c.groupBy("individual").agg(F.array_join(F.sort_array(F.collect_set("cls")), "+").alias("classes"), F.count("*").alias("n_alleles"), F.count("cls").alias("n_classed"))


def clusters_by_threshold(merges: DataFrame, n: int, thresholds: list[float]) -> DataFrame:
    """threshold, clusters: n less the merges up to it (heights of average linkage never fall)."""
    t = merges.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    return t.join(merges, F.col("height") <= F.col("threshold"), "left").groupBy("threshold").agg((n - F.count("height")).alias("clusters"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches), by label steps and pointer jumps until nothing changes. edges: a, b; nodes: node."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = nodes.select("node", F.col("node").alias("root")).distinct().checkpoint()
    while True:
        least = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        new = now.join(least, "node", "left").select("node", F.least("root", F.coalesce("least", "root")).alias("root"))
        new = new.alias("x").join(now.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), F.col("root").alias("was")).checkpoint()
        changed = new.join(now.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        now = new.select("node", "root")
        if not changed:
            return now


def synonymy_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, group: components of two or more by size, then smallest member, as ``Group_1`` ...; others ``Isolated``. Few alleles."""
    c = components(edges, nodes)
    size = c.groupBy("root").agg(F.count("*").alias("size"))
    rank = size.where("size > 1").withColumn("k", F.row_number().over(Window.orderBy(F.desc("size"), "root")))
    return c.join(size, "root").join(rank.select("root", "k"), "root", "left").select("node", "size", F.when(F.col("k").isNull(), "Isolated").otherwise(F.concat(F.lit("Group_"), F.col("k").cast("string"))).alias("group"))


def group_links(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """x < y and the number of edges between two groups."""
    g = groups.where("group <> 'Isolated'").select("node", "group")
    e = edges.join(g.select(F.col("node").alias("a"), F.col("group").alias("ga")), "a").join(g.select(F.col("node").alias("b"), F.col("group").alias("gb")), "b").where("ga <> gb")
    return e.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.count("*").alias("bridges"))


def representatives(alleles: DataFrame, group: str = "group", weight: str = "carriers", name: str = "allele") -> DataFrame:
    """Of each group the allele with the most carriers, then by name."""
    return alleles.groupBy(group).agg(F.min_by(name, F.struct((-F.col(weight)).alias("w"), name)).alias("representative"))


def supported_clades(nodes: list[tuple], cutoff: float = 70.0) -> list[tuple[str, int]]:
    """Leaf and allele number: the deepest clades with support and no supported clade within; other leaves stand alone."""
    children: dict[int, list[int]] = {}
    for i, parent, *_ in nodes:
        if parent is not None:
            children.setdefault(parent, []).append(i)
    supported = {n[0] for n in nodes if n[0] in children and (n[4] or 0) >= cutoff}

    def leaves(i: int) -> list[str]:
        return [nodes[i][2]] if i not in children else [x for c in children[i] for x in leaves(c)]

    def inner(i: int) -> bool:
        return any(c in supported or inner(c) for c in children.get(i, []))

    own = [leaves(i) for i in sorted(supported) if not inner(i)]
    taken = {x for g in own for x in g}
    own += [[n[2]] for n in nodes if n[0] not in children and n[2] not in taken]
    return sorted((leaf, k + 1) for k, g in enumerate(sorted(own, key=min)) for leaf in g)


def class_split(nodes: list[tuple]) -> dict[str, str]:
    """Leaves by the longest inner branch: the smaller side is class I."""
    children: dict[int, list[int]] = {}
    for i, parent, *_ in nodes:
        if parent is not None:
            children.setdefault(parent, []).append(i)

    def leaves(i: int) -> list[str]:
        return [nodes[i][2]] if i not in children else [x for c in children[i] for x in leaves(c)]

    inner = [n for n in nodes if n[0] in children and n[1] is not None]
    whole = leaves(0)
    side = set(leaves(max(inner, key=lambda n: (n[3], -n[0]))[0])) if inner else set()
    small = side if len(side) <= len(whole) / 2 else set(whole) - side
    return {x: "I" if x in small else "II" for x in whole}


def presence_clusters(copies: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """individual, cluster, pc1, pc2: k-means and principal components of the presence of alleles, as sparse vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, CountVectorizer

    sets = copies.groupBy("individual").agg(F.sort_array(F.collect_set("allele")).alias("alleles"))
    sets = CountVectorizer(inputCol="alleles", outputCol="features", binary=True).fit(sets).transform(sets)
    k = k or max(2, int(sets.count() ** 0.5))
    out = KMeans(k=k, seed=seed, maxIter=20).fit(sets).transform(sets)
    out = PCA(k=2, inputCol="features", outputCol="pc").fit(out).transform(out)
    from pyspark.ml.functions import vector_to_array

    return out.select("individual", F.col("prediction").alias("cluster"), vector_to_array("pc")[0].alias("pc1"), vector_to_array("pc")[1].alias("pc2"))
