"""Positional series and alignments: sliding windows, runs, entropy profiles, column maps, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.functions.sequence import RESIDUES, p_distance
from polyloom.operators.shared import running


def coverage_report(depth: DataFrame, contig: str = "contig", pos: str = "pos", value: str = "depth", size: int = 200, least: float = 20, even: float = 0.2) -> DataFrame:
    """contig, n, mean, median, window_min (least mean of a full window; the overall mean where there is none), uniformity = window_min / median, decision."""
    w = Window.partitionBy(contig).orderBy(pos)
    d = depth.withColumn("at", F.row_number().over(w)).withColumn("inner", F.avg(value).over(w.rowsBetween(-(size - 1), 0)))
    g = d.groupBy(contig).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(F.when(F.col("at") >= size, F.col("inner"))).alias("inner"))
    g = g.withColumn("window_min", F.when(F.col("n") <= size, F.col("mean")).otherwise(F.col("inner"))).withColumn("uniformity", F.when(F.col("median") != 0, F.col("window_min") / F.col("median")))
    drop = (F.col("mean") < least) | (F.coalesce("uniformity", F.lit(0.0)) < even)
    return g.select(contig, "n", "mean", "median", "window_min", "uniformity", F.when(drop, "DROP").otherwise("KEEP").alias("decision"))


def kept_contigs(depth: DataFrame, report: DataFrame, contig: str = "contig") -> DataFrame:
    return depth.join(report.where("decision = 'KEEP'"), contig, "left_semi")


def smoothed(series: DataFrame, group: str, pos: str, value: str, size: int = 20) -> DataFrame:
    """Moving mean over places -size/2 .. size/2 - 1, the ends mirrored (the outermost value repeats)."""
    before, after = size // 2, size - size // 2 - 1
    w = Window.partitionBy(group)
    s = series.select(group, pos, value).withColumn("at", F.row_number().over(w.orderBy(pos))).withColumn("n", F.count("*").over(w))
    left = s.where(F.col("at") <= before).select(group, pos, value, (1 - F.col("at")).alias("at"), "n")
    right = s.where(F.col("at") > F.col("n") - after).select(group, pos, value, (2 * F.col("n") + 1 - F.col("at")).alias("at"), "n")
    all_ = s.unionByName(left).unionByName(right)
    out = all_.withColumn("smooth", F.avg(value).over(w.orderBy("at").rowsBetween(-before, after)))
    return out.where((F.col("at") >= 1) & (F.col("at") <= F.col("n"))).select(group, pos, value, "smooth")


def islands(positions: DataFrame, group: str, pos: str, least: int = 1) -> DataFrame:
    """Runs of consecutive places: group, first, last, length."""
    key = F.col(pos) - F.row_number().over(Window.partitionBy(group).orderBy(pos))
    return positions.select(group, pos).distinct().withColumn("run", key).groupBy(group, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def high_runs(profile: DataFrame, group: str, pos: str, value: str, deviations: float = 1.0, least: int = 3) -> DataFrame:
    """Runs above the group's mean and population deviation."""
    t = profile.groupBy(group).agg((F.avg(value) + deviations * F.stddev_pop(value)).alias("threshold"))
    return islands(profile.join(t, group).where(F.col(value) > F.col("threshold")), group, pos, least)


def columns(aligned: DataFrame, key: str = "id", seq: str = "seq", first: int = 1, last: int | None = None) -> DataFrame:
    """Long form of aligned rows: key, pos (1-based), aa."""
    text = F.col(seq) if last is None else F.substring(seq, first, last - first + 1)
    return aligned.select(key, F.posexplode(F.split(text, "")).alias("pos", "aa")).where("aa <> ''").withColumn("pos", F.col("pos") + first)


def entropy_profile(cells: DataFrame, group: list[str] | None = None) -> DataFrame:
    """For each column: residues n, kinds k, Shannon entropy in bits, Wu-Kabat n k / n_max, over the twenty amino acids."""
    keys = [*(group or []), "pos"]
    c = cells.where(F.col("aa").isin(*RESIDUES)).groupBy(*keys, "aa").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    c = c.withColumn("n", total).withColumn("p", F.col("c") / F.col("n"))
    return c.groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("k"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (F.max("n") * F.count("*") / F.max("c")).alias("wu_kabat"))


def variable_columns(cells: DataFrame, most_gaps: float = 0.5, least: float = 0.0, top: int | None = None) -> DataFrame:
    """Columns with more than one residue (X aside), few gaps and enough entropy, by place; of more than ``top`` those with the highest entropy."""
    gaps = cells.groupBy("pos").agg(F.avg(F.when(F.col("aa") == "-", 1.0).otherwise(0.0)).alias("gap_share"))
    out = entropy_profile(cells).join(gaps, "pos").where((F.col("k") > 1) & (F.col("gap_share") <= most_gaps) & (F.col("entropy") > least))
    return (out.orderBy(F.desc("entropy"), "pos").limit(top) if top else out).orderBy("pos")


def composition(cells: DataFrame) -> DataFrame:
    """pos and ``A:3;C:10`` by residue."""
    c = cells.where("aa <> '-'").groupBy("pos", "aa").agg(F.count("*").alias("n"))
    return c.groupBy("pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("aa", "n"))), lambda x: F.concat_ws(":", x["aa"], x["n"].cast("string"))), ";").alias("composition"))


def pair_differences(cells: DataFrame) -> DataFrame:
    """For each column the share of pairs of rows that differ, gaps aside: (n^2 - sum c^2) / (n (n - 1)); no pair is formed."""
    c = cells.where("aa <> '-'").groupBy("pos", "aa").agg(F.count("*").alias("c"))
    g = c.groupBy("pos").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return g.select("pos", F.when(F.col("n") > 1, (F.col("n") * F.col("n") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("difference"))


def variable_cells(cells: DataFrame, skip: str = "X", key: str = "id") -> DataFrame:
    """id, pos, aa of the columns that hold more than one residue (those of ``skip`` do not count), in long form."""
    many = cells.where(~F.col("aa").isin(*skip)).groupBy("pos").agg(F.count_distinct("aa").alias("k")).where("k > 1").select("pos")
    return cells.join(many, "pos", "left_semi").select(key, "pos", "aa")


def alignment_map(cells: DataFrame, row: str, key: str = "id") -> DataFrame:
    """Columns of one row with the number of its residue there: pos, residue, aa."""
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one aligned row
    return cells.where(F.col(key) == row).withColumn("residue", F.sum(F.when(F.col("aa") != "-", 1).otherwise(0)).over(w)).where("aa <> '-'").select("pos", "residue", "aa")


def insertion_columns(cells: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Columns where all of ``rows`` have gaps."""
    return cells.join(rows, key, "left_semi").groupBy("pos").agg(F.bool_and(F.col("aa") == "-").alias("gap")).where("gap").select("pos")


#: Sequences that are compared with as many others in one group of a join.
BLOCK = 1000


def _blocks(df: DataFrame, n: int, key: str):
    """How many blocks, and each row's by a hash of its key."""
    q = max(1, -(-n // BLOCK))
    return q, df.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(q)).cast("int"))


def pairwise(seqs: DataFrame, skip: str = "-", empty: float | None = None) -> DataFrame:
    """a < b and their p-distance over all pairs of distinct alleles, as is asked for: of n there are n squared halves. Two blocks meet in one group, whatever n is."""
    q, own = _blocks(seqs.select("id", "seq"), seqs.count(), "id")
    a = own.select(F.col("id").alias("x"), F.col("seq").alias("sx"), F.col("block_").alias("i"), F.explode(F.sequence(F.col("block_"), F.lit(q - 1))).alias("j"))
    b = own.select(F.col("id").alias("y"), F.col("seq").alias("sy"), F.col("block_").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block_"))).alias("i"))
    pairs = a.join(b, ["i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), p_distance("sx", "sy", skip, empty).alias("d"))


def nearest(queries: DataFrame, references: DataFrame, skip: str = "-X", k: int = 2) -> DataFrame:
    """For each query its ``k`` nearest references (ties by name): query, at, reference, d. The k best of each block of references come first, then the k best of those."""
    n, r = _blocks(references.select(F.col("id").alias("reference"), F.col("seq").alias("sr")), references.count(), "reference")
    q = queries.select(F.col("id").alias("query"), F.col("seq").alias("sq"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block_"))
    d = q.join(r, "block_").select("query", "block_", F.struct(p_distance("sq", "sr", skip).alias("d"), "reference").alias("x")).where("x.d is not null")
    best = lambda x: F.slice(F.sort_array(x), 1, k)
    d = d.groupBy("query", "block_").agg(best(F.collect_list("x")).alias("x")).groupBy("query").agg(best(F.flatten(F.collect_list("x"))).alias("best"))
    return d.select("query", F.posexplode("best").alias("at", "x")).select("query", (F.col("at") + 1).alias("at"), "x.reference", "x.d")


def medoids(distances: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, id with the least mean distance to its cluster, itself included (ties by id). distances: a, b, d both ways or a < b."""
    both = distances.unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    m = members.select(F.col("id").alias("a"), "cluster")
    inner = both.join(m, "a").join(m.select(F.col("a").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other").groupBy("a", "cluster").agg(F.sum("d").alias("sum"))
    size = m.groupBy("cluster").agg(F.count("*").alias("size"))
    mean = m.join(inner, ["a", "cluster"], "left").join(size, "cluster").withColumn("mean", F.coalesce("sum", F.lit(0.0)) / F.col("size"))
    return mean.groupBy("cluster").agg(F.min_by("a", F.struct(F.round("mean", 12), "a")).alias("id"), F.min("mean").alias("mean"))


def least_threshold(df: DataFrame, x: str, passed: str, target: float = 0.9, least: int = 10) -> DataFrame:
    """The smallest x such that at least ``target`` of the rows at or above it pass, from ``least`` rows on. Rows are summed by value of x first, the sums run over a range sort."""
    g = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("k"))
    r = running(g, [F.desc(x)], "n", "n_above").select(x, (F.col("n_above") + F.col("n")).alias("all"))
    k = running(g, [F.desc(x)], "k", "k_above").select(x, (F.col("k_above") + F.col("k")).alias("good"))
    return r.join(k, x).where((F.col("all") >= least) & (F.col("good") >= target * F.col("all"))).agg(F.min(x).alias("threshold"))


def dose_response(df: DataFrame, bin_: str, value: str, passed: str) -> DataFrame:
    return df.groupBy(bin_).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("n_pass"), F.median(value).alias("median"), (100 * F.avg(F.col(passed).cast("double"))).alias("percent"))


def first_passage(tracks: DataFrame, keys: list[str], time: str, reached: Column) -> DataFrame:
    """The first time that a condition holds on each track; null where never."""
    return tracks.groupBy(*keys).agg(F.min(F.when(reached, F.col(time))).alias("time"))


def passage_quantiles(times: DataFrame, keys: list[str], horizon: int | None = None) -> DataFrame:
    """Quartiles of first passages; those that never come are dropped, or count as ``horizon`` + 1."""
    t = times if horizon is not None else times.where("time is not null")
    v = F.coalesce("time", F.lit(horizon + 1)) if horizon is not None else F.col("time")
    return t.groupBy(*keys).agg(*[F.percentile(v, q).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))], F.count("*").alias("n"))


def indexed_percentile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The sorted values' int(q * n)-th, not interpolated."""
    w = Window.partitionBy(group)
    r = df.withColumn("at", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    return r.where(F.col("at") == F.floor(F.lit(q) * F.col("n"))).select(group, F.col(value).alias("value"))


def first_of_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("at_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("at_") <= k).drop("at_")


def plateau(curve: DataFrame, x: str = "threshold", y: str = "clusters", half: int = 2) -> DataFrame:
    """Estimates from a curve of clusters by threshold: the flattest place (least centred mean of |step|, null at the edges), the knee (farthest from the chord) and the longest run within 3 clusters of the flattest place's."""
    w = Window.orderBy(x)  # a curve of about a hundred points
    c = curve.withColumn("step", F.abs(F.col(y) - F.lag(y).over(w))).withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    c = c.withColumn("flat", F.when((F.col("at") > half + 1) & (F.col("at") <= F.col("n") - half), F.avg("step").over(w.rowsBetween(-half, half))))
    ends = c.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.min(y).alias("y0"))
    c = c.crossJoin(ends).withColumn("chord", F.abs((F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0")) + (F.col(y) - F.col("y0")) / (F.col("y1") - F.col("y0")) - 1))
    best = c.agg(F.min_by(F.struct(x, y), F.struct(F.coalesce("flat", F.lit(float("inf"))), x)).alias("f"), F.max_by(F.struct(x, y), F.struct("chord", F.negative(F.col(x)))).alias("k"))
    near = c.crossJoin(best).where(F.abs(F.col(y) - F.col(f"f.{y}")) <= 3).withColumn("g", F.lit(1))
    run = islands(near, "g", "at").orderBy(F.desc("length"), "first").limit(1)
    return best.select(F.col(f"f.{x}").alias("flat_x"), F.col(f"f.{y}").alias("flat_y"), F.col(f"k.{x}").alias("knee_x"), F.col(f"k.{y}").alias("knee_y")).crossJoin(run.select(F.col("length").alias("run_length")))


def collapsed_entropy(cells: DataFrame, groups: DataFrame, key: str = "id") -> DataFrame:
    """Median entropy over columns with every row, and with one row for each group (its representative): whole, collapsed, delta. groups: id, representative."""
    kept = cells.join(groups.where(F.col(key) == F.col("representative")).select(key), key, "left_semi")
    whole, one = (entropy_profile(c).agg(F.median("entropy").alias(n)) for c, n in ((cells, "whole"), (kept, "collapsed")))
    return whole.crossJoin(one).withColumn("delta", F.col("collapsed") - F.col("whole"))  # one row each


def individual_distances(carried: DataFrame, distances: DataFrame) -> DataFrame:
    """a, b, d: the mean over the alleles of a of the least distance to an allele of b, allele pairs without a distance left out; not symmetric.

    carried: individual, allele of a chosen set of individuals; distances: a < b, d.
    """
    both = distances.unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    own = carried.select("allele").distinct().select(F.col("allele").alias("a"), F.col("allele").alias("b"), F.lit(0.0).alias("d"))
    x = carried.select(F.col("individual").alias("i"), F.col("allele").alias("a")).distinct().join(both.unionByName(own), "a")
    y = carried.select(F.col("individual").alias("j"), F.col("allele").alias("b")).distinct()
    least = x.join(y, "b").where("i <> j and d is not null").groupBy("i", "j", "a").agg(F.min("d").alias("d"))
    return least.groupBy(F.col("i").alias("a"), F.col("j").alias("b")).agg(F.avg("d").alias("d"))


def length_summary(df: DataFrame, group: str, length: str, low: int, high: int) -> DataFrame:
    """Sequences, median length, N50 and the numbers below, within and above a range."""
    from polyloom.sources.files import n50

    c = F.col(length)
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.median(length).alias("median"), F.count_if(c < low).alias("below"), F.count_if(c.between(low, high)).alias("within"), F.count_if(c > high).alias("above"))
    return g.join(n50(df, group, length), group)
