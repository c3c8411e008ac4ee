"""Distribution functions and tests in numpy, and their use on aggregated rows by pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyloom.operators.shared import running


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = k * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + k / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_p(x2: float, df: float) -> float:
    return upper_gamma(df / 2, x2 / 2) if df and df > 0 else float("nan")


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2 x 2 table: all tables at most as likely as it."""
    n, r, k = a + b + c + d, a + b, a + c
    log = lambda x: math.lgamma(x + 1)
    p = lambda x: math.exp(log(r) + log(n - r) + log(k) + log(n - k) - log(n) - log(x) - log(r - x) - log(k - x) - log(n - r - k + x))
    own = p(a)
    return min(1.0, sum(q for x in range(max(0, r + k - n), min(r, k) + 1) if (q := p(x)) <= own * (1 + 1e-7)))


def _ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average ranks of the distinct values (rows, ascending), from how often each sample (column) has them; and how often all have."""
    ties = counts.sum(1)
    ends = np.cumsum(ties)
    return (ends - ties + 1 + ends) / 2, ties


def mann_whitney_counts(counts: np.ndarray) -> tuple[float, float]:
    """U of the first of two samples and the two-sided p by the normal approximation, for ties and continuity corrected. counts: distinct values x 2."""
    rank, t = _ranked(counts)
    n, m = counts.sum(0)
    u = float(rank @ counts[:, 0]) - n * (n + 1) / 2
    sd = math.sqrt(n * m / 12 * (n + m + 1 - (t**3 - t).sum() / ((n + m) * (n + m - 1)))) if n + m > 1 else 0.0
    return float(u), 1.0 if sd == 0 else min(1.0, normal_p(max(0.0, abs(u - n * m / 2) - 0.5) / sd))


def kruskal_counts(counts: np.ndarray) -> tuple[float, float]:
    """H and p. counts: distinct values x samples."""
    rank, t = _ranked(counts)
    size = counts.sum(0)
    n = size.sum()
    h = 12 / (n * (n + 1)) * ((rank @ counts) ** 2 / size).sum() - 3 * (n + 1)
    tie = 1 - (t**3 - t).sum() / (n**3 - n)
    h = h / tie if tie > 0 else 0.0
    return float(h), chi2_p(h, counts.shape[1] - 1)


def counted(samples: list[np.ndarray]) -> np.ndarray:
    """How often each sample has each distinct value."""
    values = np.unique(np.concatenate(samples))
    return np.stack([np.bincount(np.searchsorted(values, s), minlength=len(values)) for s in samples], 1).astype(float)


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    return mann_whitney_counts(counted([x, y]))


def kruskal(groups: list[np.ndarray]) -> tuple[float, float]:
    return kruskal_counts(counted(groups))


def saturation_fit(n: np.ndarray, s: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Least-squares fit of s = top * n / (half + n) by damped Gauss-Newton; NaN where it fails."""
    n, s = np.asarray(n, float), np.asarray(s, float)
    if len(n) < 3 or not s.max() > 0:
        return float("nan"), float("nan")
    top, half, damp = s.max() * 1.2, max(n.mean() / 2, 1e-6), 1e-3
    loss = lambda a, b: ((s - a * n / (b + n)) ** 2).sum()
    now = loss(top, half)
    for _ in range(steps):
        j = np.stack([n / (half + n), -top * n / (half + n) ** 2], 1)
        r = s - top * n / (half + n)
        a = j.T @ j
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ r)
        new = loss(top + step[0], half + step[1])
        if half + step[1] > 0 and new <= now:
            top, half, damp = top + step[0], half + step[1], max(damp / 5, 1e-12)
            if now - new <= 1e-14 * max(now, 1e-300):
                break
            now = new
        else:
            damp *= 5
            if damp > 1e12:
                break
    return (float(top), float(half)) if np.isfinite(top) and top > 0 else (float("nan"), float("nan"))


# --- on DataFrames: counting is native, only the last step of a few rows is Python ---


def chi2_p_value(x2, df) -> Column:
    def run(x2: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x2, df, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(x2, df)


def fisher_p_value(a, b, c, d) -> Column:
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b, c, d)


def average_rank(df: DataFrame, value: str, group: str | None = None, name: str = "rank") -> DataFrame:
    """Average ranks (within a group): the first rank of a value and half its ties. Distinct values with their counts are what is sorted."""
    keys = [group] if group else []
    ties = df.groupBy(*keys, value).agg(F.count("*").alias("ties_"))
    if group:
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ties = ties.withColumn("before_", F.coalesce(F.sum("ties_").over(w), F.lit(0)))
    else:
        ties = running(ties, [value], "ties_", "before_")
    at = ties.withColumn(name, F.col("before_") + (F.col("ties_") + 1) / 2).drop("ties_", "before_")
    return df.join(at, [*keys, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho and n of two columns."""
    both = average_rank(average_rank(df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, name="rx_"), y, name="ry_")
    return both.agg(F.corr("rx_", "ry_").alias("rho"), F.count("*").alias("n"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Each cell of a two-way table: observed, expected, standardised residual."""
    n = df.groupBy(row, column).agg(F.count("*").alias("observed"))
    grid = n.select(row).distinct().crossJoin(n.select(column).distinct())  # levels of two labels, not rows
    n = grid.join(n, [row, column], "left").fillna(0, ["observed"])
    r, c, t = (F.sum("observed").over(Window.partitionBy(*k)) for k in ([row], [column], [F.lit(1)]))
    n = n.withColumn("expected", r * c / t).withColumn("residual", (F.col("observed") - F.col("expected")) / F.sqrt(F.col("expected") * (1 - r / t) * (1 - c / t)))
    return n


def contingency_test(cells: DataFrame, row: str, column: str) -> DataFrame:
    out = cells.agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("x2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("df"))
    return out.withColumn("p", chi2_p_value("x2", F.col("df").cast("double")))


def rank_tests(df: DataFrame, category: str, value: str, least: int = 2) -> DataFrame:
    """Kruskal-Wallis over all categories, and Mann-Whitney of each pair with ``least`` values or more: test, a, b, statistic, p.

    A frequency table of distinct values by category goes to the one task that computes the statistics; its size is the number of
    distinct values, not of rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(category).alias("c"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        wide = t.pivot_table(index="v", columns="c", values="n", aggfunc="sum", fill_value=0).sort_index()
        wide = wide[[c for c in sorted(wide.columns) if wide[c].sum() >= least]]
        n, names = wide.to_numpy(float), list(wide.columns)
        out = [("kruskal", None, None, *kruskal_counts(n[n.sum(1) > 0]))] if len(names) > 1 else []
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                two = n[:, [i, j]]
                out.append(("mann_whitney", a, names[j], *mann_whitney_counts(two[two.sum(1) > 0])))
        return pd.DataFrame(out, columns=["test", "a", "b", "statistic", "p"])

    return counts.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(run, "test string, a string, b string, statistic double, p double")
