"""Statistics: correlations, information, false-discovery control, transitions, cross-sections, cluster quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import col, ratio


def average_rank(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """Average ranks within a key. Ties are counted first, so what is ranked in order are the different values.

    Without keys the values are ranked within 64 ranges between approximate quantiles, and the counts of lower ranges
    are added, so that no task ranks all of them.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    part = list(keys)
    if not keys:
        cuts = counts.approxQuantile(column, [i / 64 for i in range(1, 64)], 0.005)
        grain = sum(((F.col(column) > c).cast("int") for c in cuts), F.lit(0))
        counts, part = counts.withColumn("_grain", grain), ["_grain"]
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*part).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, below + (F.col("_c") + 1) / 2)
    if not keys:
        grains = counts.groupBy("_grain").agg(F.sum("_c").alias("_all"))  # 64 rows
        before = grains.withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("_grain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranks = ranks.join(F.broadcast(before), "_grain").withColumn(name, F.col(name) + F.col("_before")).drop("_grain", "_all", "_before")
    ranks = ranks.drop("_c")
    return df.join(ranks, [*keys, column], "left")


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation over a group, 0 where either doesn't vary."""
    both = F.when(col(x).isNotNull() & col(y).isNotNull(), 1)
    a, b = F.when(both == 1, col(x)), F.when(both == 1, col(y))
    d = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(d > 1e-15, F.covar_pop(a, b) / d).otherwise(0.0)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, ic, n): Pearson correlation of average ranks over rows with both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_rank(average_rank(both, x, keys, "_rx"), y, keys, "_ry")
    return ranked.groupBy(*keys).agg(pearson("_rx", "_ry").alias("ic"), F.count(F.lit(1)).alias("n"))


def t_statistic(r: Column, n: Column) -> Column:
    return F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))


def normal_p(z: Column) -> Column:
    """Two-sided p by the normal distribution, error below 1.5e-7 (no error function is built in)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    a, s = F.atanh(r), z / F.sqrt(n - 3)
    return F.tanh(a - s), F.tanh(a + s)


def benjamini_hochberg(df: DataFrame, p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """``q``: p * n / rank, made monotone from the largest p down, 1 at most. Null p are left out of n."""
    part = list(keys)
    n = F.count(p).over(Window.partitionBy(*part))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(p).asc_nulls_last()))
    raw = df.withColumn("_q", F.col(p) * n / rank).withColumn("_r", rank)
    q = F.min("_q").over(Window.partitionBy(*part).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("q", F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0)))).drop("_q", "_r")


def mutual_information(df: DataFrame, x: str, y: str, bins: int, keys: list[str]) -> DataFrame:
    """(keys, mi) in bits, from equal-width bins floor((v - min) / range * (bins - 1)). Counts of cells are what is shuffled."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = both.groupBy(*keys).agg(F.min(x).alias("_lx"), F.max(x).alias("_hx"), F.min(y).alias("_ly"), F.max(y).alias("_hy"))
    at = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * (bins - 1))).otherwise(0)
    cells = both.join(edges, keys).groupBy(*keys, at(x, "_lx", "_hx").alias("_bx"), at(y, "_ly", "_hy").alias("_by")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    over = lambda *cols: F.sum("_c").over(Window.partitionBy(*keys, *cols))
    c = cells.withColumns({"_n": over(), "_cx": over("_bx"), "_cy": over("_by")})
    return c.groupBy(*keys).agg(F.greatest(F.sum(F.col("_c") / F.col("_n") * F.log2(F.col("_c") * F.col("_n") / (F.col("_cx") * F.col("_cy")))), F.lit(0.0)).alias("mi"))


def transitions(df: DataFrame, keys: list[str], order: list, state: str) -> DataFrame:
    """(state, next, n, p): counts of a state's successors within a key, and their shares of the state's row."""
    after = F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))
    n = df.withColumn("next", after).where(F.col("next").isNotNull()).groupBy(F.col(state).alias("state"), "next").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def run_lengths(df: DataFrame, keys: list[str], order: list, state: str) -> DataFrame:
    """Mean and longest run of each state, and the number of runs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1)
    runs = df.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run", state).agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(state).agg(F.avg("len").alias("mean_run"), F.max("len").alias("longest_run"), F.count(F.lit(1)).alias("runs"))


def contingency(df: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """2 x 2 counts of two conditions, their chi-square (no correction) and lift P(b | a) / P(b)."""
    k = lambda c: F.count(F.when(c, 1)).cast("double")
    out = df.groupBy(*keys).agg(k(a & b).alias("n11"), k(a & ~b).alias("n10"), k(~a & b).alias("n01"), k(~a & ~b).alias("n00"))
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    chi = ratio(n * F.pow(n11 * n00 - n10 * n01, F.lit(2)), (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))
    return out.withColumn("chi2", chi).withColumn("lift", ratio(ratio(n11, n11 + n10), ratio(n11 + n01, n)))


def classification(df: DataFrame, predicted: Column, actual: Column, keys: list[str]) -> DataFrame:
    k = lambda c: F.count(F.when(c, 1)).cast("double")
    out = df.groupBy(*keys).agg(k(predicted & actual).alias("tp"), k(predicted & ~actual).alias("fp"), k(~predicted & ~actual).alias("tn"), k(~predicted & actual).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn), "baseline": ratio(tp + fn, tp + fp + tn + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("lift", ratio("precision", "baseline"))


def partial_correlation(x: str, y: str, z: str) -> Column:
    """Correlation of x and y over a group with z taken out."""
    a, b, c = pearson(x, y), pearson(x, z), pearson(y, z)
    return ratio(a - b * c, F.sqrt((1 - b * b) * (1 - c * c)))


def variance_ratio(df: DataFrame, q: int, keys: list[str], order: list, value: str = "ret") -> DataFrame:
    """Variance ratio of overlapping sums of ``q`` returns with the unbiased normaliser, for keys of bounded length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(value).over(Window.partitionBy(*keys))
    mu = F.avg(value).over(Window.partitionBy(*keys))
    d = df.withColumns({"_n": n, "_mu": mu, "_q": F.when(F.row_number().over(w) >= q, F.sum(value).over(w.rowsBetween(-(q - 1), 0)))})
    one = F.sum(F.pow(F.col(value) - F.col("_mu"), F.lit(2))) / (F.first("_n") - 1)
    m = q * (F.first("_n") - q + 1) * (1 - q / F.first("_n"))
    return d.groupBy(*keys).agg((F.sum(F.pow(F.col("_q") - q * F.col("_mu"), F.lit(2))) / m / one).alias("variance_ratio"), F.first("_n").alias("n"))


def turnover(df: DataFrame, keys: list[str], order: list, position: str) -> DataFrame:
    """Mean absolute change of position over twice its population deviation."""
    d = F.abs(F.col(position) - F.lag(position).over(Window.partitionBy(*keys).orderBy(*order)))
    return df.withColumn("_d", d).groupBy(*keys).agg(ratio(F.avg("_d"), 2 * F.stddev_pop(position)).alias("turnover"))


def moments(x: str, keys: list[str], df: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, bias-corrected skewness and excess kurtosis, 5th and 95th percentile, Sharpe."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_m"))
    d = F.col(x) - F.col("_m")
    s = df.join(mean, keys).groupBy(*keys).agg(
        F.count(x).cast("double").alias("n"), F.first("_m").alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"),
        F.avg(d * d).alias("_2"), F.avg(d * d * d).alias("_3"), F.avg(d * d * d * d).alias("_4"), F.percentile(x, F.lit(0.05)).alias("p5"), F.percentile(x, F.lit(0.95)).alias("p95"),
    )
    n = F.col("n")
    g1 = F.col("_3") / F.pow(F.col("_2"), F.lit(1.5))
    g2 = F.col("_4") / (F.col("_2") * F.col("_2")) - 3
    return s.withColumns(
        {
            "skew": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
            "sharpe": ratio("mean", "std"),
        }
    ).drop("_2", "_3", "_4")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H (no tie correction), eta squared, groups and rows, over one set of ranks."""
    ranked = average_rank(df.select(group, value), value, [], "_r")
    g = ranked.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_r").alias("s"))
    out = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    return out.select("n", "k", h.alias("h"), F.greatest((h - F.col("k") + 1) / (F.col("n") - F.col("k")), F.lit(0.0)).alias("eta2"))


def cluster_scores(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of labelled vectors (labels: few; centroids are a row for each)."""
    long = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    cent = long.groupBy(label, "i").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"))
    grand = long.groupBy("i").agg(F.avg("x").alias("g"))
    centroid = cent.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s.c).alias("c"), F.max("n").alias("n"))
    distance = F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    within = df.join(F.broadcast(centroid), label).withColumn("_d", distance).groupBy(label).agg(F.avg("_d").alias("s"), F.sum(F.col("_d") * F.col("_d")).alias("w"))
    between = cent.join(grand, "i").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), F.lit(2))).alias("b"))
    parts = centroid.join(within, label)
    a, b = (parts.select([F.col(c).alias(f"{p}{c}") for c in parts.columns]) for p in ("a_", "b_"))
    # Pairs of centroids: labels squared, not rows.
    apart = F.sqrt(F.aggregate(F.zip_with("a_c", "b_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    worst = a.join(b, F.col(f"a_{label}") != F.col(f"b_{label}")).groupBy(f"a_{label}").agg(F.max((F.col("a_s") + F.col("b_s")) / apart).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    k, n = F.count(F.lit(1)), F.sum("n")
    ch = parts.agg(k.cast("double").alias("k"), n.cast("double").alias("n"), F.sum("w").alias("w")).crossJoin(between)
    return ch.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz")).crossJoin(db)


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), 0.0
    for _ in range(6):
        out = out - 1 / x
        x = x + 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def ksg(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """k-nearest-neighbour mutual information in bits (Chebyshev distance), 0 at least, on a bounded sample."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    rng = np.random.default_rng(0)
    x, y = ((v - v.mean()) / (v.std() or 1) + 1e-10 * rng.standard_normal(n) for v in (np.asarray(x, float), np.asarray(y, float)))
    sx, sy, total = np.sort(x), np.sort(y), 0.0
    for i in range(0, n, 512):
        d = np.maximum(np.abs(x[i : i + 512, None] - x), np.abs(y[i : i + 512, None] - y))
        e = np.partition(d, k, axis=1)[:, k]
        nx = np.searchsorted(sx, x[i : i + 512] + e, "left") - np.searchsorted(sx, x[i : i + 512] - e, "right")
        ny = np.searchsorted(sy, y[i : i + 512] + e, "left") - np.searchsorted(sy, y[i : i + 512] - e, "right")
        total += (_digamma(np.maximum(nx, 1)) + _digamma(np.maximum(ny, 1))).sum()
    return float(max(0.0, (_digamma(np.array([k]))[0] + _digamma(np.array([n]))[0] - total / n) / math.log(2)))


def ksg_by_key(df: DataFrame, x: str, y: str, key: str, sample: int | None = None, nulls: int = 20) -> DataFrame:
    """``ksg`` for each key on all its rows, or on ``sample`` of them (those with the smallest hashes), z and p against
    seeded shuffles. Neighbours are exact, found in blocks, so that a key's rows take memory in proportion to their number."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(x, y), x, y)
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y).withColumn("_k", F.row_number().over(w)).where(F.lit(True) if sample is None else F.col("_k") <= sample)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        a, b = pdf[x].to_numpy(), pdf[y].to_numpy()
        value, rng = ksg(a, b), np.random.default_rng(7)
        null = np.array([ksg(a, rng.permutation(b)) for _ in range(nulls)])
        z = (value - null.mean()) / null.std() if null.std() > 0 else 0.0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mi": [value], "z": [float(z)], "p": [(1 + (null >= value).sum()) / (nulls + 1)]})

    return some.groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, mi double, z double, p double")


def least_information(fee: Column, sigma: Column, kurtosis: Column | None = None) -> Column:
    """Bits that a signal needs to pay a fee: -0.5 log2(1 - (fee / sigma)^2), times max(kurtosis, 3) / 3; infinite where the
    fee isn't below sigma."""
    bits = -0.5 * F.log2(1 - F.pow(fee / sigma, F.lit(2)))
    bits = bits if kurtosis is None else bits * F.greatest(kurtosis, F.lit(3.0)) / 3
    return F.when(fee >= sigma, F.lit(float("inf"))).otherwise(bits)
