"""Regime operators over bars: absorption, divergence, churn, range, composite scores, and a Gaussian mixture."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.numeric import ratio, sigmoid
from fathomline.functions.windows import drop_halo, rows, sequenced


def block(bars: DataFrame, windows: tuple[int, ...], keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """For bars with ``price``, ``volume``, ``buy``, ``sell`` and each window of bars:

    absorption, volume over absolute price change; churn, (buy + sell) / |buy - sell|, 1 without volume; range position
    (0.5 for a flat range) and width over the price; divergence, price change less lambda times net flow, lambda being
    the slope of price changes on net flow over the longest window.
    """
    k, most = list(keys), max(windows)
    df = sequenced(bars, k, list(order), order[0], 2 * most + 1)
    net = F.col("buy") - F.col("sell")
    df = df.withColumn("_net", net).withColumn("_d", F.col("price") - F.lag("price").over(rows(k)))
    lw = rows(k, most - 1)
    var = F.var_pop(F.when(F.col("_d").isNotNull(), F.col("_net"))).over(lw)
    df = df.withColumn("regime_lambda", F.when(var > 1e-12, F.covar_pop("_d", F.when(F.col("_d").isNotNull(), F.col("_net"))).over(lw) / var).otherwise(0.0))
    for n in windows:
        w = rows(k, n - 1)
        change = F.col("price") - F.first("price").over(w)
        high, low = F.max("price").over(w), F.min("price").over(w)
        buy, sell = F.sum("buy").over(w), F.sum("sell").over(w)
        df = df.withColumns(
            {
                f"regime_absorption_{n}": F.sum("volume").over(w) / (F.abs(change) + 1e-3),
                f"regime_churn_{n}": F.when(buy + sell > 0, (buy + sell) / (F.abs(buy - sell) + 1e-10)).otherwise(1.0),
                f"regime_range_pos_{n}": F.when(high - low > 1e-10, (F.col("price") - low) / (high - low)).otherwise(0.5),
                f"regime_range_width_{n}": ratio(high - low, "price"),
                f"regime_divergence_{n}": change - F.col("regime_lambda") * F.sum("_net").over(w),
            }
        )
    return drop_halo(df).drop("_n", "_net", "_d")


def scores(absorption_z: Column, divergence_z: Column, churn_z: Column, range_pos: Column) -> tuple[Column, Column, Column]:
    """Accumulation, distribution and clarity: weighted sigmoids, weights 0.35, 0.30, 0.15 and 0.20."""
    base = 0.35 * sigmoid(absorption_z) + 0.15 * sigmoid(churn_z)
    up = base + 0.30 * sigmoid(divergence_z) + 0.20 * sigmoid((0.5 - range_pos) * 4)
    down = base + 0.30 * sigmoid(-divergence_z) + 0.20 * sigmoid((range_pos - 0.5) * 4)
    return up, down, F.abs(up - down)


def label(up: Column, down: Column, clarity: Column, least: float = 0.1) -> Column:
    return F.when(clarity < least, "UNCLEAR").when(up > down, "ACCUMULATION").otherwise("DISTRIBUTION")


class Mixture:
    """A Gaussian mixture applied as Column arithmetic: standardise, log density plus log weight, softmax."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.mean, self.scale, self.weights, self.means = mean, scale, weights, means
        self.precision = np.linalg.inv(covariances)
        self.offset = np.log(weights) - 0.5 * (np.linalg.slogdet(covariances)[1] + len(mean) * math.log(2 * math.pi))

    def probabilities(self, inputs: list[Column]) -> list[Column]:
        z = [(x - float(m)) / float(s) for x, m, s in zip(inputs, self.mean, self.scale)]
        logs = []
        for k in range(len(self.weights)):
            d = [x - float(m) for x, m in zip(z, self.means[k])]
            q = F.lit(0.0)
            for i in range(len(d)):
                for j in range(len(d)):
                    q = q + float(self.precision[k, i, j]) * d[i] * d[j]
            logs.append(F.lit(float(self.offset[k])) - 0.5 * q)
        top = F.greatest(*logs)
        e = [F.exp(x - top) for x in logs]
        total = sum(e[1:], e[0])
        return [x / total for x in e]


def fit_mixture(x: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> Mixture:
    """Expectation maximisation on a driver-side sample, seeded; 1e-6 is added to variances."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    means = z[rng.integers(len(z))][None]
    while len(means) < k:  # each next centre is the point farthest from those there are
        means = np.vstack((means, z[((z[:, None] - means) ** 2).sum(axis=2).min(axis=1).argmax()]))
    cov = np.stack([np.eye(z.shape[1])] * k)
    w = np.full(k, 1 / k)
    for _ in range(rounds):
        logs = np.stack([np.log(w[j]) - 0.5 * (np.linalg.slogdet(cov[j])[1] + np.einsum("ij,jk,ik->i", z - means[j], np.linalg.inv(cov[j]), z - means[j])) for j in range(k)], axis=1)
        r = np.exp(logs - logs.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0) + 1e-9
        w, means = n / n.sum(), (r.T @ z) / n[:, None]
        cov = np.stack([((z - means[j]) * r[:, j : j + 1]).T @ (z - means[j]) / n[j] + 1e-6 * np.eye(z.shape[1]) for j in range(k)])
    return Mixture(mean, scale, w, means, cov)


def fit_mixture_rows(df: DataFrame, columns: list[str], k: int, rounds: int = 30) -> Mixture:
    """``fit_mixture`` on all rows of ``df`` that have no null: a round sums up each partition's responsibilities, and the
    driver gets the sums of a mixture's numbers. Centres start at the smallest row and then at the farthest ones."""
    d, c = len(columns), [F.col(x).cast("double") for x in columns]
    rows = df.select(*[x.alias(f"x{i}") for i, x in enumerate(c)]).dropna()
    got = rows.agg(*[F.avg(f"x{i}") for i in range(d)], *[F.stddev_pop(f"x{i}") for i in range(d)]).first()
    mean, scale = np.array([x or 0.0 for x in got[:d]]), np.array([x if x and x > 1e-12 else 1.0 for x in got[d:]])
    z = rows.select(*[((F.col(f"x{i}") - float(mean[i])) / float(scale[i])).alias(f"z{i}") for i in range(d)]).persist()
    means = np.array([z.agg(F.min(F.struct("*"))).first()[0]], float)
    while len(means) < k:
        away = F.least(*[sum((F.pow(F.col(f"z{i}") - float(m[i]), F.lit(2)) for i in range(d)), F.lit(0.0)) for m in means], F.lit(float("inf")))
        means = np.vstack((means, np.array(z.agg(F.max_by(F.struct("*"), F.struct(away, F.struct("*")))).first()[0], float)))
    cov, w = np.stack([np.eye(d)] * k), np.full(k, 1 / k)
    for _ in range(rounds):

        def sums(batches, w=w, means=means, cov=cov):
            total = np.zeros((k, 1 + d + d * d))
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy() for i in range(d)])
                logs = np.stack([np.log(w[j]) - 0.5 * (np.linalg.slogdet(cov[j])[1] + np.einsum("ij,jk,ik->i", x - means[j], np.linalg.inv(cov[j]), x - means[j])) for j in range(k)], axis=1)
                r = np.exp(logs - logs.max(axis=1, keepdims=True))
                r /= r.sum(axis=1, keepdims=True)
                total += np.hstack((r.sum(axis=0)[:, None], r.T @ x, np.einsum("ij,ia,ib->jab", r, x, x).reshape(k, d * d)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "x"])

        flat = {r["i"]: r["x"] for r in z.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        total = np.array([flat[i] for i in range(k * (1 + d + d * d))]).reshape(k, -1)
        n = total[:, 0] + 1e-9
        w, means = n / n.sum(), total[:, 1 : 1 + d] / n[:, None]
        cov = np.stack([total[j, 1 + d :].reshape(d, d) / n[j] - np.outer(means[j], means[j]) + 1e-6 * np.eye(d) for j in range(k)])
    z.unpersist()
    return Mixture(mean, scale, w, means, cov)
