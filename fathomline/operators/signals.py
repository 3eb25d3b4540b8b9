"""More signal algorithms of the ``algorithms`` contract, and fits that they use."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import ratio, sigmoid
from fathomline.operators.algorithms import Algorithm, Rolling, register


@register
class BipowerJump(Algorithm):
    """Realised and bipower variation of the last returns, and the share of the first that jumps make."""

    name, needs, makes, warmup = "bipower_jump", ("price",), ("rv", "bv", "jump_share"), 20
    window = 60

    def reset(self):
        super().reset()
        self._p, self._r = None, deque(maxlen=self.window)

    def update(self, tick):
        if self._p and tick["price"] > 0:
            self._r.append(math.log(tick["price"] / self._p))
        self._p = tick["price"]
        a = np.abs(np.fromiter(self._r, float))
        rv, bv = float((a * a).sum()), math.pi / 2 * float((a[1:] * a[:-1]).sum())
        return {"rv": rv, "bv": bv, "jump_share": max(0.0, 1 - bv / rv) if rv > 0 else 0.0}


@register
class StaggeredJump(Algorithm):
    """Like ``jump_detector`` with products of returns two apart, floored at a share of the mean absolute return squared."""

    name, needs, makes, warmup = "jump_detector_v2", ("price",), ("jump", "statistic"), 22
    window, k, floor = 20, 4.0, 0.1

    def reset(self):
        super().reset()
        self._p, self._r = None, deque(maxlen=self.window)

    def update(self, tick):
        r = math.log(tick["price"] / self._p) if self._p and tick["price"] > 0 else 0.0
        self._p = tick["price"]
        a = np.abs(np.fromiter(self._r, float))
        bv = math.pi / 2 * float((a[2:] * a[:-2]).mean()) if len(a) > 2 else 0.0
        bv = max(bv, self.floor * float(a.mean()) ** 2) if len(a) else 0.0
        s = r / math.sqrt(bv) if bv > 1e-18 else 0.0
        self._r.append(r)
        return {"jump": float(np.sign(s)) if abs(s) > self.k else 0.0, "statistic": s}


@register
class VpinRegime(Algorithm):
    """Toxic while VPIN is above its rolling percentile; imbalance gated by that, and its exponential momentum."""

    name, needs, makes, warmup = "vpin_regime", ("vpin", "imbalance"), ("toxic", "gated", "momentum"), 50
    window, quantile, span = 500, 80.0, 20

    def reset(self):
        super().reset()
        self._v, self._m = Rolling(self.window), 0.0

    def update(self, tick):
        self._v.push(tick["vpin"])
        toxic = float(tick["vpin"] > self._v.percentile(self.quantile))
        g = tick["imbalance"] * (1 - toxic)
        self._m += 2 / (self.span + 1) * (g - self._m)
        return {"toxic": toxic, "gated": g, "momentum": self._m}


@register
class ToxicVwapReversion(Algorithm):
    """Fades VWAP deviations only while VPIN is below its rolling percentile."""

    name, needs, makes, warmup = "toxic_vwap_reversion", ("vwap_deviation", "vpin"), ("signal",), 50
    window, threshold, quantile = 200, 2.0, 80.0

    def reset(self):
        super().reset()
        self._d, self._v = Rolling(self.window), Rolling(self.window)

    def update(self, tick):
        self._d.push(tick["vwap_deviation"])
        self._v.push(tick["vpin"])
        z = self._d.z(tick["vwap_deviation"], ddof=0)
        calm = tick["vpin"] <= self._v.percentile(self.quantile)
        return {"signal": -math.copysign(1.0, z) if calm and abs(z) > self.threshold else 0.0}


@register
class FundingSettlement(Algorithm):
    """-tanh(z of the premium) * exp(-distance to the settlement mark / scale)."""

    name, needs, makes, warmup = "funding_settlement", ("funding", "to_mark"), ("signal",), 30
    window, scale = 288, 3600.0

    def reset(self):
        super().reset()
        self._v = Rolling(self.window)

    def update(self, tick):
        self._v.push(tick["funding"])
        return {"signal": -math.tanh(self._v.z(tick["funding"])) * math.exp(-tick["to_mark"] / self.scale)}


@register
class Convolver(Algorithm):
    """Largest cosine similarity of the last candles of ticks, centred and scaled by their range, with fixed shapes."""

    name, needs, makes, warmup = "convolver", ("price",), ("similarity", "kernel"), 200
    ticks, length = 10, 16

    def reset(self):
        super().reset()
        self._bar, self._close, self._out = [], deque(maxlen=self.length), (0.0, -1.0)
        x = np.linspace(-1, 1, self.length)
        shapes = np.stack([x, -x, x * x - (x * x).mean(), -(x * x) + (x * x).mean(), np.sin(np.pi * x)])
        self._k = shapes / np.linalg.norm(shapes, axis=1, keepdims=True)

    def update(self, tick):
        self._bar.append(tick["price"])
        if len(self._bar) == self.ticks:
            self._close.append(self._bar[-1])
            self._bar = []
            if len(self._close) == self.length:
                c = np.fromiter(self._close, float)
                c = c - c.mean()
                n = np.linalg.norm(c)
                s = self._k @ (c / n) if n > 1e-12 else np.zeros(len(self._k))
                self._out = float(s.max()), float(s.argmax())
        return {"similarity": self._out[0], "kernel": self._out[1]}


@register
class KnnRetrieval(Algorithm):
    """Mean outcome of the k nearest past states, whitened by their shrunk covariance; an outcome is known ``horizon`` ticks
    later, and weights halve with age."""

    name, needs, makes, warmup = "knn_retrieval", ("imbalance", "entropy", "price"), ("expected", "agreement"), 100
    k, horizon, memory, refit, shrink, half_life = 10, 5, 400, 50, 0.1, 200.0

    def reset(self):
        super().reset()
        self._x, self._p, self._w = deque(maxlen=self.memory), deque(maxlen=self.memory), None

    def update(self, tick):
        self._x.append((tick["imbalance"], tick["entropy"]))
        self._p.append(tick["price"])
        n = len(self._x)
        if n < self.horizon + self.k + 2:
            return {"expected": 0.0, "agreement": 0.0}
        x, p = np.array(self._x), np.fromiter(self._p, float)
        if self._w is None or self.seen % self.refit == 0:
            c = np.cov(x.T)
            c = (1 - self.shrink) * c + self.shrink * np.trace(c) / 2 * np.eye(2) + 1e-9 * np.eye(2)
            self._w = np.linalg.inv(np.linalg.cholesky(c))
        known = n - self.horizon - 1
        d = (((x[:known] - x[-1]) @ self._w.T) ** 2).sum(axis=1)
        near = np.argsort(d, kind="stable")[: self.k]
        out = p[near + self.horizon] / p[near] - 1
        w = 0.5 ** ((n - 1 - near) / self.half_life)
        e = float((out * w).sum() / w.sum())
        return {"expected": e, "agreement": float(np.mean(np.sign(out) == np.sign(e)))}


@register
class CascadeProbability(Algorithm):
    """Online logistic regression on normalised features for a move beyond ``move`` within ``horizon`` ticks."""

    name, needs, makes, warmup = "cascade_probability", ("imbalance", "volatility", "price"), ("probability",), 100
    horizon, move, rate = 10, 0.02, 0.05

    def reset(self):
        super().reset()
        self._w, self._n, self._m, self._s = np.zeros(4), 0, np.zeros(2), np.ones(2) * 1e-6
        self._q = deque()

    def update(self, tick):
        v = np.array([tick["imbalance"], tick["volatility"]])
        self._n += 1
        d = v - self._m
        self._m = self._m + d / self._n
        self._s = self._s + d * (v - self._m)
        z = (v - self._m) / np.sqrt(self._s / max(self._n - 1, 1) + 1e-12)
        x = np.array([1.0, z[0], z[1], z[0] * z[1]])
        self._q.append((x, tick["price"]))
        if len(self._q) > self.horizon:
            old, p = self._q.popleft()
            y = float(abs(tick["price"] / p - 1) > self.move)
            self._w = self._w + self.rate * (y - 1 / (1 + math.exp(-float(np.clip(self._w @ old, -30, 30))))) * np.clip(old, -10, 10)
        return {"probability": 1 / (1 + math.exp(-float(np.clip(self._w @ x, -30, 30))))}


def fit_logistic(df: DataFrame, features: list[str], label: str):
    """Spark's logistic regression on standardised columns: (weights by column, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("label")))
    m = LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.01).fit(d)
    return dict(zip(features, m.coefficients.toArray().tolist())), float(m.intercept)


def continuation(weights: dict[str, float], intercept: float, gate: Column) -> Column:
    """Probability of a fitted model, 0.5 where the gate is closed: JVM arithmetic, no model object on the executors."""
    score = F.lit(intercept)
    for c, w in weights.items():
        score = score + w * F.col(c)
    return F.when(gate, sigmoid(score)).otherwise(0.5)


def ou_fit(df: DataFrame, value: str, keys: list[str], order: list, dt: float = 1.0) -> DataFrame:
    """Mean-reversion rate, level and deviation from the regression of a value on the one before."""
    d = df.withColumn("_l", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_l").isNotNull())
    s = d.groupBy(*keys).agg(F.regr_slope(value, "_l").alias("b"), F.regr_intercept(value, "_l").alias("a"), F.regr_sxx(value, "_l").alias("_x"), F.regr_syy(value, "_l").alias("_y"), F.count(F.lit(1)).alias("n"))
    theta = F.when((F.col("b") > 0) & (F.col("b") < 1), -F.log("b") / dt)
    resid = F.greatest(F.col("_y") - F.col("b") * F.col("b") * F.col("_x"), F.lit(0.0)) / (F.col("n") - 2)
    return s.select(*keys, "n", theta.alias("theta"), ratio("a", 1 - F.col("b"), None).alias("mu"), F.when(theta.isNotNull(), F.sqrt(resid * 2 * theta / (1 - F.col("b") * F.col("b")))).alias("sigma"))


def segments(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Runs of an equal state: (keys, state, start, end, rows)."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_s", F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1)).withColumn("_r", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_r", state).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("rows")).drop("_r")


def hierarchical(df: DataFrame, groups: dict[str, dict[str, float]]) -> DataFrame:
    """``level_{group}``: the information-weighted mean of each group's signals, and ``combined``: the mean of groups that agree
    with the first, zero where the first is zero."""
    for g, weights in groups.items():
        total = sum(abs(w) for w in weights.values()) or 1.0
        df = df.withColumn(f"level_{g}", sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0)))
    first, *rest = groups
    lead = F.signum(F.col(f"level_{first}"))
    agree = [F.when(F.signum(F.col(f"level_{g}")) == lead, F.col(f"level_{g}")) for g in rest]
    n = 1 + sum((a.isNotNull().cast("int") for a in agree), F.lit(0))
    return df.withColumn("combined", F.when(lead != 0, (F.col(f"level_{first}") + sum((F.coalesce(a, F.lit(0.0)) for a in agree), F.lit(0.0))) / n).otherwise(0.0))


def welch(x: np.ndarray, segment: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power by averaged Hann segments that overlap by half."""
    x = np.asarray(x, float)
    segment = min(segment, len(x))
    w = np.hanning(segment)
    starts = range(0, len(x) - segment + 1, max(1, segment // 2))
    p = np.mean([np.abs(np.fft.rfft((x[i : i + segment] - x[i : i + segment].mean()) * w)) ** 2 for i in starts], axis=0)
    return np.fft.rfftfreq(segment), p / (w * w).sum()


def spectrum_by_key(df: DataFrame, value: str, key: str, order: str, low: float = 0.1) -> DataFrame:
    """Spectral entropy (0 to 1), share of power below ``low``, log-log slope and autocorrelation half-life of each key's series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        if len(x) < 16 or x.std() == 0:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "entropy": [0.0], "low_share": [0.0], "slope": [0.0], "half_life": [0]})
        f, p = welch(x)
        f, p = f[1:], p[1:]
        q = p / p.sum()
        e = float(-(q * np.log(np.maximum(q, 1e-300))).sum() / math.log(len(q)))
        c = x - x.mean()
        a = np.correlate(c, c, "full")[len(c) - 1 :] / (c * c).sum()
        below = np.flatnonzero(a < 0.5)
        slope = float(np.polyfit(np.log(f), np.log(np.maximum(p, 1e-300)), 1)[0])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "entropy": [e], "low_share": [float(q[f < low].sum())], "slope": [slope], "half_life": [int(below[0]) if len(below) else len(x)]})

    return df.select(key, order, value).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, entropy double, low_share double, slope double, half_life long")


def hopkins(x: np.ndarray, seed: int = 0) -> float:
    """Clustering tendency of a bounded sample: near 0.5 for uniform points, near 1 for clusters."""
    rng = np.random.default_rng(seed)
    n = len(x)
    m = max(5, min(n // 10, n // 2))
    pick = rng.choice(n, m, replace=False)
    u = rng.uniform(x.min(axis=0), x.max(axis=0), (m, x.shape[1]))
    near = lambda a, skip: np.array([np.partition(((x - v) ** 2).sum(axis=1), skip)[skip] ** 0.5 for v in a])
    du, dw = near(u, 0).sum(), near(x[pick], 1).sum()
    return float(du / (du + dw)) if du + dw > 0 else 0.5


def silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distances, by Spark's distributed evaluator."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    d = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("prediction"))
    return df.sparkSession.createDataFrame([(float(ClusteringEvaluator().evaluate(d)),)], "silhouette double")


def null_calibrated(df: DataFrame, x: str, y: str, keys: list[str], draws: int = 20, buckets: int = 64) -> DataFrame:
    """Correlation of x and y with z and p against draws in which y is shifted among rows of equal place: each draw pairs a
    row with the y of the row a hashed number of places on within its block of ``buckets`` rows (``_n`` numbers rows)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    blocks = both.withColumn("_b", F.floor(F.col("_n") / buckets)).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_n", x, y))).alias("_r"))
    d = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    shift = F.when(F.col("draw") == 0, 0).otherwise(F.pmod(F.xxhash64("draw", "_b"), F.size("_r").cast("long")).cast("int"))
    d = d.withColumn("_s", shift).withColumn("_p", F.transform("_r", lambda r, i: F.struct(r[x].alias("a"), F.get(F.col("_r"), F.pmod(i + F.col("_s"), F.size("_r")))[y].alias("b"))))
    from fathomline.operators.stats import pearson

    c = d.select(*keys, "draw", F.explode("_p").alias("p")).select(*keys, "draw", "p.*").groupBy(*keys, "draw").agg(pearson("a", "b").alias("c"))
    null = F.when(F.col("draw") > 0, F.col("c"))
    own = F.max(F.when(F.col("draw") == 0, F.col("c")))
    out = c.groupBy(*keys).agg(own.alias("value"), F.avg(null).alias("_m"), F.stddev_pop(null).alias("_s"), F.collect_list(null).alias("_n"))
    above = F.size(F.filter("_n", lambda v: F.abs(v) >= F.abs(F.col("value"))))
    return out.select(*keys, "value", ratio(F.col("value") - F.col("_m"), "_s").alias("z"), ((above + 1) / (F.size("_n") + 1)).alias("p"))
