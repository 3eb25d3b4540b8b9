"""Change points, selection by information, cluster number, spectra of pairs, and maker simulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.algorithms import Algorithm, register
from fathomline.operators.discovery import entropy_of


@register
class RunLength(Algorithm):
    """Posterior of the time since the last change (constant hazard, normal data with unknown mean and variance): its most
    likely value and the probability that it is below ``fresh``."""

    name, needs, makes, warmup = "run_length", ("value",), ("likeliest", "p_fresh"), 5
    hazard, longest, fresh = 0.01, 300, 10

    def reset(self):
        super().reset()
        self._p = np.array([1.0])
        self._m, self._k, self._a, self._b = np.zeros(1), np.ones(1) * 0.1, np.ones(1), np.ones(1)
        self._scale = None

    def update(self, tick):
        x = tick["value"]
        self._scale = (x, max(abs(x) * 0.05, 1e-9)) if self._scale is None else self._scale
        x = (x - self._scale[0]) / self._scale[1]
        nu, s2 = 2 * self._a, self._b * (self._k + 1) / (self._a * self._k)
        lg = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in nu])
        like = np.exp(lg - 0.5 * np.log(nu * math.pi * s2) - (nu + 1) / 2 * np.log1p((x - self._m) ** 2 / (nu * s2)))
        grow, new = self._p * like * (1 - self.hazard), float((self._p * like).sum() * self.hazard)
        p = np.append(new, grow)[: self.longest]
        self._p = p / max(p.sum(), 1e-300)
        d = x - self._m
        m, k, a, b = self._m + d / (self._k + 1), self._k + 1, self._a + 0.5, self._b + self._k * d * d / (2 * (self._k + 1))
        first = (0.0, 0.1, 1.0, 1.0)
        self._m, self._k, self._a, self._b = (np.append(f, v)[: self.longest] for f, v in zip(first, (m, k, a, b)))
        return {"likeliest": float(self._p.argmax()), "p_fresh": float(self._p[: self.fresh].sum())}


def greedy_selection(df: DataFrame, features: list[str], target: str, most: int) -> DataFrame:
    """(step, feature, gain): features chosen one after another by the information in bits that each adds about the target
    given those chosen. Columns are discrete with few values; a step is a few small aggregates."""
    chosen, out = [], []
    h = lambda cols: (entropy_of(df, [], cols).first() or [0.0])[0] or 0.0 if cols else 0.0
    while len(chosen) < min(most, len(features)):
        base, with_target = h(chosen), h([*chosen, target])
        gains = {f: (h([*chosen, f]) - base) - (h([*chosen, f, target]) - with_target) for f in features if f not in chosen}
        best = max(sorted(gains), key=lambda f: gains[f])
        if gains[best] <= 1e-12:
            break
        chosen.append(best)
        out.append((len(chosen), best, float(gains[best])))
    return df.sparkSession.createDataFrame(out, "step int, feature string, gain double")


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> float:
    c = x[rng.choice(len(x), 1)]
    while len(c) < k:
        c = np.vstack((c, x[((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).argmax()]))
    for _ in range(rounds):
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
    return float(((x - c[((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)]) ** 2).sum())


def gap_statistic(x: np.ndarray, most: int = 8, draws: int = 10, seed: int = 0) -> list[tuple[int, float, float]]:
    """(k, gap, error) on a bounded sample: log dispersion of uniform points in the bounding box less that of the data."""
    rng, out = np.random.default_rng(seed), []
    lo, hi = x.min(axis=0), x.max(axis=0)
    for k in range(1, most + 1):
        own = math.log(max(_k_means(x, k, rng), 1e-300))
        null = np.array([math.log(max(_k_means(rng.uniform(lo, hi, x.shape), k, rng), 1e-300)) for _ in range(draws)])
        out.append((k, float(null.mean() - own), float(null.std() * math.sqrt(1 + 1 / draws))))
    return out


def _uniform(row: np.ndarray, draw: int, dims: int) -> np.ndarray:
    """Numbers from 0 to 1 for each row, the same whenever a task runs: a hash of row, draw and dimension."""
    h = row.view(np.uint64)[:, None] + (np.arange(dims, dtype=np.uint64)[None, :] + np.uint64(1 + draw * dims)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return (h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**64


def gap_by_rows(df: DataFrame, vector: str, most: int = 8, draws: int = 10, rounds: int = 15, seed: int = 0) -> DataFrame:
    """(k, gap, error) over all rows: log dispersion of uniform points in the bounding box, as many as there are rows, less
    that of the data, for k-means with 1 to ``most`` centres.

    All clusterings, of the data and of every draw, take a round together: a partition sums up its rows for each centre, and
    the driver gets the sums. Points are made from the rows' numbers where they are needed.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).withColumn("h", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    box = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    lo, hi, d = np.array([r["lo"] for r in box]), np.array([r["hi"] for r in box]), len(box)
    first = np.array([r["v"] for r in rows.orderBy("h").limit(most).select("v").collect()])
    rng = np.random.default_rng(seed)
    starts = [first, *(rng.uniform(lo, hi, (most, d)) for _ in range(draws))]
    models = {(s, k): starts[s][:k] for s in range(draws + 1) for k in range(1, min(most, len(first)) + 1)}
    out = {}
    for _ in range(rounds):

        def sums(batches, models=models):
            total = {m: np.zeros((len(c), d + 2)) for m, c in models.items()}
            for batch in batches:
                v = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty((0, d))
                for s in range(draws + 1):
                    x = v if s == 0 else lo + _uniform(batch.column(1).to_numpy(), s, d) * (hi - lo)
                    square = (x * x).sum(axis=1)
                    for k in range(1, most + 1):
                        if (s, k) in models:
                            c = models[s, k]
                            away = np.maximum(square[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)
                            own = away.argmin(axis=1)
                            hot = np.eye(len(c))[own]
                            total[s, k] += np.hstack((hot.T @ x, hot.sum(axis=0)[:, None], (hot * away).sum(axis=0)[:, None]))
            flat = np.concatenate([total[m].ravel() for m in models])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "x"])

        got = rows.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
        at, new = 0, {}
        for m, c in models.items():
            part = got[at : at + len(c) * (d + 2)].reshape(len(c), d + 2)
            at += part.size
            new[m] = np.where(part[:, d : d + 1] > 0, part[:, :d] / np.maximum(part[:, d : d + 1], 1), c)
            out[m] = math.log(max(part[:, d + 1].sum(), 1e-300))
        models = new
    ks = sorted({k for _, k in models})
    table = [(k, float(np.mean([out[s, k] for s in range(1, draws + 1)]) - out[0, k]), float(np.std([out[s, k] for s in range(1, draws + 1)]) * math.sqrt(1 + 1 / draws))) for k in ks]
    return df.sparkSession.createDataFrame(table, "k int, gap double, error double")


def band_passed(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """The part of a series with frequencies from ``low`` to ``high`` (cycles a row), without a shift in phase."""
    f = np.fft.rfftfreq(len(x))
    s = np.fft.rfft(x - np.mean(x))
    return np.fft.irfft(np.where((f >= low) & (f <= high), s, 0), len(x))


def coherence_by_key(df: DataFrame, a: str, b: str, key: str, order: str, segment: int = 64, bands: tuple[tuple[float, float], ...] = ((0.0, 0.05), (0.05, 0.2), (0.2, 0.5))) -> DataFrame:
    """Mean squared coherence and phase of two series in each band, by averaged Hann segments of a key's rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order)[[a, b]].dropna().to_numpy(float)
        out = []
        if len(d) >= 2 * segment:
            w = np.hanning(segment)[:, None]
            s = np.stack([np.fft.rfft((d[i : i + segment] - d[i : i + segment].mean(axis=0)) * w, axis=0) for i in range(0, len(d) - segment + 1, segment // 2)])
            cross, pa, pb = (s[:, :, 0] * s[:, :, 1].conj()).mean(axis=0), (np.abs(s[:, :, 0]) ** 2).mean(axis=0), (np.abs(s[:, :, 1]) ** 2).mean(axis=0)
            f = np.fft.rfftfreq(segment)
            c = np.abs(cross) ** 2 / np.maximum(pa * pb, 1e-300)
            out = [(pdf[key].iloc[0], lo, hi, float(c[m].mean()), float(np.angle(cross[m].sum()))) for lo, hi in bands if (m := (f > lo) & (f <= hi)).any()]
        return pd.DataFrame(out, columns=[key, "low", "high", "coherence", "phase"])

    return df.select(key, order, a, b).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, low double, high double, coherence double, phase double")


def touch_maker(price: np.ndarray, half: float, cap: int = 5, skew: float = 0.1, every: int = 1, fee: float = 0.0) -> dict[str, float]:
    """Quotes ``half`` either side of the price (shares), moved against the inventory by ``skew`` halves a unit; a quote is filled
    when the next price crosses it. Profit is marked at the last price."""
    q, cash, fills, bid, ask = 0, 0.0, 0, 0.0, math.inf
    for i in range(len(price) - 1):
        if i % every == 0:
            c = price[i] * (1 - skew * half * q)
            bid, ask = c * (1 - half), c * (1 + half)
        if price[i + 1] <= bid and q < cap:
            q, cash, fills = q + 1, cash - bid * (1 + fee), fills + 1
        if price[i + 1] >= ask and q > -cap:
            q, cash, fills = q - 1, cash + ask * (1 - fee), fills + 1
    return {"fills": float(fills), "inventory": float(q), "pnl": float(cash + q * price[-1]) if len(price) else 0.0}


def maker_by_key(df: DataFrame, price: str, key: str, order: str, halves: tuple[float, ...], fees: tuple[float, ...]) -> DataFrame:
    """``touch_maker`` for each key, half-spread and fee."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)[price].to_numpy(float)
        return pd.DataFrame([{key: pdf[key].iloc[0], "half": h, "fee": f, **touch_maker(p, h, fee=f)} for h in halves for f in fees])

    return df.select(key, order, price).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, half double, fee double, fills double, inventory double, pnl double")
