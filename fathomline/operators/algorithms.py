"""Streaming signal algorithms: one contract, ``step(tick)`` for a stream and ``run(df)`` for a batch.

An algorithm names the columns it needs and the columns it makes, keeps its own state, and gives NaN until it is warm.
``run`` sends each key's rows in order through ``step``: the recursions depend on their own past output, so a key is
sequential by nature; keys run in parallel. Windowed algorithms that aren't recursive have Column forms in
``windowed``, which need no Python.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.numeric import ratio
from fathomline.functions.windows import drop_halo, rows, sequenced

NAN = float("nan")
REGISTRY: dict[str, type[Algorithm]] = {}


def register(cls: type[Algorithm]) -> type[Algorithm]:
    REGISTRY[cls.name] = cls
    return cls


class Algorithm:
    """The contract. Subclasses set ``name``, ``needs``, ``makes``, ``warmup`` and implement ``reset`` and ``update``."""

    name, needs, makes, warmup = "", (), (), 0

    def __init__(self, **parameters):
        for k, v in parameters.items():
            if not hasattr(self, k):
                raise TypeError(f"{self.name} has no parameter {k}")
            setattr(self, k, v)
        self.seen = 0
        self.reset()

    def reset(self) -> None:
        self.seen = 0

    def update(self, tick: dict[str, float]) -> dict[str, float]:
        raise NotImplementedError

    def step(self, tick: dict[str, float]) -> dict[str, float]:
        """The outputs after one tick, under ``alg_{name}_{output}``; NaN while warming up or if an input is missing."""
        if any(tick.get(c) is None or math.isnan(tick[c]) for c in self.needs):
            return {f"alg_{self.name}_{m}": NAN for m in self.makes}
        self.seen += 1
        out = self.update(tick)
        return {f"alg_{self.name}_{m}": out[m] if self.seen > self.warmup else NAN for m in self.makes}


def run(df: DataFrame, algorithms: list[Algorithm], key: str = "symbol", order: str = "ts", carry: tuple[str, ...] = ()) -> DataFrame:
    """The outputs of a chain of algorithms for each row: (key, order, carried columns, outputs)."""
    names = [f"alg_{a.name}_{m}" for a in algorithms for m in a.makes]
    needs = list(dict.fromkeys(c for a in algorithms for c in a.needs))
    made = [(type(a), {k: v for k, v in vars(a).items() if hasattr(type(a), k) and k not in ("seen",)}) for a in algorithms]
    base = list(dict.fromkeys([key, order, *carry]))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, *carry], kind="stable")
        chain = [cls(**p) for cls, p in made]
        values = pdf[needs].to_numpy(float)
        out = np.empty((len(pdf), len(names)))
        for i, row in enumerate(values):
            tick = dict(zip(needs, row))
            out[i] = [v for a in chain for v in a.step(tick).values()]
        return pd.concat([pdf[base].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in base)
    return df.select(*dict.fromkeys([*base, *needs])).groupBy(key).applyInPandas(one, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


class Rolling:
    """Mean and deviation over the last n values."""

    def __init__(self, n: int):
        self.v: deque[float] = deque(maxlen=n)

    def push(self, x: float) -> None:
        self.v.append(x)

    def z(self, x: float, ddof: int = 1, least: int = 2) -> float:
        if len(self.v) < max(least, ddof + 1):
            return 0.0
        a = np.fromiter(self.v, float)
        s = a.std(ddof=ddof)
        return float((x - a.mean()) / s) if s > 1e-12 else 0.0

    def percentile(self, q: float) -> float:
        return float(np.percentile(np.fromiter(self.v, float), q)) if self.v else NAN


@register
class RegimeGated(Algorithm):
    """Imbalance while entropy is below its rolling quantile."""

    name, needs, makes, warmup = "regime_gated", ("imbalance", "entropy"), ("signal",), 100
    window, quantile = 1000, 30.0

    def reset(self):
        super().reset()
        self._e = Rolling(self.window)

    def update(self, tick):
        self._e.push(tick["entropy"])
        return {"signal": tick["imbalance"] if tick["entropy"] < self._e.percentile(self.quantile) else 0.0}


@register
class KalmanImbalance(Algorithm):
    """Ornstein-Uhlenbeck state behind the imbalance: F = exp(-theta dt), Q = sigma^2 (1 - F^2) / (2 theta), P0 = Q."""

    name, needs, makes = "kalman_imbalance", ("imbalance",), ("state", "variance", "innovation")
    theta, sigma, noise, dt = 0.5, 0.3, 0.1, 1.0

    def reset(self):
        super().reset()
        self._f = math.exp(-self.theta * self.dt)
        self._q = self.sigma**2 * (1 - self._f**2) / (2 * self.theta)
        self._x, self._p = 0.0, self._q

    def update(self, tick):
        x, p = self._f * self._x, self._f**2 * self._p + self._q
        v = tick["imbalance"] - x
        g = p / (p + self.noise)
        self._x, self._p = x + g * v, (1 - g) * p
        return {"state": self._x, "variance": self._p, "innovation": v}


@register
class SwitchingOu(Algorithm):
    """Two such filters, slow and fast, mixed by their posterior probabilities."""

    name, needs, makes = "switching_ou", ("imbalance",), ("state", "p_fast")
    slow, fast, sigma, noise, stay = 0.1, 2.0, 0.3, 0.1, 0.98

    def reset(self):
        super().reset()
        self._k = [KalmanImbalance(theta=t, sigma=self.sigma, noise=self.noise) for t in (self.slow, self.fast)]
        self._w = np.array([0.5, 0.5])

    def update(self, tick):
        prior = self._w * self.stay + (1 - self._w) * (1 - self.stay)
        like = []
        for k in self._k:
            s = k._f**2 * k._p + k._q + self.noise
            v = tick["imbalance"] - k._f * k._x
            like.append(math.exp(-0.5 * v * v / s) / math.sqrt(2 * math.pi * s))
        w = prior * np.array(like)
        self._w = w / w.sum() if w.sum() > 0 else prior
        x = [k.update(tick)["state"] for k in self._k]
        return {"state": float(self._w @ np.array(x)), "p_fast": float(self._w[1])}


@register
class HawkesIntensity(Algorithm):
    """A = decay * (A + n), capped; ratio to its rolling mean."""

    name, needs, makes = "hawkes_intensity", ("count",), ("excitation", "ratio")
    decay, cap, window = 0.9, 1e4, 300

    def reset(self):
        super().reset()
        self._a, self._m = 0.0, Rolling(self.window)

    def update(self, tick):
        self._a = min(self.cap, self.decay * (self._a + tick["count"]))
        self._m.push(self._a)
        m = float(np.mean(self._m.v))
        return {"excitation": self._a, "ratio": self._a / m if m > 0 else 0.0}


@register
class JumpDetector(Algorithm):
    """A return beyond ``k`` local deviations, these by bipower variation (pi / 2 times the mean of adjacent |r| products)."""

    name, needs, makes, warmup = "jump_detector", ("price",), ("jump", "statistic"), 21
    window, k = 20, 4.0

    def reset(self):
        super().reset()
        self._p, self._r = None, deque(maxlen=self.window)

    def update(self, tick):
        r = math.log(tick["price"] / self._p) if self._p and tick["price"] > 0 else 0.0
        self._p = tick["price"]
        a = np.abs(np.fromiter(self._r, float))
        bv = math.pi / 2 * float((a[1:] * a[:-1]).mean()) if len(a) > 1 else 0.0
        s = r / math.sqrt(bv) if bv > 1e-18 else 0.0
        self._r.append(r)
        return {"jump": float(np.sign(s)) if abs(s) > self.k else 0.0, "statistic": s}


@register
class WeightedOfi(Algorithm):
    """Imbalances of three depths weighted by exp(-decay k), and their normalised exponential average."""

    name, needs, makes = "weighted_ofi", ("imbalance_l1", "imbalance_l5", "imbalance_l10"), ("value", "momentum")
    decay, span = 0.5, 20

    def reset(self):
        super().reset()
        self._n = self._d = 0.0

    def update(self, tick):
        w = [math.exp(-self.decay * k) for k in range(3)]
        v = sum(a * tick[c] for a, c in zip(w, self.needs)) / sum(w)
        keep = 1 - 2 / (self.span + 1)
        self._n, self._d = keep * self._n + v, keep * self._d + 1
        return {"value": v, "momentum": v - self._n / self._d}


@register
class FundingReversion(Algorithm):
    """Against extreme funding: -sign(z) * min(|z| / full, 1) beyond a threshold."""

    name, needs, makes, warmup = "funding_reversion", ("funding",), ("signal", "z"), 30
    window, threshold, full = 288, 1.5, 3.0

    def reset(self):
        super().reset()
        self._v = Rolling(self.window)

    def update(self, tick):
        z = self._v.z(tick["funding"])
        self._v.push(tick["funding"])
        return {"signal": -math.copysign(min(abs(z) / self.full, 1.0), z) if abs(z) >= self.threshold else 0.0, "z": z}


@register
class Propagator(Algorithm):
    """Signed volume against the kernel tau^-gamma over the last W ticks."""

    name, needs, makes = "propagator", ("signed_volume",), ("impact",)
    window, gamma = 50, 0.5

    def reset(self):
        super().reset()
        self._v = deque(maxlen=self.window)
        self._k = np.arange(1, self.window + 1) ** -self.gamma / self.window

    def update(self, tick):
        self._v.appendleft(tick["signed_volume"])
        return {"impact": float(np.fromiter(self._v, float) @ self._k[: len(self._v)])}


@register
class VpinGate(Algorithm):
    """Size by the rolling rank (ties: highest) of toxicity and spread: closed above the gate, shrinking below it."""

    name, needs, makes, warmup = "vpin_gate", ("vpin", "spread"), ("gate", "size"), 50
    window, limit = 500, 0.8

    def reset(self):
        super().reset()
        self._a, self._b = Rolling(self.window), Rolling(self.window)

    def update(self, tick):
        self._a.push(tick["vpin"])
        self._b.push(tick["spread"])
        pa = float(np.mean(np.fromiter(self._a.v, float) <= tick["vpin"]))
        pb = float(np.mean(np.fromiter(self._b.v, float) <= tick["spread"]))
        open_ = pa <= self.limit and pb <= self.limit
        return {"gate": float(open_), "size": (1 - max(pa, pb)) if open_ else 0.0}


@register
class VwapReversion(Algorithm):
    """Fades deviations from VWAP beyond a threshold of population deviations."""

    name, needs, makes, warmup = "vwap_reversion", ("vwap_deviation",), ("signal", "z"), 30
    window, threshold = 200, 2.0

    def reset(self):
        super().reset()
        self._v = Rolling(self.window)

    def update(self, tick):
        self._v.push(tick["vwap_deviation"])
        z = self._v.z(tick["vwap_deviation"], ddof=0)
        return {"signal": -math.copysign(1.0, z) if abs(z) > self.threshold else 0.0, "z": z}


@register
class Sprt(Algorithm):
    """Sequential test of a drift: log likelihood ratio of the innovation, reset at either bound, signal at the upper one."""

    name, needs, makes = "optimal_entry", ("innovation",), ("llr", "signal")
    mu, upper, lower, alpha = 0.5, 2.0, -2.0, 0.05

    def reset(self):
        super().reset()
        self._l, self._s = 0.0, 1.0

    def update(self, tick):
        v = tick["innovation"]
        self._s = (1 - self.alpha) * self._s + self.alpha * v * v
        s2 = max(self._s, 1e-9)
        self._l += self.mu / s2 * v - self.mu**2 / (2 * s2)
        llr, hit = self._l, self._l >= self.upper
        if hit or self._l <= self.lower:
            self._l = 0.0
        return {"llr": llr, "signal": float(hit)}


@register
class ChangePoint(Algorithm):
    """Two-sided CUSUM of standardised values with reset, and the age since."""

    name, needs, makes, warmup = "change_point_detector", ("value",), ("change", "age"), 20
    window, drift, limit = 100, 0.5, 5.0

    def reset(self):
        super().reset()
        self._v, self._up, self._down, self._age = Rolling(self.window), 0.0, 0.0, 0

    def update(self, tick):
        z = self._v.z(tick["value"], ddof=0, least=20)
        self._v.push(tick["value"])
        self._up, self._down = max(0.0, self._up + z - self.drift), max(0.0, self._down - z - self.drift)
        change = float(self._up > self.limit) - float(self._down > self.limit)
        self._age = 0 if change else self._age + 1
        if change:
            self._up = self._down = 0.0
        return {"change": change, "age": float(self._age)}


@register
class RegimeStateMachine(Algorithm):
    """States by additive scores; a switch needs ``least`` ticks in the present one; ties go to the higher state."""

    name, needs, makes = "regime_state_machine", ("trend", "volatility", "imbalance"), ("state", "age")
    least, window = 10, 288

    def reset(self):
        super().reset()
        self._s, self._age, self._v = 0, 0, Rolling(self.window)

    def update(self, tick):
        self._v.push(tick["volatility"])
        calm = tick["volatility"] <= float(np.median(np.fromiter(self._v.v, float)))
        t, i = tick["trend"], tick["imbalance"]
        scores = [2.0 * calm + (abs(t) < 0.1), (t > 0) + (i > 0) + calm * 0.5, (t < 0) + (i < 0) + calm * 0.5, 2.0 * (not calm) + (abs(t) < 0.1)]
        best = max(range(len(scores)), key=lambda k: (scores[k], k))
        self._age += 1
        if best != self._s and self._age >= self.least:
            self._s, self._age = best, 0
        return {"state": float(self._s), "age": float(self._age)}


@register
class SurpriseSignal(Algorithm):
    """z of the smoothed change of entropy, through the error function."""

    name, needs, makes, warmup = "surprise_signal", ("entropy",), ("surprise",), 30
    window, span = 200, 10

    def reset(self):
        super().reset()
        self._last, self._e, self._v = None, 0.0, Rolling(self.window)

    def update(self, tick):
        d = 0.0 if self._last is None else tick["entropy"] - self._last
        self._last = tick["entropy"]
        self._e += 2 / (self.span + 1) * (d - self._e)
        z = self._v.z(self._e)
        self._v.push(self._e)
        return {"surprise": math.copysign(math.erf(abs(z) / math.sqrt(2)), z)}


@register
class EntropyMomentum(Algorithm):
    """0.6 short + 0.4 long momentum while the entropy average is low: enters below one rolling percentile, stays up to another."""

    name, needs, makes, warmup = "entropy_momentum", ("entropy", "momentum_short", "momentum_long"), ("signal", "gate"), 50
    window, enter, leave, span = 500, 30.0, 60.0, 20

    def reset(self):
        super().reset()
        self._e, self._v, self._on = None, Rolling(self.window), False

    def update(self, tick):
        self._e = tick["entropy"] if self._e is None else self._e + 2 / (self.span + 1) * (tick["entropy"] - self._e)
        self._v.push(self._e)
        self._on = self._e < self._v.percentile(self.leave if self._on else self.enter)
        m = 0.6 * tick["momentum_short"] + 0.4 * tick["momentum_long"]
        return {"signal": m if self._on else 0.0, "gate": float(self._on)}


@register
class VolSqueeze(Algorithm):
    """Armed after a run of squeezed bands, fires on the first move out of them, and decays linearly."""

    name, needs, makes, warmup = "vol_squeeze", ("width", "pct"), ("signal", "armed"), 100
    window, refresh, quantile, run, hold = 500, 100, 20.0, 10, 20

    def reset(self):
        super().reset()
        self._v, self._cut, self._run, self._armed, self._left, self._side = Rolling(self.window), NAN, 0, False, 0, 0.0

    def update(self, tick):
        self._v.push(tick["width"])
        if self.seen % self.refresh == 0:
            self._cut = self._v.percentile(self.quantile)
        self._run = self._run + 1 if tick["width"] < self._cut else 0
        self._armed = self._armed or self._run >= self.run
        out = 1.0 if tick["pct"] > 1 else -1.0 if tick["pct"] < 0 else 0.0
        if self._armed and out:
            self._armed, self._left, self._side = False, self.hold, out
        signal = self._side * self._left / self.hold
        self._left = max(0, self._left - 1)
        return {"signal": signal, "armed": float(self._armed)}


@register
class SpreadDecomposition(Algorithm):
    """Adverse part: the effective spread less the realised one of the tick before; its normalised average; high regime."""

    name, needs, makes, warmup = "spread_decomp", ("effective", "realized"), ("adverse", "trend", "regime"), 20
    window, span, quantile = 300, 20, 75.0

    def reset(self):
        super().reset()
        self._r, self._n, self._d, self._v = None, 0.0, 0.0, Rolling(self.window)

    def update(self, tick):
        a = tick["effective"] - (self._r if self._r is not None else tick["realized"])
        self._r = tick["realized"]
        keep = 1 - 2 / (self.span + 1)
        self._n, self._d = keep * self._n + a, keep * self._d + 1
        self._v.push(a)
        return {"adverse": a, "trend": self._n / self._d, "regime": float(a > self._v.percentile(self.quantile))}


@register
class Welford(Algorithm):
    """Running mean and deviation, and the value normalised by those before it."""

    name, needs, makes, warmup = "welford", ("value",), ("z",), 2

    def reset(self):
        super().reset()
        self._n, self._m, self._s = 0, 0.0, 0.0

    def update(self, tick):
        x = tick["value"]
        sd = math.sqrt(self._s / (self._n - 1)) if self._n > 1 else 0.0
        z = (x - self._m) / sd if sd > 1e-12 else 0.0
        self._n += 1
        d = x - self._m
        self._m += d / self._n
        self._s += d * (x - self._m)
        return {"z": z}


def ensemble(df: DataFrame, signals: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the signals that are there: a missing one (null or NaN) takes no weight."""
    weights = weights or dict.fromkeys(signals, 1.0)
    have = {s: F.col(s).isNotNull() & ~F.isnan(s) for s in signals}
    num = sum((F.when(have[s], F.col(s) * weights[s]).otherwise(0.0) for s in signals), F.lit(0.0))
    den = sum((F.when(have[s], F.lit(abs(weights[s]))).otherwise(0.0) for s in signals), F.lit(0.0))
    return df.withColumn("ensemble", ratio(num, den, None))


def windowed(df: DataFrame, out: str, expression: Callable[[list[str]], Column], back: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "tid")) -> DataFrame:
    """A column over frames of rows without Python; ``expression`` gets the window's keys."""
    k = list(keys)
    return drop_halo(sequenced(df, k, list(order), order[0], back).withColumn(out, expression(k))).drop("_n")


def rolling_z(column: str, n: int, pop: bool = True) -> Callable[[list[str]], Column]:
    def make(k: list[str]) -> Column:
        w = rows(k, n - 1)
        s = (F.stddev_pop if pop else F.stddev_samp)(column).over(w)
        return F.when(s > 1e-12, (F.col(column) - F.avg(column).over(w)) / s).otherwise(0.0)

    return make


def trade_through(volume: str, depth: str, aggressor: str) -> Column:
    """Volume that trades through the passive side: volume * (1 - aggressor ratio) / depth, within 0 and 1."""
    return F.least(F.greatest(ratio(F.col(volume) * (1 - F.col(aggressor)), depth), F.lit(0.0)), F.lit(1.0))


def oi_divergence(price: str, interest: str, n: int) -> Callable[[list[str]], Column]:
    """z of the price less z of open interest over the last n rows."""
    return lambda k: rolling_z(price, n)(k) - rolling_z(interest, n)(k)
