"""Derived, market-context, whale-flow, order-flow and VWAP operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.numeric import clip, ratio, sign, zscore
from fathomline.functions.windows import drop_halo, row_sum, rows, running, sequenced
from fathomline.operators.tape import window_statistics


def trend_strength(momentum: Column, monotonicity: Column, entropy: Column) -> Column:
    """sign(momentum) * 2 (monotonicity - 0.5) * (1 - entropy), the last within 0 and 1."""
    return sign(momentum) * 2 * (monotonicity - 0.5) * clip(1 - entropy, 0, 1)


def derived_block(momentum: Column, monotonicity: Column, entropy: Column, vol_ratio: Column, imbalance: Column) -> dict[str, Column]:
    """Interactions of trend, entropy, volatility and flow."""
    t = trend_strength(momentum, monotonicity, entropy)
    reverting = entropy * (1 - F.abs(t))
    return {
        "derived_entropy_trend": entropy * sign(momentum),
        "derived_trend_strength": t,
        "derived_trend_strength_vol": ratio(t, vol_ratio),
        "derived_entropy_vol": entropy * vol_ratio,
        "derived_illiq_trend": t * (1 - F.abs(imbalance)),
        "derived_regime_indicator": reverting - F.abs(t) - 0.5 * F.abs(imbalance),
        "derived_regime_confidence": clip(2 * F.greatest(F.abs(entropy - 0.5), F.abs(monotonicity - 0.5) * 2, F.abs(t)), 0, 1),
        "derived_spread_z": (vol_ratio - 0.2) / 0.15,
    }


def context_block(ctx: DataFrame, history: int = 288, momentum: int = 96, short: int = 12, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """From updates with ``funding``, ``open_interest``, ``mark``, ``oracle`` and ``day_volume``: funding z-score against the last
    ``history`` updates, open-interest change and share of 60 updates ago, premium in bps, volume ratio to its mean, funding
    momentum over ``momentum`` updates and its change over ``short``. Zero until there are enough updates."""
    k = list(keys)
    d = sequenced(ctx, k, ["ts", "tid"], "ts", history + momentum + short)
    w, lag = rows(k, history - 1), lambda c, n: F.lag(c, n).over(rows(k))
    fz = zscore("funding", F.avg("funding").over(w), F.coalesce(F.stddev_samp("funding").over(w), F.lit(0.0)))
    mom = F.col("funding") - lag("funding", momentum)
    d = d.withColumns(
        {
            "ctx_funding_zscore": fz,
            "ctx_oi_change": F.coalesce(F.col("open_interest") - lag("open_interest", 60), F.lit(0.0)),
            "ctx_oi_change_pct": F.coalesce(ratio(F.col("open_interest") - lag("open_interest", 60), lag("open_interest", 60)), F.lit(0.0)),
            "ctx_premium_bps": ratio(F.col("mark") - F.col("oracle"), "oracle") * 1e4,
            "ctx_volume_ratio": ratio("day_volume", F.avg("day_volume").over(w), 1.0),
            "ctx_funding_momentum": F.coalesce(mom, F.lit(0.0)),
            "ctx_funding_acceleration": F.coalesce(mom - (lag("funding", short) - lag("funding", momentum + short)), F.lit(0.0)),
        }
    )
    return drop_halo(d.withColumn("ctx_mark_oracle_divergence", F.abs("ctx_premium_bps"))).drop("_n")


def whale_flow_block(changes: DataFrame, windows: tuple[int, ...] = (60, 240, 1440), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Over the last n changes (``position_change_usd``, ``is_market_maker``, ``wallet``), market makers left out: net flow,
    net flow over mean absolute change, and intensity (changes that aren't market makers' over n); momentum of the
    shortest window against the longest."""
    k = list(keys)
    x = F.when(~F.col("is_market_maker"), F.col("position_change_usd"))
    d = sequenced(changes, k, ["ts", "tid"], "ts", max(windows))
    d = d.withColumns({"_f": F.sum(F.coalesce(x, F.lit(0.0))).over(running(k)), "_a": F.sum(F.coalesce(F.abs(x), F.lit(0.0))).over(running(k)), "_c": F.count(x).over(running(k)).cast("double")})
    for n in windows:
        f, a, c = (row_sum(s, k, n) for s in ("_f", "_a", "_c"))
        d = d.withColumns({f"whale_net_flow_{n}": f, f"whale_flow_normalized_{n}": F.when(a > 1e-9, f / (a / c)).otherwise(0.0), f"whale_flow_intensity_{n}": c / n})
    lo, hi = min(windows), max(windows)
    return drop_halo(d.withColumn("whale_flow_momentum", F.col(f"whale_net_flow_{lo}") / lo - F.col(f"whale_net_flow_{hi}") / hi)).drop("_n", "_f", "_a", "_c")


def multiscale_vwap(trades: DataFrame, seconds: dict[str, int], z_rows: int = 200, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """VWAP of each window, the price's deviation from it, and that deviation's rolling z-score."""
    k = list(keys)
    d = window_statistics(trades, seconds, keys).select(*trades.columns, *[f"vwap_{x}" for x in seconds])
    d = d.withColumns({f"dev_{x}": ratio(F.col("price") - F.col(f"vwap_{x}"), f"vwap_{x}") for x in seconds})
    d = sequenced(d, k, ["ts", "tid"], "ts", z_rows)
    w = rows(k, z_rows - 1)
    return drop_halo(d.withColumns({f"z_{x}": zscore(f"dev_{x}", F.avg(f"dev_{x}").over(w), F.coalesce(F.stddev_samp(f"dev_{x}").over(w), F.lit(0.0))) for x in seconds})).drop("_n")


def realized_moments(bars: DataFrame, n: int, ret: str = "ret", keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis of the last n returns, and the downside and upside semivariance; null
    until full."""
    k = list(keys)
    d = sequenced(bars, k, list(order), order[0], n)
    w, x = rows(k, n - 1), F.col(ret)
    full = F.count(ret).over(w) == n
    d = d.withColumn("_m", F.avg(ret).over(w)).withColumn("_all", F.collect_list(ret).over(w))
    power = lambda p: F.aggregate("_all", F.lit(0.0), lambda s, v: s + F.pow(v - F.col("_m"), F.lit(p))) / n
    d = d.withColumns({"_2": power(2), "_3": power(3), "_4": power(4)})
    d = d.withColumns(
        {
            "realized_skew": F.when(full & (F.col("_2") > 1e-18), F.col("_3") / F.pow(F.col("_2"), F.lit(1.5)) * math.sqrt(n * (n - 1)) / (n - 2)),
            "realized_kurt": F.when(full & (F.col("_2") > 1e-18), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.col("_4") / (F.col("_2") * F.col("_2")) - 3) + 6)),
            "semivar_down": F.when(full, F.sum(F.when(x < 0, x * x).otherwise(0.0)).over(w)),
            "semivar_up": F.when(full, F.sum(F.when(x > 0, x * x).otherwise(0.0)).over(w)),
        }
    )
    return drop_halo(d).drop("_n", "_m", "_all", "_2", "_3", "_4")


def residualised(df: DataFrame, y: str, zs: list[str], train: Column, keys: list[str]) -> DataFrame:
    """``resid``: y less its least-squares fit on the columns ``zs`` (and a constant), coefficients from training rows only.

    The normal equations of each key are sums; they are solved for a row a key and joined back."""
    cols = [F.lit(1.0), *[F.col(z).cast("double") for z in zs]]
    m = len(cols)
    good = train
    for c in [y, *zs]:
        good = good & F.col(c).isNotNull()
    sums = df.where(good).groupBy(*keys).agg(*[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)], *[F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(m)])

    def solve(pdfs):
        for pdf in pdfs:
            out = [np.linalg.lstsq(np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]), np.array([r[f"b{i}"] for i in range(m)]), rcond=None)[0].tolist() for r in pdf.to_dict("records")]
            yield pd.DataFrame({**{c: pdf[c] for c in keys}, "_beta": out})

    beta = sums.mapInPandas(solve, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys) + ", _beta array<double>")
    fit = F.get("_beta", F.lit(0))
    for i, z in enumerate(zs, 1):
        fit = fit + F.get("_beta", F.lit(i)) * F.col(z)
    return df.join(beta, keys, "left").withColumn("resid", F.col(y) - fit).drop("_beta")


class MicropriceModel:
    """Stoikov's micro-price: expected mid after the next moves, by a Markov chain over (imbalance, spread) bins.

    Fitted from transition counts that are aggregated from the data, with the mirrored transition added for each; only
    the counts (bins squared times the few mid changes) reach the driver."""

    def __init__(self, bins: int, spreads: int, adjustment: np.ndarray):
        self.bins, self.spreads, self.adjustment = bins, spreads, adjustment

    @staticmethod
    def state(imbalance: Column, spread_ticks: Column, bins: int, spreads: int) -> Column:
        i = F.least(F.floor((imbalance + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
        return i * spreads + F.least(F.greatest(spread_ticks.cast("int"), F.lit(1)), F.lit(spreads)) - 1

    @classmethod
    def fit(cls, df: DataFrame, keys: list[str], imbalance: str, spread_ticks: str, mid_ticks: str, bins: int = 5, spreads: int = 2, rounds: int = 6) -> MicropriceModel:
        d = sequenced(df.withColumn("_s", cls.state(F.col(imbalance), F.col(spread_ticks), bins, spreads)), keys, ["ts", "tid"], "ts", 0, 1)
        nxt, move = F.lead("_s").over(rows(keys)), F.lead(mid_ticks).over(rows(keys)) - F.col(mid_ticks)
        counts = drop_halo(d.withColumn("_t", nxt).withColumn("_m", clip(move, -2, 2).cast("int"))).where(F.col("_t").isNotNull()).groupBy("_s", "_t", "_m").count().collect()
        n = bins * spreads
        q, r = np.zeros((n, n)), np.zeros((n, 5))
        t = np.zeros((n, n))
        for c in counts:
            for s, e, m in ((c["_s"], c["_t"], c["_m"]), (_mirror(c["_s"], bins, spreads), _mirror(c["_t"], bins, spreads), -c["_m"])):
                if m == 0:
                    q[s, e] += c["count"]
                else:
                    r[s, m + 2] += c["count"]
                    t[s, e] += c["count"]
        total = np.maximum(q.sum(axis=1) + r.sum(axis=1), 1)[:, None]
        inverse = np.linalg.pinv(np.eye(n) - q / total)
        g, b = inverse @ (r / total) @ np.arange(-2, 3), inverse @ (t / total)
        out, term = g.copy(), g
        for _ in range(rounds):
            term = b @ term
            out = out + term
        return cls(bins, spreads, out)

    def deviation(self, imbalance: Column, spread_ticks: Column) -> Column:
        return F.get(F.array(*[F.lit(float(x)) for x in self.adjustment]), self.state(imbalance, spread_ticks, self.bins, self.spreads))


def _mirror(state: int, bins: int, spreads: int) -> int:
    return (bins - 1 - state // spreads) * spreads + state % spreads
