"""Execution, pairs, event studies, carry, ranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import ratio
from fathomline.functions.windows import drop_halo, rows, sequenced


def twap_slices(orders: DataFrame, quantity: str, start: str, slices: int, every_seconds: int) -> DataFrame:
    """Each order as equal slices: ``slice``, ``at`` and ``slice_quantity``."""
    d = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    at = F.timestamp_micros(F.unix_micros(F.col(start).cast("timestamp")) + F.col("slice").cast("long") * (every_seconds * 1_000_000))
    return d.withColumn("at", at).withColumn("slice_quantity", F.col(quantity) / slices)


def vwap_slices(orders: DataFrame, quantity: str, profile: DataFrame, bucket: str, volume: str) -> DataFrame:
    """Each order split in proportion to a profile of volume by bucket (a few rows)."""
    total = Window.partitionBy()
    p = profile.select(bucket, (F.col(volume) / F.sum(volume).over(total)).alias("_w"))
    arr = p.agg(F.sort_array(F.collect_list(F.struct(bucket, "_w"))).alias("_p"))
    return orders.crossJoin(F.broadcast(arr)).withColumn("_s", F.explode("_p")).withColumn("slice_quantity", F.col(quantity) * F.col("_s._w")).withColumn(bucket, F.col(f"_s.{bucket}")).drop("_p", "_s")


def hedge_ratio(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Least squares of log a on log b: ``beta``, ``alpha``, and the Dickey-Fuller style half-life needs ``spread_half_life``."""
    return df.groupBy(*keys).agg(F.regr_slope(F.log(a), F.log(b)).alias("beta"), F.regr_intercept(F.log(a), F.log(b)).alias("alpha"), F.count(F.lit(1)).alias("n"))


def spread_half_life(df: DataFrame, spread: str, keys: list[str], order: list) -> DataFrame:
    """Regression of the spread's change on its level before: slope, t value and half-life ln 2 / -ln(1 + slope)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_l", F.lag(spread).over(w)).withColumn("_d", F.col(spread) - F.lag(spread).over(w)).where(F.col("_l").isNotNull())
    s = d.groupBy(*keys).agg(F.regr_slope("_d", "_l").alias("slope"), F.regr_sxx("_d", "_l").alias("_x"), F.regr_syy("_d", "_l").alias("_y"), F.count(F.lit(1)).alias("n"))
    error = F.sqrt(F.greatest(F.col("_y") - F.col("slope") * F.col("slope") * F.col("_x"), F.lit(0.0)) / (F.col("n") - 2) / F.col("_x"))
    return s.select(*keys, "n", "slope", ratio("slope", error).alias("t"), F.when((F.col("slope") < 0) & (F.col("slope") > -1), math.log(2) / -F.log(1 + F.col("slope"))).alias("half_life"))


def pairs_trades(df: DataFrame, z: str, key: str, order: str, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> DataFrame:
    """(key, entry, exit, side, reason) of the z-score state machine: in beyond ``enter``, out within ``leave`` or beyond
    ``stop``, closed at the end."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, at, side = [], None, 0
        v, t = pdf[z].to_numpy(float), pdf[order].to_numpy()
        for i, x in enumerate(v):
            if math.isnan(x):
                continue
            if at is None:
                if abs(x) >= enter and abs(x) < stop and i < len(v) - 1:
                    at, side = i, -int(np.sign(x))
            else:
                why = "stop" if abs(x) >= stop else "exit" if abs(x) <= leave else "end" if i == len(v) - 1 else None
                if why:
                    out.append((pdf[key].iloc[0], t[at], t[i], side, why))
                    at = None
        return pd.DataFrame(out, columns=[key, "entry", "exit", "side", "reason"])

    k, o = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    return df.select(key, order, z).groupBy(key).applyInPandas(one, f"{key} {k}, entry {o}, exit {o}, side int, reason string")


def event_study(df: DataFrame, event: Column, forwards: list[str], keys: list[str]) -> DataFrame:
    """Mean forward returns after events, and of all rows; the number of events."""
    aggs = [F.count(F.when(event, 1)).alias("events")]
    for f in forwards:
        aggs += [F.avg(F.when(event, F.col(f))).alias(f"{f}_event"), F.avg(f).alias(f"{f}_base")]
    return df.groupBy(*keys).agg(*aggs)


def carry(df: DataFrame, funding: str, n: int, enter: float, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "tid")) -> DataFrame:
    """``position``: -sign(z) where |z| of funding over the last n rows exceeds ``enter``, and ``carry``: what it earns."""
    k = list(keys)
    d = sequenced(df, k, list(order), order[0], n)
    w = rows(k, n - 1)
    s = F.stddev_samp(funding).over(w)
    z = F.when(s > 1e-12, (F.col(funding) - F.avg(funding).over(w)) / s).otherwise(0.0)
    return drop_halo(d.withColumn("z", z).withColumn("position", F.when(F.abs("z") > enter, -F.signum("z")).otherwise(0.0)).withColumn("carry", -F.col("position") * F.col(funding))).drop("_n")


def tension(flow: np.ndarray, illiquidity: np.ndarray, a: float, b: float, eps: float = 1e-9) -> np.ndarray:
    """Exponential average of flow over that of illiquidity."""
    from fathomline.operators.offline import ewm

    return ewm(flow, a) / (ewm(illiquidity, b) + eps)


def tension_grid(df: DataFrame, flow: str, illiquidity: str, grid: list[tuple[float, float]], key: str = "symbol", order: str = "ts") -> DataFrame:
    """Mean and deviation of the tension of each key at each point of a grid of smoothing constants."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        f, i = pdf[flow].to_numpy(float), pdf[illiquidity].to_numpy(float)
        t = [tension(f, i, a, b) for a, b in grid]
        return pd.DataFrame({key: pdf[key].iloc[0], "alpha": [a for a, _ in grid], "beta": [b for _, b in grid], "mean": [x.mean() for x in t], "std": [x.std() for x in t]})

    return df.select(key, order, flow, illiquidity).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, alpha double, beta double, mean double, std double")


def ranking(runs: DataFrame, name: str, date: str, value: str, short: int = 7, long: int = 30) -> DataFrame:
    """Of each run its latest rolling Sharpe ratios over two windows of rows and win rate, ranked by their mean rank."""
    w = Window.partitionBy(name).orderBy(F.col(date).desc())
    d = runs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= long)
    sr = lambda c: ratio(F.avg(c), F.stddev_samp(c)) * math.sqrt(365)
    s = F.when(F.col("_k") <= short, F.col(value))
    out = d.groupBy(name).agg(sr(s).alias("sharpe_short"), sr(F.col(value)).alias("sharpe_long"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))
    r = lambda c: F.rank().over(Window.orderBy(F.desc(c)))  # noqa: E731  a row for each run
    out = out.withColumn("_m", (r("sharpe_short") + r("sharpe_long") + r("win_rate")) / 3)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("_m", name))).drop("_m")


def digital_probability(spot: Column, strike: Column, sigma: Column, years: Column) -> Column:
    """P(S_T > K) of a driftless lognormal, normal distribution by the same approximation as ``stats.normal_p``."""
    from fathomline.operators.stats import normal_p

    d = (F.log(spot / strike) - 0.5 * sigma * sigma * years) / (sigma * F.sqrt(years))
    tail = normal_p(d) / 2
    return F.when(d >= 0, 1 - tail).otherwise(tail)


def quotes(mid: Column, inventory: Column, gamma: float, sigma: Column, tau: Column, kappa: float) -> tuple[Column, Column]:
    """Inventory-aware bid and ask: reservation price mid - q gamma sigma^2 tau, spread gamma sigma^2 tau + 2 / gamma ln(1 + gamma / kappa)."""
    v = gamma * sigma * sigma * tau
    half = (v + 2 / gamma * math.log(1 + gamma / kappa)) / 2
    centre = mid - inventory * v
    return centre - half, centre + half


def fifo_pairs(fills: DataFrame, key: str, order: str, side: str, price: str) -> DataFrame:
    """Each fill matched with the oldest open one of the other side: (key, pairs, unmatched, pnl) in unit size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        open_, pairs, pnl = {1: deque(), -1: deque()}, 0, 0.0
        for s, p in pdf.sort_values(order)[[side, price]].itertuples(index=False):
            if open_[-s]:
                q = open_[-s].popleft()
                pairs, pnl = pairs + 1, pnl + s * (q - p)
            else:
                open_[s].append(p)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "pairs": [pairs], "unmatched": [len(open_[1]) + len(open_[-1])], "pnl": [pnl]})

    return fills.select(key, order, side, price).groupBy(key).applyInPandas(one, f"{key} {fills.schema[key].dataType.simpleString()}, pairs long, unmatched long, pnl double")


def no_trade_band(target: np.ndarray, band: float) -> np.ndarray:
    """Position that follows the target only when it is further away than the band."""
    out, now = np.empty(len(target)), 0.0
    for i, t in enumerate(target):
        now = t if abs(t - now) > band else now
        out[i] = now
    return out
