"""Costs, the single-position backtest, walk-forward validation, portfolio arithmetic, fill simulation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import ratio
from fathomline.functions.windows import drop_halo, rows, sequenced


@dataclass(frozen=True)
class Costs:
    """One-way cost in bps is fee plus slippage; funding is per hour, paid by longs where positive."""

    fee_bps: float = 4.5
    slip_bps: float = 1.0
    funding_hour: float = 0.0

    @property
    def one_way(self) -> float:
        return (self.fee_bps + self.slip_bps) / 1e4


@dataclass(frozen=True)
class Strategy:
    """Entry and exit are boolean columns; stop and target are shares of the entry price; ``hold`` is in rows."""

    side: int = 1
    stop: float = 0.02
    target: float = 0.03
    hold: int = 20


def simulate(price: np.ndarray, entry: np.ndarray, exit_: np.ndarray, s: Strategy, c: Costs, hours_per_row: float = 24.0) -> list[dict]:
    """One position at a time. Exits are tried in the order stop, target, time, signal on the profit after costs; no entry
    on the row of an exit; an open position is closed on the last row."""
    trades, at = [], None
    for i, p in enumerate(price):
        if at is None:
            if entry[i] and i < len(price) - 1:
                at = i
            continue
        gross = s.side * (p / price[at] - 1)
        net = gross - 2 * c.one_way - s.side * c.funding_hour * hours_per_row * (i - at)
        why = "stop" if net <= -s.stop else "target" if net >= s.target else "time" if i - at >= s.hold else "signal" if exit_[i] else "end" if i == len(price) - 1 else None
        if why:
            trades.append({"entry": at, "exit": i, "pnl": net, "reason": why})
            at = None
    return trades


def backtest(df: DataFrame, strategy: Strategy, costs: Costs, price: str = "close", key: str = "symbol", order: str = "date") -> DataFrame:
    """Trades of a strategy for each key: (key, entry_ts, exit_ts, pnl, reason). The position is a state machine over the
    key's bars, so a key's bars go to one Python call."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p = pdf[price].where(pdf[price] > 0).ffill().to_numpy(float)
        got = simulate(p, pdf["entry"].to_numpy(bool), pdf["exit"].to_numpy(bool), strategy, costs)
        ts = pdf[order].to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(got), "entry_ts": [ts[t["entry"]] for t in got], "exit_ts": [ts[t["exit"]] for t in got], "pnl": [t["pnl"] for t in got], "reason": [t["reason"] for t in got]})

    kind, when = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    return df.select(key, order, price, "entry", "exit").groupBy(key).applyInPandas(one, f"{key} {kind}, entry_ts {when}, exit_ts {when}, pnl double, reason string")


def metrics(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Trades, compounded return, win rate, profit factor, and Sharpe of the trades."""
    x = F.col("pnl")
    out = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.exp(F.sum(F.log1p(x))) - 1).alias("total_return"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        ratio(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x)), None).alias("profit_factor"),
        ratio(F.avg(x), F.stddev_samp(x)).alias("sharpe"),
    )
    return out


def max_drawdown(df: DataFrame, keys: list[str], order: list, pnl: str) -> DataFrame:
    """Largest fall of the running sum of profits from its peak (0 at the start)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_e", F.sum(pnl).over(w))
    d = d.withColumn("_p", F.greatest(F.max("_e").over(w), F.lit(0.0)))
    return d.groupBy(*keys).agg(F.max(F.col("_p") - F.col("_e")).alias("max_drawdown"))


def sharpe(x: str | Column, per_year: float = 252.0) -> Column:
    s = F.stddev_samp(x)
    return F.when(s > 0, F.avg(x) / s * math.sqrt(per_year)).otherwise(0.0)


def walk_forward(df: DataFrame, folds: int, train: float, embargo: int, signal: str, forward: str, keys: list[str], order: list) -> DataFrame:
    """For each key and fold: Sharpe of sign(signal) * forward within the fold's training rows and its later test rows,
    ``embargo`` rows left out between them, and their ratio."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    d = df.withColumns({"_i": i, "_c": n}).withColumn("fold", F.least(F.floor(F.col("_i") * folds / F.col("_c")), F.lit(folds - 1)))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "fold").orderBy("_i")) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*keys, "fold")))
    cut = F.floor(F.col("_m") * train)
    pnl = F.signum(signal) * F.col(forward)
    d = d.withColumn("_is", F.when(F.col("_k") < cut, pnl)).withColumn("_oos", F.when(F.col("_k") >= cut + embargo, pnl))
    out = d.groupBy(*keys, "fold").agg(sharpe("_is").alias("is_sharpe"), sharpe("_oos").alias("oos_sharpe"), F.count("_oos").alias("oos_rows"))
    return out.withColumn("oos_is_ratio", ratio("oos_sharpe", "is_sharpe"))


def purged_splits(n: int, groups: int, test: int, embargo: int) -> list[tuple[list[int], list[int]]]:
    """Combinatorial purged splits of n rows: every choice of ``test`` of ``groups`` blocks; training rows within
    ``embargo`` rows after a test block are left out."""
    edges = [n * g // groups for g in range(groups + 1)]
    out = []
    for pick in combinations(range(groups), test):
        held = {i for g in pick for i in range(edges[g], edges[g + 1])}
        near = {i for g in pick for i in range(edges[g + 1], min(n, edges[g + 1] + embargo))} | {i for g in pick for i in range(max(0, edges[g] - embargo), edges[g])}
        out.append(([i for i in range(n) if i not in held and i not in near], sorted(held)))
    return out


def _inverse_normal(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def deflated_sharpe(sr: float, trials: int, n: int, variance: float, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """Probability that a Sharpe ratio (per period) beats the best expected of ``trials`` useless ones."""
    from statistics import NormalDist

    g = 0.5772156649015329
    best = math.sqrt(variance) * ((1 - g) * _inverse_normal(1 - 1 / trials) + g * _inverse_normal(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    d = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return NormalDist().cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(max(d, 1e-12)))


def quantile_edges(df: DataFrame, signal: str, forward: str, keys: list[str], n: int = 5) -> DataFrame:
    """Mean forward return and rows of each of n quantile buckets of the signal, edges interpolated."""
    cuts = df.where(F.col(signal).isNotNull()).groupBy(*keys).agg(F.percentile(signal, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_q"))
    b = F.size(F.filter("_q", lambda q: q < F.col(signal)))
    return df.where(F.col(signal).isNotNull() & F.col(forward).isNotNull()).join(F.broadcast(cuts), keys).groupBy(*keys, b.alias("bucket")).agg(F.avg(forward).alias("mean_forward"), F.count(F.lit(1)).alias("n"))


def maker_fills(df: DataFrame, half_spreads_bps: tuple[float, ...], fee_bps: float, keys: list[str]) -> DataFrame:
    """For rows with ``mid``, ``future_min``, ``future_max`` and each half-spread: share of rows with both sides filled, one,
    or none, and mean profit in bps (both: the spread less two fees; one: minus the adverse move beyond the quote)."""
    parts = []
    for h in half_spreads_bps:
        bid, ask = F.col("mid") * (1 - h / 1e4), F.col("mid") * (1 + h / 1e4)
        hit_b, hit_a = F.col("future_min") <= bid, F.col("future_max") >= ask
        adverse_b, adverse_a = (bid - F.col("future_min")) / F.col("mid") * 1e4, (F.col("future_max") - ask) / F.col("mid") * 1e4
        pnl = F.when(hit_b & hit_a, 2 * h - 2 * fee_bps).when(hit_b, h - adverse_b - fee_bps).when(hit_a, h - adverse_a - fee_bps).otherwise(0.0)
        parts.append(F.struct(F.lit(h).alias("half_spread_bps"), hit_b.alias("b"), hit_a.alias("a"), pnl.alias("pnl")))
    d = df.where("future_min IS NOT NULL").select(*keys, F.explode(F.array(*parts)).alias("x")).select(*keys, "x.*")
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy(*keys, "half_spread_bps").agg(share(F.col("a") & F.col("b")).alias("both"), share(F.col("a") != F.col("b")).alias("one"), share(~F.col("a") & ~F.col("b")).alias("none"), F.avg("pnl").alias("pnl_bps"))


def inverse_vol_weights(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 / deviation of each key's returns, normalised to one."""
    v = df.groupBy(*keys).agg(F.stddev_samp(value).alias("vol")).where(F.col("vol") > 0)
    return v.withColumn("weight", (1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(Window.partitionBy()))


def beta_neutral(df: DataFrame, date: str, key: str, score: str, beta: str) -> DataFrame:
    """Weights of each date: scores less their mean and less their projection on beta, scaled to gross exposure 1."""
    w = Window.partitionBy(date)
    d = df.withColumn("_s", F.col(score) - F.avg(score).over(w)).withColumn("_b", F.col(beta) - F.avg(beta).over(w))
    d = d.withColumn("_r", F.col("_s") - ratio(F.sum(F.col("_s") * F.col("_b")).over(w), F.sum(F.col("_b") * F.col("_b")).over(w)) * F.col("_b"))
    gross = F.sum(F.abs("_r")).over(w)  # what is left below 1e-9 is rounding
    return d.withColumn("weight", F.when(gross > 1e-9, F.col("_r") / gross).otherwise(0.0)).drop("_s", "_b", "_r")


def kelly(p: Column, b: Column) -> Column:
    """(p b - (1 - p)) / b, 0 at least."""
    return F.greatest((p * b - (1 - p)) / b, F.lit(0.0))


def rolling_beta(df: DataFrame, y: str, x: str, n: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
    """``beta`` of y on x over the last n rows, null until full."""
    k = list(keys)
    d = sequenced(df, k, list(order), order[0], n)
    w = rows(k, n - 1)
    return drop_halo(d.withColumn("beta", F.when(F.count(F.col(y) + F.col(x)).over(w) == n, F.regr_slope(F.col(y), F.col(x)).over(w)))).drop("_n")


def kill_switch(drawdown: Column, losses: Column, ic: Column) -> Column:
    """ok, reduce or halt by drawdown, consecutive losses and information coefficient."""
    return F.when((drawdown >= 0.2) | (losses >= 10), "halt").when((drawdown >= 0.1) | (losses >= 5) | (ic < 0), "reduce").otherwise("ok")
