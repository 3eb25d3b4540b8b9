"""Offline features over bars and daily series: moments, volatility components, labels, derivatives, indicators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.numeric import ratio
from fathomline.functions.windows import drop_halo, rows, sequenced


def _frames(df: DataFrame, back: int, ahead: int = 0, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
    return sequenced(df, list(keys), list(order), order[0], back, ahead)


def forward_returns(df: DataFrame, horizons: tuple[int, ...], price: str = "close", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``fwd_{h}``: the price h rows later over this one, less 1; null at the end."""
    k = list(keys)
    d = _frames(df, 0, max(horizons), keys)
    d = d.withColumns({f"fwd_{h}": F.lead(price, h).over(rows(k)) / F.col(price) - 1 for h in horizons})
    return drop_halo(d).drop("_n")


def future_extremes(df: DataFrame, horizon: int, price: str = "close", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``future_min`` and ``future_max`` over the next ``horizon`` rows, null where there are fewer."""
    k = list(keys)
    d = _frames(df, 0, horizon, keys)
    w = rows(k, -1, horizon)
    full = F.count(price).over(w) == horizon
    d = d.withColumn("future_min", F.when(full, F.min(price).over(w))).withColumn("future_max", F.when(full, F.max(price).over(w)))
    return drop_halo(d).drop("_n")


def triple_barrier(df: DataFrame, horizon: int, up: float, down: float, vol_rows: int = 20, price: str = "close", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``barrier``: 1 if price * exp(up * vol) is touched first within ``horizon`` rows, -1 for price * exp(-down * vol), 0 for
    neither (the upper one wins in a row that touches both); null where the horizon passes the end or volatility isn't
    known. vol: sample deviation of the last ``vol_rows`` log returns times sqrt(horizon)."""
    k = list(keys)
    d = _frames(df, vol_rows + 1, horizon, keys)
    d = d.withColumn("_lr", F.log(F.col(price) / F.lag(price).over(rows(k))))
    w = rows(k, vol_rows - 1)
    vol = F.when(F.count("_lr").over(w) == vol_rows, F.stddev_samp("_lr").over(w) * math.sqrt(horizon))
    d = d.withColumn("_vol", vol).withColumn("_next", F.collect_list(price).over(rows(k, -1, horizon)))
    upper, lower = F.col(price) * F.exp(up * F.col("_vol")), F.col(price) * F.exp(-down * F.col("_vol"))
    hit = F.aggregate("_next", F.lit(0), lambda s, x: F.when(s != 0, s).when(x >= upper, 1).when(x <= lower, -1).otherwise(0))
    d = d.withColumn("barrier", F.when((F.size("_next") == horizon) & F.col("_vol").isNotNull(), hit))
    return drop_halo(d).drop("_n", "_lr", "_vol", "_next")


def rv_components(df: DataFrame, windows: dict[str, int], annual: float = 252.0, ret: str = "ret", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``rv_{name}``: sqrt(mean squared return * annual) over the last rows of each window (null until full), and the ratio
    of the first to the last."""
    k = list(keys)
    d = _frames(df, max(windows.values()), keys=keys)
    for name, n in windows.items():
        w = rows(k, n - 1)
        d = d.withColumn(f"rv_{name}", F.when(F.count(ret).over(w) == n, F.sqrt(F.avg(F.col(ret) * F.col(ret)).over(w) * annual)))
    first, last = next(iter(windows)), list(windows)[-1]
    return drop_halo(d.withColumn("rv_ratio", ratio(f"rv_{first}", f"rv_{last}", None))).drop("_n")


def har_fit(components: DataFrame, target: str, names: list[str], keys: list[str]) -> DataFrame:
    """Least squares of log target on log components for each key: the sums are aggregated, only they reach the driver
    side of the solver. (keys, n, beta array: constant first)"""
    logs = [F.log(c) for c in names]
    d = components.where(F.col(target) > 0).where(" AND ".join(f"{c} > 0" for c in names)).select(*keys, F.log(target).alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate(logs)])
    cols = [F.lit(1.0)] + [F.col(f"_x{i}") for i in range(len(names))]
    m = len(cols)
    sums = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)], *[F.sum(cols[i] * F.col("_y")).alias(f"b{i}") for i in range(m)])

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
                out.append(np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(m)], float), rcond=None)[0].tolist())
            yield pd.DataFrame({**{c: pdf[c] for c in keys}, "n": pdf["n"], "beta": out})

    kinds = ", ".join(f"{c} {components.schema[c].dataType.simpleString()}" for c in keys)
    return sums.mapInPandas(solve, f"{kinds}, n long, beta array<double>")


def rolling_percentile(df: DataFrame, n: int, column: str, keys: tuple[str, ...] = ("symbol",), least: int = 10) -> DataFrame:
    """``pct``: average rank of the last value within the last n, as a share; null for fewer than ``least``."""
    k = list(keys)
    d = _frames(df, n, keys=keys).withColumn("_all", F.collect_list(column).over(rows(k, n - 1)))
    x = F.col(column)
    below, same = F.size(F.filter("_all", lambda v: v < x)), F.size(F.filter("_all", lambda v: v == x))
    return drop_halo(d.withColumn("pct", F.when(F.size("_all") >= least, (below + (same + 1) / 2) / F.size("_all")))).drop("_n", "_all")


def temporal_derivatives(df: DataFrame, column: str, windows: tuple[int, ...], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Velocity, acceleration, and for each window rolling z-score, slope and volatility of the changes (null until full)."""
    k = list(keys)
    d = _frames(df, max(windows) + 2, keys=keys)
    d = d.withColumn("vel", F.col(column) - F.lag(column).over(rows(k)))
    d = d.withColumn("accel", F.col("vel") - F.lag("vel").over(rows(k)))
    for n in windows:
        w = rows(k, n - 1)
        full = F.count(column).over(w) == n
        s = F.stddev_samp(column).over(w)
        d = d.withColumns(
            {
                f"z_{n}": F.when(full & (s > 1e-12), (F.col(column) - F.avg(column).over(w)) / s),
                f"slope_{n}": F.when(full, F.regr_slope(F.col(column), F.col("_n").cast("double")).over(w)),
                f"vol_{n}": F.when(F.count("vel").over(w) == n, F.stddev_samp("vel").over(w)),
            }
        )
    return drop_halo(d).drop("_n")


def cross_derivatives(df: DataFrame, a: str, b: str, n: int, clip_at: float = 10.0, eps: float = 1e-9, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Clipped ratio, rolling correlation, and difference of rolling z-scores of two columns."""
    k = list(keys)
    d = _frames(df, n, keys=keys)
    w = rows(k, n - 1)
    z = lambda c: ratio(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w), None)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    full = F.count(F.lit(1)).over(w) == n
    d = d.withColumn("ratio", F.least(F.greatest(F.col(a) / (F.col(b) + eps), F.lit(-clip_at)), F.lit(clip_at)))
    d = d.withColumn("corr", F.when(full & (spread > 1e-12), F.covar_pop(a, b).over(w) / spread)).withColumn("z_divergence", F.when(full, z(a) - z(b)))
    return drop_halo(d).drop("_n")


def settlement_clock(ts: Column, hours: int = 8) -> dict[str, Column]:
    """Seconds to the next and since the last mark of ``hours``, the phase as sine and cosine, and the weekend flag."""
    size = hours * 3600
    since = F.unix_seconds(ts.cast("timestamp")) % size
    phase = 2 * math.pi * since / size
    return {"since_mark": since, "to_mark": size - since, "phase_sin": F.sin(phase), "phase_cos": F.cos(phase), "weekend": (F.weekday(ts) >= 5).cast("int")}


def indicators(df: DataFrame, sma: tuple[int, ...] = (7, 20, 50), span: int = 50, price: str = "close", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Simple averages (null until full), support and resistance (rolling extremes of ``span`` rows), relative volume."""
    k = list(keys)
    d = _frames(df, max(*sma, span), keys=keys)
    for n in sma:
        w = rows(k, n - 1)
        d = d.withColumn(f"sma_{n}", F.when(F.count(price).over(w) == n, F.avg(price).over(w)))
    w = rows(k, span - 1)
    d = d.withColumns({"resistance": F.max("high").over(w), "support": F.min("low").over(w), "rel_volume": F.col("volume") / F.avg("volume").over(w)})
    return drop_halo(d).drop("_n")


def macro_signal(df: DataFrame, fast: str = "sma_20", slow: str = "sma_50", price: str = "close", zone: float = 0.01) -> DataFrame:
    """Direction: long above both averages with the fast one above, short mirrored, neutral within ``zone`` of the slow one;
    strength: distance to the slow one over 10 %, 1 at most."""
    gap = F.col(price) / F.col(slow) - 1
    up = (gap > zone) & (F.col(fast) > F.col(slow))
    down = (gap < -zone) & (F.col(fast) < F.col(slow))
    return df.withColumn("direction", F.when(F.col(slow).isNull(), None).when(up, 1).when(down, -1).otherwise(0)).withColumn("strength", F.least(F.abs(gap) / 0.1, F.lit(1.0)))


def ewm(values: np.ndarray, alpha: float, adjust: bool = False) -> np.ndarray:
    """Exponential average, seeded with the first value; with ``adjust`` weights are normalised at each step. NaN holds."""
    out, num, den, last = np.empty(len(values)), 0.0, 0.0, np.nan
    for i, x in enumerate(values):
        if not math.isnan(x):
            if adjust:
                num, den = (1 - alpha) * num + x, (1 - alpha) * den + 1
                last = num / den
            else:
                last = x if math.isnan(last) else alpha * x + (1 - alpha) * last
        out[i] = last
    return out


def wilder(values: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then (previous * (n - 1) + x) / n; NaN before."""
    out = np.full(len(values), np.nan)
    if len(values) >= n:
        out[n - 1] = values[:n].mean()
        for i in range(n, len(values)):
            out[i] = (out[i - 1] * (n - 1) + values[i]) / n
    return out


def recursive_indicators(df: DataFrame, price: str = "close", key: str = "symbol", order: str = "date") -> DataFrame:
    """EMA 12 and 26, MACD, RSI and ATR by Wilder's averages (14), and the EWM variant of RSI: recursions over a key's whole
    series, which go to Python by key. For daily bars; a key's rows must fit a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        c, h, lo = (pdf[x].to_numpy(float) for x in (price, "high", "low"))
        d = np.diff(c, prepend=c[0])
        gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
        tr = np.maximum(h - lo, np.maximum(np.abs(h - np.roll(c, 1)), np.abs(lo - np.roll(c, 1))))
        tr[0] = h[0] - lo[0]
        g, s = wilder(gain[1:], 14), wilder(loss[1:], 14)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(s == 0, np.where(g == 0, 50.0, 100.0), 100 - 100 / (1 + g / s))
            eg, es = ewm(gain, 2 / 15), ewm(loss, 2 / 15)
            rsi_ewm = np.where(es == 0, 100 - 100 / 101, 100 - 100 / (1 + eg / es))
        rsi[np.isnan(g)] = np.nan
        e12, e26 = ewm(c, 2 / 13), ewm(c, 2 / 27)
        out = pdf[[key, order]].copy()
        return out.assign(ema_12=e12, ema_26=e26, macd=e12 - e26, rsi_14=np.concatenate(([np.nan], rsi)), atr_14=wilder(tr, 14), rsi_ewm_14=rsi_ewm)

    cols = list(dict.fromkeys([key, order, price, "high", "low"]))
    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}"
    return df.select(*cols).groupBy(key).applyInPandas(one, f"{kinds}, ema_12 double, ema_26 double, macd double, rsi_14 double, atr_14 double, rsi_ewm_14 double")


def step_ofi(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Order-flow imbalance of adjacent top-of-book rows (bid, bid_size, ask, ask_size): size added at or above the old bid
    less size removed, minus the same on the ask."""
    k = list(keys)
    d = sequenced(df, k, list(order), order[0], 1)
    was = lambda c: F.lag(c).over(rows(k))
    b = F.when(F.col("bid") > was("bid"), F.col("bid_size")).when(F.col("bid") == was("bid"), F.col("bid_size") - was("bid_size")).otherwise(-was("bid_size"))
    a = F.when(F.col("ask") < was("ask"), F.col("ask_size")).when(F.col("ask") == was("ask"), F.col("ask_size") - was("ask_size")).otherwise(-was("ask_size"))
    return drop_halo(d.withColumn("ofi", F.coalesce(b - a, F.lit(0.0)))).drop("_n")
