"""Price-buffer operators over frames of rows: volatility, trend, entropy, and recursive averages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fathomline.functions.numeric import clip, plogp, ratio, zscore
from fathomline.functions.windows import drop_halo, row_sum, rows, running, sequenced

LN2 = math.log(2)


def prepared(df: DataFrame, back: int, price: str = "price", keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "tid")) -> DataFrame:
    """Rows numbered and halo'd for frames of ``back`` rows, with the simple return ``ret`` (0 after a zero price)."""
    df = sequenced(df, list(keys), list(order), order[0], back + 1)
    before = F.lag(price).over(rows(list(keys)))
    return df.withColumn("ret", F.when(before.isNotNull(), F.when(before != 0, F.col(price) / before - 1).otherwise(0.0)))


def realized(k: list[str], n: int) -> Column:
    """Root mean square of the last n returns (fewer while there are fewer), from running sums ``_r2`` and ``_rc``."""
    return F.coalesce(F.sqrt(F.greatest(ratio(row_sum("_r2", k, n), row_sum("_rc", k, n), None), F.lit(0.0))), F.lit(0.0))


def _with_return_sums(df: DataFrame, k: list[str]) -> DataFrame:
    r2 = F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))
    return df.withColumn("_r2", F.sum(r2).over(running(k))).withColumn("_rc", F.count("ret").over(running(k)).cast("double"))


def parkinson(k: list[str], n: int, price: str = "price") -> Column:
    w = rows(k, n - 1)
    return F.when(F.min(price).over(w) > 0, F.log(F.max(price).over(w) / F.min(price).over(w)) / math.sqrt(4 * LN2)).otherwise(0.0)


def garman_klass(k: list[str], n: int, price: str = "price") -> Column:
    """From the frame's open, high, low and close."""
    w = rows(k, n - 1)
    hl, co = F.log(F.max(price).over(w) / F.min(price).over(w)), F.log(F.col(price) / F.first(price).over(w))
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * hl * hl - (2 * LN2 - 1) * co * co))


def volatility_block(df: DataFrame, short: int = 60, long: int = 300, history: int = 36_000, price: str = "price", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Realised volatility short and long, their ratio (1 where long is 0), Parkinson, Garman-Klass, and a z-score of the
    short one against its earlier values (120 at least, clipped at 10)."""
    k = list(keys)
    df = _with_return_sums(prepared(df, long + history, price, keys), k)
    df = df.withColumns({"vol_returns_short": realized(k, short), "vol_returns_long": realized(k, long), "vol_parkinson": parkinson(k, long, price), "vol_garman_klass": garman_klass(k, long, price)})
    # Moments of the earlier values from running sums: a frame of this length would be added up for every row.
    v = F.col("vol_returns_short")
    df = df.withColumns({"_v1": F.sum(v).over(running(k)), "_v2": F.sum(v * v).over(running(k))})
    df = df.withColumns({"_h1": row_sum("_v1", k, history, 1), "_h2": row_sum("_v2", k, history, 1)})
    n = F.least(F.col("_n"), F.lit(history)).cast("double")
    mean = ratio("_h1", n)
    std = F.sqrt(F.greatest(ratio(F.col("_h2") - F.col("_h1") * mean, n - 1), F.lit(0.0)))
    df = df.withColumn("vol_ratio", ratio("vol_returns_short", "vol_returns_long", 1.0))
    df = df.withColumn("vol_zscore", F.when(n >= 120, clip(zscore("vol_returns_short", mean, std), -10, 10)).otherwise(0.0))
    return drop_halo(df).drop("_n", "ret", "_r2", "_rc", "_v1", "_v2", "_h1", "_h2")


def slope_r2(k: list[str], n: int) -> tuple[Column, Column]:
    """Least-squares slope and fit of the price on 0 .. n - 1, from the running sums of ``_with_price_sums``."""
    m = F.least(F.col("_n") + 1, F.lit(n)).cast("double")
    sy, sy2, sxy = row_sum("_y1", k, n), row_sum("_y2", k, n), row_sum("_xy", k, n)
    first = F.col("_x") - m + 1
    sxx = m * (m * m - 1) / 12
    cxy = sxy - first * sy - (m - 1) / 2 * sy
    syy = sy2 - sy * sy / m
    slope = ratio(cxy, sxx, None)
    return slope, F.when(syy > 1e-9, F.least(cxy * cxy / (sxx * syy), F.lit(1.0))).otherwise(F.when(m > 1, 1.0))


def _with_price_sums(df: DataFrame, k: list[str], price: str) -> DataFrame:
    """Running sums of the price (less the bucket's first), its square, its product with the row's number, and moves."""
    w = running(k)
    df = df.withColumns({"_x": (F.col("_n") - F.min("_n").over(w)).cast("double"), "_y": F.col(price) - F.first(price).over(w)})
    y, x = F.col("_y"), F.col("_x")
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0)).over(w)
    return df.withColumns({"_y1": F.sum(y).over(w), "_y2": F.sum(y * y).over(w), "_xy": F.sum(x * y).over(w), "_up": one(F.col("ret") > 0), "_down": one(F.col("ret") < 0)})


def monotonicity(k: list[str], n: int) -> Column:
    """Share of the more frequent direction among the moves of the last n prices; 0.5 if none moves."""
    up, down = row_sum("_up", k, n - 1), row_sum("_down", k, n - 1)
    return ratio(F.greatest(up, down), up + down, 0.5)


def seeded_ema(x: np.ndarray, period: int, buffer: int) -> np.ndarray:
    """For each place the EMA (alpha 2 / (period + 1)) over the last ``buffer`` values, seeded with the first of these."""
    q = 1 - 2 / (period + 1)
    weights = (1 - q) * q ** np.arange(buffer)
    weights[-1] = q ** (buffer - 1)
    out = np.convolve(x, weights)[: len(x)]
    # Before the buffer is full, the first value has the weight of all that would come before it.
    some = np.arange(min(buffer - 1, len(x)))
    out[some] += (q ** some - weights[some]) * x[0] if len(x) else 0.0
    return out


def with_emas(df: DataFrame, price: str, keys: list[str], periods: dict[str, int], buffer: int) -> DataFrame:
    """``df`` (from ``row_halo``) with a column for each period, by one pass over each bucket's rows."""
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in periods]])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        x = table.column(price).cast("double").to_numpy()
        for c, period in periods.items():
            table = table.append_column(c, pa.array(seeded_ema(x, period, buffer)))
        return table

    return df.groupBy(*keys, "_bucket").applyInArrow(one, schema)


def trend_block(df: DataFrame, windows: tuple[int, ...] = (60, 300), ema_buffer: int = 300, least: int = 20, price: str = "price", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Slope, fit and monotonicity for each window, the EMA pair (10, 50) over the buffer and its crossover in percent of
    the long one. With fewer than ``least`` prices: 0, and 0.5 for monotonicity."""
    k = list(keys)
    df = _with_price_sums(prepared(df, max(*windows, ema_buffer), price, keys), k, price)
    enough = F.col("_n") >= least - 1
    for n in windows:
        slope, r2 = slope_r2(k, n)
        df = df.withColumns(
            {
                f"trend_momentum_{n}": F.when(enough, F.coalesce(slope, F.lit(0.0))).otherwise(0.0),
                f"trend_momentum_r2_{n}": F.when(enough, F.coalesce(r2, F.lit(0.0))).otherwise(0.0),
                f"trend_monotonicity_{n}": F.when(enough, monotonicity(k, n)).otherwise(0.5),
            }
        )
    df = with_emas(df, price, k, {"_ema_short": 10, "_ema_long": 50}, ema_buffer)
    df = df.withColumn("trend_ema_short", F.when(enough, F.col("_ema_short")).otherwise(0.0)).withColumn("trend_ema_long", F.when(enough, F.col("_ema_long")).otherwise(0.0))
    df = df.withColumn("trend_crossover", F.col("trend_ema_short") - F.col("trend_ema_long")).withColumn("trend_crossover_norm", 100 * ratio("trend_crossover", "trend_ema_long"))
    return drop_halo(df).drop("_n", "ret", "_ema_short", "_ema_long", "_x", "_y", "_y1", "_y2", "_xy", "_up", "_down")


def permutation_entropy(df: DataFrame, n: int, order: int = 3, value: str = "ret", price: str = "price", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Normalised permutation entropy of the last n values: patterns of ``order`` consecutive ones, ties by position.
    0 while there are fewer than n values."""
    k = list(keys)
    df = prepared(df, n + order, price, keys)
    lags = [F.lag(value, order - 1 - i).over(rows(k)) for i in range(order)]
    ordered = F.sort_array(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(lags)]))
    df = df.withColumn("_pattern", F.when(lags[0].isNotNull(), F.array_join(F.transform(ordered, lambda x: x.i.cast("string")), "")))
    patterns, w = n - order + 1, rows(k, n - order)
    df = df.withColumn("_all", F.collect_list("_pattern").over(w))
    counted = F.transform(F.array_distinct("_all"), lambda p: F.size(F.filter("_all", lambda q: q == p)) / patterns)
    h = F.aggregate(counted, F.lit(0.0), lambda s, p: s + plogp(p)) / math.log(math.factorial(order))
    df = df.withColumn(f"ent_permutation_{n}", F.when(F.size("_all") == patterns, h).otherwise(0.0))
    return drop_halo(df).drop("_n", "ret", "_pattern", "_all")


def returns_entropy(df: DataFrame, n: int, bins: int = 10, price: str = "price", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Shannon entropy of the last n returns in ``bins`` bins of equal width over the frame's range, over ln(bins)."""
    k = list(keys)
    df = prepared(df, n, price, keys).withColumn("_all", F.collect_list("ret").over(rows(k, n - 1)))
    low, high = F.array_min("_all"), F.array_max("_all")
    bin_ = F.transform("_all", lambda x: F.least(F.floor((x - low) / (high - low) * bins).cast("int"), F.lit(bins - 1)))
    df = df.withColumn("_bins", F.when(high - low > 1e-10, bin_))
    counted = F.transform(F.array_distinct("_bins"), lambda p: F.size(F.filter("_bins", lambda q: q == p)) / F.size("_bins"))
    h = F.aggregate(counted, F.lit(0.0), lambda s, p: s + plogp(p)) / math.log(bins)
    return drop_halo(df.withColumn(f"ent_dispersion_{n}", F.when(F.size("_all") >= n, F.coalesce(h, F.lit(0.0))).otherwise(0.0))).drop("_n", "ret", "_all", "_bins")


def hurst(prices: np.ndarray) -> float:
    """Rescaled-range exponent: chunk sizes from 8, each half as large again, to half the length; 0.5 without a fit."""
    x = np.diff(np.asarray(prices, float))
    sizes, s = [], 8
    while s <= len(x) // 2:
        sizes.append(s)
        s = math.ceil(1.5 * s)
    points = []
    for s in sizes:
        c = x[: len(x) // s * s].reshape(-1, s)
        sd = c.std(axis=1)
        y = np.cumsum(c - c.mean(axis=1, keepdims=True), axis=1)
        rs = (y.max(axis=1) - y.min(axis=1))[sd > 1e-12] / sd[sd > 1e-12]
        if len(rs) and rs.mean() > 0:
            points.append((math.log(s), math.log(rs.mean())))
    if len(points) < 2:
        return 0.5
    slope = np.polyfit(*zip(*points), 1)[0]
    return float(min(1.0, max(0.0, slope)))


def hurst_by_key(df: DataFrame, n: int, price: str = "price", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``hurst`` over the last n prices at every n-th row of a key: blocks of rows, not whole keys, go to Python."""
    from fathomline.functions.windows import numbered

    k = list(keys)
    blocks = numbered(df, k, ["ts", "tid"], "ts").withColumn("block", F.floor(F.col("_n") / n))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in k}, "block": [pdf["block"].iloc[0]], "rows": [len(pdf)], "hurst": [hurst(pdf[price].to_numpy())]})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in k)
    return blocks.select(*k, "block", "_n", price).groupBy(*k, "block").applyInPandas(one, f"{kinds}, block long, rows long, hurst double")


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, price: str = "close", keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Band position and width, population deviation; 0.5 and 0 for a flat frame, null before n rows."""
    k = list(keys)
    df = sequenced(df, k, list(order), order[0], n)
    w = rows(k, n - 1)
    mean, sd = F.avg(price).over(w), F.stddev_pop(price).over(w)
    full = F.col("_n") >= n - 1
    df = df.withColumn("bb_pct", F.when(full, F.when(sd > 1e-12, (F.col(price) - mean + width * sd) / (2 * width * sd)).otherwise(0.5)))
    return drop_halo(df.withColumn("bb_width", F.when(full, ratio(2 * width * sd, mean)))).drop("_n")
