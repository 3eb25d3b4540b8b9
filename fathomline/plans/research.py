"""Queries of offline features, labels and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import backtest, offline
from fathomline.plans.adapters import CANDLES, TRADES, candles, rounded, trades
from fathomline.plans.catalogue import register
from fathomline.plans.stats import _PANEL, panel

_O = "PARTITION BY symbol ORDER BY date"


def _key(df, *cols):
    return rounded(df.select("symbol", "date", *cols))


@register("forward_returns", f"WITH {CANDLES} SELECT symbol, date, {', '.join(f'round(lead(close, {h}) OVER o / close - 1, 6) AS fwd_{h}' for h in (1, 5, 20))} FROM candles WINDOW o AS ({_O})")
def forward_returns(spark, sf_dir):
    return _key(offline.forward_returns(candles(spark, sf_dir), (1, 5, 20)), "fwd_1", "fwd_5", "fwd_20")


@register(
    "future_extremes",
    f"WITH {CANDLES} SELECT symbol, date, CASE WHEN count(close) OVER w = 10 THEN min(close) OVER w END AS future_min, CASE WHEN count(close) OVER w = 10 THEN max(close) OVER w END AS future_max FROM candles WINDOW w AS ({_O} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)",
)
def future_extremes(spark, sf_dir):
    return _key(offline.future_extremes(candles(spark, sf_dir), 10), "future_min", "future_max")


@register(
    "triple_barrier",
    f"""WITH {CANDLES}, l AS (SELECT *, ln(close / lag(close) OVER o) AS lr FROM candles WINDOW o AS ({_O})),
    v AS (SELECT *, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w * sqrt(10) END AS vol, list(close) OVER n AS nx FROM l WINDOW w AS ({_O} ROWS 19 PRECEDING), n AS ({_O} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
    h AS (SELECT *, list_position(list_transform(nx, lambda x: x >= close * exp(0.5 * vol)), true) AS u, list_position(list_transform(nx, lambda x: x <= close * exp(-0.5 * vol)), true) AS d FROM v)
    SELECT symbol, date, CASE WHEN len(nx) = 10 AND vol IS NOT NULL THEN CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN d IS NULL OR u <= d THEN 1 ELSE -1 END END::INT AS barrier FROM h""",
)
def triple_barrier(spark, sf_dir):
    return _key(offline.triple_barrier(candles(spark, sf_dir), 10, 0.5, 0.5), "barrier")


@register(
    "har_rv_components",
    f"""WITH {_PANEL} SELECT symbol, date, {", ".join(f"round(CASE WHEN count(ret) OVER w{n} = {n} THEN sqrt(avg(ret * ret) OVER w{n} * 252) END, 6) AS rv_{k}" for k, n in (("1d", 1), ("1w", 5), ("1m", 22)))},
        round(CASE WHEN count(ret) OVER w22 = 22 THEN sqrt(avg(ret * ret) OVER w1) / sqrt(avg(ret * ret) OVER w22) END, 6) AS rv_ratio
    FROM panel WINDOW {", ".join(f"w{n} AS ({_O} ROWS {n - 1} PRECEDING)" for n in (1, 5, 22))}""",
)
def har_rv_components(spark, sf_dir):
    return _key(offline.rv_components(panel(spark, sf_dir), {"1d": 1, "1w": 5, "1m": 22}), "rv_1d", "rv_1w", "rv_1m", "rv_ratio")


@register("har_rv_fit")
def har_rv_fit(spark, sf_dir):
    p = offline.forward_returns(panel(spark, sf_dir), (1,))
    c = offline.rv_components(p, {"1d": 1, "1w": 5, "1m": 22}).withColumn("next_vol", F.abs("fwd_1"))
    b = offline.har_fit(c, "next_vol", ["rv_1d", "rv_1w", "rv_1m"], ["symbol"])
    return rounded(b.select("symbol", "n", *[F.get("beta", F.lit(i)).alias(f"beta_{i}") for i in range(4)]), 4)


@register(
    "rolling_percentile",
    f"""WITH {CANDLES}, l AS (SELECT symbol, date, close, list(close) OVER w AS a FROM candles WINDOW w AS ({_O} ROWS 49 PRECEDING))
    SELECT symbol, date, round(CASE WHEN len(a) >= 10 THEN (len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close)) + 1) / 2) / len(a) END, 6) AS pct FROM l""",
)
def rolling_percentile(spark, sf_dir):
    return _key(offline.rolling_percentile(candles(spark, sf_dir), 50, "close"), "pct")


@register(
    "temporal_derivatives",
    f"""WITH {CANDLES}, v AS (SELECT *, close - lag(close) OVER o AS vel, row_number() OVER o AS i FROM candles WINDOW o AS ({_O})), a AS (SELECT *, vel - lag(vel) OVER ({_O}) AS accel FROM v)
    SELECT symbol, date, round(vel, 6) AS vel, round(accel, 6) AS accel, round(CASE WHEN count(close) OVER w = 20 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END, 6) AS z_20,
           round(CASE WHEN count(close) OVER w = 20 THEN regr_slope(close, i) OVER w END, 5) AS slope_20, round(CASE WHEN count(vel) OVER w = 20 THEN stddev_samp(vel) OVER w END, 6) AS vol_20 FROM a WINDOW w AS ({_O} ROWS 19 PRECEDING)""",
)
def temporal_derivatives(spark, sf_dir):
    out = offline.temporal_derivatives(candles(spark, sf_dir), "close", (20,))
    return _key(out.withColumn("slope_20", F.round("slope_20", 5)), "vel", "accel", "z_20", "slope_20", "vol_20")


@register(
    "cross_derivatives",
    f"""WITH {CANDLES} SELECT symbol, date, round(least(greatest(close / (volume + 1e-9), -10), 10), 6) AS ratio, round(CASE WHEN count(*) OVER w = 20 AND stddev_pop(close) OVER w * stddev_pop(volume) OVER w > 1e-12 THEN covar_pop(close, volume) OVER w / (stddev_pop(close) OVER w * stddev_pop(volume) OVER w) END, 5) AS corr,
        round(CASE WHEN count(*) OVER w = 20 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) - (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) END, 5) AS z_divergence FROM candles WINDOW w AS ({_O} ROWS 19 PRECEDING)""",
)
def cross_derivatives(spark, sf_dir):
    out = offline.cross_derivatives(candles(spark, sf_dir), "close", "volume", 20)
    return _key(out.withColumns({c: F.round(c, 5) for c in ("corr", "z_divergence")}), "ratio", "corr", "z_divergence")


@register(
    "settlement_clock",
    f"""WITH {TRADES} SELECT tid, epoch_us(ts) // 1000000 % 28800 AS since_mark, 28800 - epoch_us(ts) // 1000000 % 28800 AS to_mark, round(sin(2 * pi() * (epoch_us(ts) // 1000000 % 28800) / 28800), 6) AS phase_sin,
        round(cos(2 * pi() * (epoch_us(ts) // 1000000 % 28800) / 28800), 6) AS phase_cos, (isodow(ts) >= 6)::INT AS weekend FROM trades""",
)
def settlement_clock(spark, sf_dir):
    return rounded(trades(spark, sf_dir).select("tid", *[c.alias(n) for n, c in offline.settlement_clock(F.col("ts")).items()]))


_IND = f"""{CANDLES}, ind AS (SELECT symbol, date, close, CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_20, CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50, max(high) OVER w50 AS resistance, min(low) OVER w50 AS support, volume / avg(volume) OVER w50 AS rel_volume
    FROM candles WINDOW w20 AS ({_O} ROWS 19 PRECEDING), w50 AS ({_O} ROWS 49 PRECEDING))"""


@register("macro_indicators", f"WITH {_IND} SELECT symbol, date, round(sma_20, 6) AS sma_20, round(sma_50, 6) AS sma_50, round(resistance, 6) AS resistance, round(support, 6) AS support, round(rel_volume, 6) AS rel_volume FROM ind")
def macro_indicators(spark, sf_dir):
    return _key(offline.indicators(candles(spark, sf_dir)), "sma_20", "sma_50", "resistance", "support", "rel_volume")


@register(
    "macro_signal",
    f"""WITH {_IND} SELECT symbol, date, CASE WHEN sma_50 IS NULL THEN NULL WHEN close / sma_50 - 1 > 0.01 AND sma_20 > sma_50 THEN 1 WHEN close / sma_50 - 1 < -0.01 AND sma_20 < sma_50 THEN -1 ELSE 0 END::INT AS direction,
        round(CASE WHEN sma_50 IS NULL THEN 1 ELSE least(abs(close / sma_50 - 1) / 0.1, 1) END, 6) AS strength FROM ind""",
)
def macro_signal(spark, sf_dir):
    return _key(offline.macro_signal(offline.indicators(candles(spark, sf_dir))), "direction", "strength")


@register("recursive_indicators")
def recursive_indicators(spark, sf_dir):
    return _key(offline.recursive_indicators(candles(spark, sf_dir)), "ema_12", "ema_26", "macd", "rsi_14", "atr_14", "rsi_ewm_14")


def _signals(spark, sf_dir):
    c = offline.indicators(candles(spark, sf_dir))
    return c.withColumn("entry", F.coalesce(F.col("close") < F.col("sma_20") * 0.98, F.lit(False))).withColumn("exit", F.coalesce(F.col("close") > F.col("sma_20"), F.lit(False)))


@register("backtest_trades")
def backtest_trades(spark, sf_dir):
    return rounded(backtest.backtest(_signals(spark, sf_dir), backtest.Strategy(), backtest.Costs()))


@register("backtest_metrics")
def backtest_metrics(spark, sf_dir):
    return rounded(backtest.metrics(backtest.backtest(_signals(spark, sf_dir), backtest.Strategy(), backtest.Costs())))


@register(
    "max_drawdown",
    f"""WITH {_PANEL}, e AS (SELECT symbol, date, sum(ret) OVER ({_O}) AS e FROM panel WHERE ret IS NOT NULL), p AS (SELECT symbol, e, greatest(max(e) OVER ({_O}), 0) AS p FROM e) SELECT symbol, round(max(p - e), 6) AS max_drawdown FROM p GROUP BY 1""",
)
def max_drawdown(spark, sf_dir):
    return rounded(backtest.max_drawdown(panel(spark, sf_dir).where("ret IS NOT NULL"), ["symbol"], ["date"], "ret"))


@register("sharpe_by_symbol", f"WITH {_PANEL} SELECT symbol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM panel GROUP BY 1")
def sharpe_by_symbol(spark, sf_dir):
    return rounded(panel(spark, sf_dir).groupBy("symbol").agg(backtest.sharpe("ret").alias("sharpe")))


_SHARPE = "CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(252) ELSE 0 END"


@register(
    "walk_forward",
    f"""WITH {_PANEL}, i AS (SELECT symbol, date, sign(momentum) * forward AS pnl, row_number() OVER ({_O}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL),
    f AS (SELECT *, least(floor(i * 5 / c), 4)::BIGINT AS fold FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY symbol, fold) AS m FROM f),
    x AS (SELECT symbol, fold, CASE WHEN k < floor(m * 0.7::DOUBLE) THEN pnl END AS a, CASE WHEN k >= floor(m * 0.7::DOUBLE) + 5 THEN pnl END AS b FROM k), s AS (SELECT symbol, fold, {_SHARPE.format("a")} AS a, {_SHARPE.format("b")} AS b, count(b) AS n FROM x GROUP BY 1, 2)
    SELECT symbol, fold, round(a, 6) AS is_sharpe, round(b, 6) AS oos_sharpe, n AS oos_rows, round(CASE WHEN a <> 0 THEN b / a ELSE 0 END, 4) AS oos_is_ratio FROM s""",
)
def walk_forward(spark, sf_dir):
    p = panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL")
    out = backtest.walk_forward(p, 5, 0.7, 5, "momentum", "forward", ["symbol"], ["date"])
    return rounded(out.withColumn("oos_is_ratio", F.round("oos_is_ratio", 4)))


@register(
    "quantile_edges",
    f"""WITH {_PANEL}, q AS (SELECT symbol, quantile_cont(momentum, [0.2, 0.4, 0.6, 0.8]) AS q FROM panel GROUP BY 1)
    SELECT symbol, len(list_filter(q, lambda x: x < momentum))::INT AS bucket, round(avg(forward), 6) AS mean_forward, count(*) AS n FROM panel JOIN q USING (symbol) WHERE momentum IS NOT NULL AND forward IS NOT NULL GROUP BY 1, 2""",
)
def quantile_edges(spark, sf_dir):
    return rounded(backtest.quantile_edges(panel(spark, sf_dir), "momentum", "forward", ["symbol"]))


@register(
    "maker_fills",
    f"""WITH {CANDLES}, f AS (SELECT symbol, close AS mid, CASE WHEN count(close) OVER w = 3 THEN min(close) OVER w END AS lo, max(close) OVER w AS hi FROM candles WINDOW w AS ({_O} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
    h AS (SELECT *, unnest([10.0::DOUBLE, 100.0::DOUBLE, 500.0::DOUBLE]) AS h FROM f WHERE lo IS NOT NULL), x AS (SELECT *, lo <= mid * (1 - h / 1e4) AS b, hi >= mid * (1 + h / 1e4) AS a FROM h)
    SELECT symbol, h AS half_spread_bps, round(avg((a AND b)::INT), 6) AS both, round(avg((a <> b)::INT), 6) AS one, round(avg((NOT a AND NOT b)::INT), 6) AS none,
           round(avg(CASE WHEN a AND b THEN 2 * h - 3 WHEN b THEN h - (mid * (1 - h / 1e4) - lo) / mid * 1e4 - 1.5 WHEN a THEN h - (hi - mid * (1 + h / 1e4)) / mid * 1e4 - 1.5 ELSE 0 END), 4) AS pnl_bps FROM x GROUP BY 1, 2""",
)
def maker_fills(spark, sf_dir):
    d = offline.future_extremes(candles(spark, sf_dir), 3).withColumn("mid", F.col("close"))
    out = backtest.maker_fills(d, (10.0, 100.0, 500.0), 1.5, ["symbol"])
    return rounded(out.withColumn("pnl_bps", F.round("pnl_bps", 4)))


@register("risk_parity", f"WITH {_PANEL}, v AS (SELECT symbol, stddev_samp(ret) AS vol FROM panel GROUP BY 1) SELECT symbol, round(vol, 6) AS vol, round(1 / vol / sum(1 / vol) OVER (), 6) AS weight FROM v")
def risk_parity(spark, sf_dir):
    return rounded(backtest.inverse_vol_weights(panel(spark, sf_dir), ["symbol"], "ret"))


@register(
    "beta_neutral_weights",
    f"""WITH {_PANEL}, s AS (SELECT date, symbol, momentum - avg(momentum) OVER d AS s, volume - avg(volume) OVER d AS b FROM panel WHERE momentum IS NOT NULL WINDOW d AS (PARTITION BY date)),
    r AS (SELECT *, s - CASE WHEN coalesce(sum(b * b) OVER d, 0) <> 0 THEN sum(s * b) OVER d / sum(b * b) OVER d ELSE 0 END * b AS r FROM s WINDOW d AS (PARTITION BY date))
    SELECT date, symbol, round(CASE WHEN sum(abs(r)) OVER (PARTITION BY date) > 1e-9 THEN r / sum(abs(r)) OVER (PARTITION BY date) ELSE 0 END, 7) AS weight FROM r""",
)
def beta_neutral_weights(spark, sf_dir):
    p = panel(spark, sf_dir).where("momentum IS NOT NULL")
    return backtest.beta_neutral(p, "date", "symbol", "momentum", "volume").select("date", "symbol", F.round("weight", 7).alias("weight"))


@register(
    "rolling_beta",
    f"""WITH {_PANEL}, m AS (SELECT symbol, date, ret, avg(ret) OVER (PARTITION BY date) AS m FROM panel WHERE ret IS NOT NULL) SELECT symbol, date, round(CASE WHEN count(ret + m) OVER w = 60 THEN regr_slope(ret, m) OVER w END, 5) AS beta FROM m WINDOW w AS ({_O} ROWS 59 PRECEDING)""",
)
def rolling_beta(spark, sf_dir):
    from pyspark.sql import Window

    p = panel(spark, sf_dir).where("ret IS NOT NULL").withColumn("market", F.avg("ret").over(Window.partitionBy("date")))
    return backtest.rolling_beta(p, "ret", "market", 60).select("symbol", "date", F.round("beta", 5).alias("beta"))
