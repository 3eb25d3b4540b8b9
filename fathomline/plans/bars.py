"""Queries of bars, alignment, regimes and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions.windows import numbered
from fathomline.operators import alerts, bars, regime
from fathomline.plans.adapters import CANDLES, TRADES, candles, read, rounded, trades
from fathomline.plans.catalogue import register

DAY = 86_400
_BAR = "(epoch_us(ts) // 86400000000)"


@register(
    "bars_vwap_daily",
    f"""WITH {TRADES}
    SELECT symbol, {_BAR} AS bar, arg_min(price, tid) AS open, max(price) AS high, min(price) AS low, arg_max(price, tid) AS close, sum(size) AS volume,
           round(sum(price * size) / sum(size), 6) AS vwap, round(coalesce(sum(size) FILTER (is_buy), 0) / sum(size), 6) AS buy_share, count(*) AS trades
    FROM trades GROUP BY 1, 2""",
)
def bars_vwap_daily(spark, sf_dir):
    return rounded(bars.vwap_bars(trades(spark, sf_dir), DAY))


@register(
    "bars_default",
    f"""WITH {TRADES} SELECT symbol, {_BAR} AS bar, count(*) AS n_ticks, arg_min(price, tid) AS price_first, arg_max(price, tid) AS price_last, round(stddev_samp(price), 6) AS price_std
    FROM trades GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def bars_default(spark, sf_dir):
    return rounded(bars.default_bars(trades(spark, sf_dir), ["price"], DAY, least=10))


_KINDS = {"price": "price", "size": "sum", "wallet": "entropy"}


@register(
    "bars_typed",
    f"""WITH {TRADES}, n AS (SELECT *, {_BAR} AS bar, row_number() OVER (PARTITION BY symbol, {_BAR} ORDER BY tid) - 1 AS i FROM trades)
    SELECT symbol, bar, count(*) AS tick_count, arg_min(price, tid) AS price_open, max(price) AS price_high, min(price) AS price_low, arg_max(price, tid) AS price_close, round(avg(price), 6) AS price_mean,
           sum(size) AS size_sum, round(avg(wallet), 6) AS wallet_mean, round(stddev_samp(wallet), 6) AS wallet_std, round(coalesce(regr_slope(wallet, i), 0), 6) AS wallet_slope
    FROM n GROUP BY 1, 2""",
)
def bars_typed(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("wallet", F.col("wallet").cast("double"))
    return rounded(bars.typed_bars(t, _KINDS, DAY))


@register(
    "bars_multi_timeframe",
    f"""WITH {TRADES} {" UNION ALL ".join(f"SELECT '{n}' AS frame, symbol, epoch_us(ts) // {s * 1000000} AS bar, count(*) AS tick_count, round(avg(price), 6) AS price_mean FROM trades GROUP BY 2, 3" for n, s in (("6h", 21600), ("1d", DAY), ("3d", 3 * DAY)))}""",
)
def bars_multi_timeframe(spark, sf_dir):
    out = bars.multi_timeframe(trades(spark, sf_dir), {"price": "default"}, {"6h": 21600, "1d": DAY, "3d": 3 * DAY})
    parts = [df.select(F.lit(n).alias("frame"), "symbol", "bar", "tick_count", "price_mean") for n, df in out.items()]
    return rounded(parts[0].union(parts[1]).union(parts[2]))


@register(
    "bars_counters",
    f"""WITH {TRADES}, d AS (SELECT *, {_BAR} AS bar, abs(price - lag(price) OVER (PARTITION BY symbol, {_BAR} ORDER BY tid)) AS d FROM trades)
    SELECT symbol, bar, count(*) FILTER (d > 50) AS bar_jump_count, round(coalesce(max(d), 0), 6) AS bar_max_abs_return FROM d GROUP BY 1, 2""",
)
def bars_counters(spark, sf_dir):
    return rounded(bars.bar_counters(trades(spark, sf_dir), DAY, 50.0))


@register(
    "bars_by_ticks",
    f"""WITH {TRADES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, tid) - 1 AS n FROM trades)
    SELECT symbol, n // 60 AS bar, arg_min(price, n) AS open, max(price) AS high, min(price) AS low, arg_max(price, n) AS close, count(*) AS ticks FROM n GROUP BY 1, 2""",
)
def bars_by_ticks(spark, sf_dir):
    return bars.tick_bars(numbered(trades(spark, sf_dir), ["symbol"], ["ts", "tid"], "ts"), 60)


@register(
    "as_of_join",
    """WITH a AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT ts AS seen, user_id, value FROM events WHERE event_type = 'view')
    SELECT event_id, a.user_id, CASE WHEN seen >= ts - INTERVAL 48 HOUR THEN b.value END AS view_value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.seen""",
)
def as_of_join(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    b = e.where("event_type = 'view'").select(F.col("ts").alias("at"), "user_id", F.col("value").alias("view_value"))
    return bars.as_of(a, b, ["user_id"], "ts", "at", ["view_value"], 48 * 3600).select("event_id", "user_id", "view_value")


_SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@register(
    "wide_close_matrix",
    f"""WITH {CANDLES} SELECT date, {", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in _SYMBOLS)} FROM candles GROUP BY 1""",
)
def wide_close_matrix(spark, sf_dir):
    return bars.wide(candles(spark, sf_dir), "date", "symbol", "close", _SYMBOLS)


@register(
    "cross_symbol_latest",
    f"""WITH {TRADES}, l AS (SELECT symbol, arg_max(price, tid) AS price FROM trades GROUP BY 1), s AS (SELECT sum(price) AS s, count(*) AS n, stddev_samp(price) AS d FROM l)
    SELECT symbol, round((s - price) / (n - 1), 6) AS cross_obi_mean, round(price - (s - price) / (n - 1), 6) AS cross_obi_diff, round(d, 6) AS cross_obi_std FROM l, s""",
)
def cross_symbol_latest(spark, sf_dir):
    last = alerts.latest(trades(spark, sf_dir), ["symbol"], "ts", "tid").select("symbol", "price")
    return rounded(bars.cross_symbol(last, "price").drop("price"))


_RB = f"""{TRADES}, rb AS (SELECT symbol, epoch_us(ts) // 21600000000 AS b, arg_max(price, tid) AS price, sum(size) AS volume, coalesce(sum(size) FILTER (is_buy), 0) AS buy, coalesce(sum(size) FILTER (NOT is_buy), 0) AS sell FROM trades GROUP BY 1, 2),
rd AS (SELECT *, buy - sell AS net, price - lag(price) OVER (PARTITION BY symbol ORDER BY b) AS d FROM rb),
rl AS (SELECT *, CASE WHEN var_pop(CASE WHEN d IS NOT NULL THEN net END) OVER w > 1e-12 THEN covar_pop(d, net) OVER w / var_pop(CASE WHEN d IS NOT NULL THEN net END) OVER w ELSE 0 END AS lam FROM rd WINDOW w AS (PARTITION BY symbol ORDER BY b ROWS 19 PRECEDING))"""


def _regime_bars(spark, sf_dir):
    t = trades(spark, sf_dir)
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0.0))
    b = t.groupBy("symbol", bars.bucket("ts", 21600).alias("b")).agg(F.max_by("price", "tid").alias("price"), F.sum("size").alias("volume"), side(F.col("is_buy")).alias("buy"), side(~F.col("is_buy")).alias("sell"))
    return b.withColumn("ts", F.timestamp_micros(F.col("b") * 21_600_000_000))


def _regime_sql(n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY b ROWS {n - 1} PRECEDING)"
    hi, lo, ch = f"max(price) OVER {w}", f"min(price) OVER {w}", f"(price - first_value(price) OVER {w})"
    return f"""round(sum(volume) OVER {w} / (abs({ch}) + 1e-3), 4) AS regime_absorption_{n}, round((sum(buy) OVER {w} + sum(sell) OVER {w}) / (abs(sum(buy) OVER {w} - sum(sell) OVER {w}) + 1e-10), 4) AS regime_churn_{n},
        round(CASE WHEN {hi} - {lo} > 1e-10 THEN (price - {lo}) / ({hi} - {lo}) ELSE 0.5 END, 6) AS regime_range_pos_{n}, round(({hi} - {lo}) / price, 6) AS regime_range_width_{n}, round({ch} - lam * sum(net) OVER {w}, 5) AS regime_divergence_{n}"""


@register("regime_block", f"WITH {_RB} SELECT symbol, b, {_regime_sql(5)}, {_regime_sql(20)} FROM rl")
def regime_block(spark, sf_dir):
    out = regime.block(_regime_bars(spark, sf_dir), (5, 20))
    digits = {"absorption": 4, "churn": 4, "range": 6, "divergence": 5}
    cols = [c for c in out.columns if c.startswith("regime_") and c != "regime_lambda"]
    return out.select("symbol", "b", *[F.round(c, digits[c.split("_")[1]]).alias(c) for c in cols])


@register(
    "regime_scores",
    f"""WITH {_RB}, x AS (SELECT symbol, b, (buy - sell) / volume AS f, volume / 100 - 1 AS v, CASE WHEN max(price) OVER w - min(price) OVER w > 1e-10 THEN (price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) ELSE 0.5 END AS p FROM rl WINDOW w AS (PARTITION BY symbol ORDER BY b ROWS 19 PRECEDING)),
    s AS (SELECT symbol, b, 0.35 / (1 + exp(-v)) + 0.15 / (1 + exp(-v)) + 0.30 / (1 + exp(-f)) + 0.20 / (1 + exp(-(0.5 - p) * 4)) AS u, 0.35 / (1 + exp(-v)) + 0.15 / (1 + exp(-v)) + 0.30 / (1 + exp(f)) + 0.20 / (1 + exp(-(p - 0.5) * 4)) AS d FROM x)
    SELECT symbol, b, round(u, 6) AS accumulation, round(d, 6) AS distribution, round(abs(u - d), 6) AS clarity, CASE WHEN abs(u - d) < 0.1 THEN 'UNCLEAR' WHEN u > d THEN 'ACCUMULATION' ELSE 'DISTRIBUTION' END AS regime FROM s""",
)
def regime_scores(spark, sf_dir):
    out = regime.block(_regime_bars(spark, sf_dir), (20,))
    flow, v = (F.col("buy") - F.col("sell")) / F.col("volume"), F.col("volume") / 100 - 1
    u, d, c = regime.scores(v, flow, v, F.col("regime_range_pos_20"))
    return rounded(out.select("symbol", "b", u.alias("accumulation"), d.alias("distribution"), c.alias("clarity"), regime.label(u, d, c).alias("regime")))


@register("regime_mixture")
def regime_mixture(spark, sf_dir):
    daily = bars.vwap_bars(trades(spark, sf_dir), DAY).select("symbol", "bar", "vwap", "buy_share", F.col("trades").cast("double").alias("n"))
    model = regime.fit_mixture_rows(daily, ["vwap", "buy_share", "n"], 3)
    p = model.probabilities([F.col("vwap"), F.col("buy_share"), F.col("n")])
    return rounded(daily.select("symbol", "bar", *[x.alias(f"p{i}") for i, x in enumerate(p)]), 4)


@register(
    "alert_rules",
    f"""WITH {TRADES} SELECT tid, symbol, unnest(list_filter([CASE WHEN price > 300 THEN 'price_high' END, CASE WHEN size >= 10 AND is_buy THEN 'large_buy' END], lambda x: x IS NOT NULL)) AS alert FROM trades""",
)
def alert_rules(spark, sf_dir):
    return alerts.rules(trades(spark, sf_dir), {"price_high": F.col("price") > 300, "large_buy": (F.col("size") >= 10) & F.col("is_buy")}, ["tid", "symbol"])


@register(
    "alert_cooldown",
    f"""WITH RECURSIVE {TRADES}, a AS (SELECT symbol, tid, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM trades WHERE size >= 10 AND is_buy),
    r AS (SELECT symbol, tid, i, ts AS last, true AS fired FROM a WHERE i = 1
          UNION ALL SELECT a.symbol, a.tid, a.i, CASE WHEN a.ts >= r.last + INTERVAL 24 HOUR THEN a.ts ELSE r.last END, a.ts >= r.last + INTERVAL 24 HOUR FROM a JOIN r ON a.symbol = r.symbol AND a.i = r.i + 1)
    SELECT symbol, tid FROM r WHERE fired""",
)
def alert_cooldown(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    a = alerts.rules(t, {"large_buy": (F.col("size") >= 10) & F.col("is_buy")}, ["tid", "symbol", "ts"])
    return alerts.cooldown(a, 24 * 3600).select("symbol", "tid")


@register("latest_by_symbol", f"WITH {TRADES} SELECT symbol, max(tid) AS tid, arg_max(price, tid) AS price, arg_max(size, tid) AS size FROM trades GROUP BY 1")
def latest_by_symbol(spark, sf_dir):
    return alerts.latest(trades(spark, sf_dir), ["symbol"], "ts", "tid").select("symbol", "tid", "price", "size")


@register(
    "channel_health",
    """WITH a AS (SELECT event_type AS symbol, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6 AS age FROM events GROUP BY 1)
    SELECT symbol, round(age, 3) AS age_s, CASE WHEN age >= 86400 THEN 'dead' WHEN age >= 1800 THEN 'degraded' ELSE 'ok' END AS state FROM a""",
)
def channel_health(spark, sf_dir):
    out = alerts.health(trades(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"), degraded_s=1800)
    return rounded(out, 3)


@register("research_listing", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
def research_listing(spark, sf_dir):
    out = alerts.listing(read(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_custkey": None}, "o_orderdate", "o_orderkey", 25, 25)
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register(
    "research_stats",
    """SELECT 'all' AS "column", '' AS value, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def research_stats(spark, sf_dir):
    return alerts.stats(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register(
    "co_occurrence_network",
    """WITH i AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x FROM lineitem) SELECT a.x AS a, b.x AS b, count(*) AS weight FROM i a JOIN i b ON a.g = b.g AND a.x < b.x GROUP BY 1, 2""",
)
def co_occurrence_network(spark, sf_dir):
    return alerts.co_occurrence(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
