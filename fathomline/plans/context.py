"""Queries of derived, context, whale-flow, VWAP and micro-price operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import context, offline, price, tape
from fathomline.plans.adapters import TRADES, rounded, trades
from fathomline.plans.catalogue import register
from fathomline.plans.stats import _PANEL, panel

_T = "PARTITION BY symbol ORDER BY ts, tid"


@register("derived_block")
def derived_block(spark, sf_dir):
    t = price.trend_block(trades(spark, sf_dir), (60,))
    t = price.permutation_entropy(t, 16).withColumn("f", F.when(F.col("is_buy"), 0.2).otherwise(-0.2))
    cols = context.derived_block(F.col("trend_momentum_60"), F.col("trend_monotonicity_60"), F.col("ent_permutation_16"), F.lit(1.0), F.col("f"))
    return rounded(t.select("tid", "symbol", *[c.alias(n) for n, c in cols.items()]))


_CTX = f"{TRADES}, ctx AS (SELECT tid, ts, symbol, price / 1e4 AS funding, 1000 + size * 10 AS open_interest, price + size / 100 AS mark, price AS oracle, size AS day_volume FROM trades)"


def _ctx(spark, sf_dir):
    p, s = F.col("price"), F.col("size")
    return trades(spark, sf_dir).select("tid", "ts", "symbol", (p / 1e4).alias("funding"), (1000 + s * 10).alias("open_interest"), (p + s / 100).alias("mark"), p.alias("oracle"), s.alias("day_volume"))


@register(
    "context_block",
    f"""WITH {_CTX} SELECT tid, symbol, round(CASE WHEN coalesce(stddev_samp(funding) OVER w, 0) > 1e-10 THEN (funding - avg(funding) OVER w) / stddev_samp(funding) OVER w ELSE 0 END, 5) AS ctx_funding_zscore,
        coalesce(open_interest - lag(open_interest, 60) OVER o, 0) AS ctx_oi_change, round(coalesce(open_interest / lag(open_interest, 60) OVER o - 1, 0), 6) AS ctx_oi_change_pct, round((mark - oracle) / oracle * 1e4, 5) AS ctx_premium_bps,
        round(day_volume / avg(day_volume) OVER w, 6) AS ctx_volume_ratio, round(coalesce(funding - lag(funding, 96) OVER o, 0), 8) AS ctx_funding_momentum,
        round(coalesce(funding - lag(funding, 96) OVER o - (lag(funding, 12) OVER o - lag(funding, 108) OVER o), 0), 8) AS ctx_funding_acceleration
    FROM ctx WINDOW o AS ({_T}), w AS ({_T} ROWS 287 PRECEDING)""",
)
def context_block(spark, sf_dir):
    out = context.context_block(_ctx(spark, sf_dir))
    digits = {"ctx_funding_zscore": 5, "ctx_oi_change": 6, "ctx_oi_change_pct": 6, "ctx_premium_bps": 5, "ctx_volume_ratio": 6, "ctx_funding_momentum": 8, "ctx_funding_acceleration": 8}
    return out.select("tid", "symbol", *[F.round(c, d).alias(c) for c, d in digits.items()])


_WH = f"{TRADES}, ch AS (SELECT tid, ts, symbol, wallet, CASE WHEN wallet % 7 <> 0 THEN CASE WHEN is_buy THEN size * 100 ELSE -size * 100 END END AS x FROM trades)"


@register(
    "whale_flow_block",
    f"""WITH {_WH} SELECT tid, symbol, {", ".join(f"coalesce(sum(x) OVER w{n}, 0) AS whale_net_flow_{n}, round(CASE WHEN sum(abs(x)) OVER w{n} > 1e-9 THEN sum(x) OVER w{n} / (sum(abs(x)) OVER w{n} / count(x) OVER w{n}) ELSE 0 END, 5) AS whale_flow_normalized_{n}, round(count(x) OVER w{n} / {n}, 6) AS whale_flow_intensity_{n}" for n in (60, 240, 1440))},
        round(coalesce(sum(x) OVER w60, 0) / 60 - coalesce(sum(x) OVER w1440, 0) / 1440, 5) AS whale_flow_momentum FROM ch WINDOW {", ".join(f"w{n} AS ({_T} ROWS {n - 1} PRECEDING)" for n in (60, 240, 1440))}""",
)
def whale_flow_block(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("position_change_usd", F.when(F.col("is_buy"), F.col("size") * 100).otherwise(-F.col("size") * 100)).withColumn("is_market_maker", F.col("wallet") % 7 == 0)
    out = context.whale_flow_block(t)
    cols = [c for c in out.columns if c.startswith("whale_")]
    return rounded(out.select("tid", "symbol", *[F.round(c, 5).alias(c) if "normalized" in c or "momentum" in c else F.col(c) for c in cols]))


@register(
    "vwap_multiscale",
    f"""WITH {TRADES}, v AS (SELECT *, sum(price * size) OVER a / sum(size) OVER a AS va, sum(price * size) OVER b / sum(size) OVER b AS vb FROM trades WINDOW a AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, (price - va) / va AS da, (price - vb) / vb AS db FROM v)
    SELECT tid, symbol, round(va, 6) AS vwap_6h, round(vb, 6) AS vwap_48h, round(da, 6) AS dev_6h, round(db, 6) AS dev_48h,
        round(CASE WHEN coalesce(stddev_samp(da) OVER w, 0) > 1e-10 THEN (da - avg(da) OVER w) / stddev_samp(da) OVER w ELSE 0 END, 5) AS z_6h, round(CASE WHEN coalesce(stddev_samp(db) OVER w, 0) > 1e-10 THEN (db - avg(db) OVER w) / stddev_samp(db) OVER w ELSE 0 END, 5) AS z_48h
    FROM d WINDOW w AS ({_T} ROWS 199 PRECEDING)""",
)
def vwap_multiscale(spark, sf_dir):
    out = context.multiscale_vwap(trades(spark, sf_dir), {"6h": 6 * 3600, "48h": 48 * 3600})
    return rounded(out.select("tid", "symbol", "vwap_6h", "vwap_48h", "dev_6h", "dev_48h", F.round("z_6h", 5).alias("z_6h"), F.round("z_48h", 5).alias("z_48h")))


@register(
    "tape_window_statistics",
    f"""WITH {TRADES} SELECT tid, symbol, count(*) OVER w AS count_12h, sum(size) OVER w AS volume_12h, coalesce(sum(size) FILTER (is_buy) OVER w, 0) AS buy_volume_12h, sum(size) OVER w - coalesce(sum(size) FILTER (is_buy) OVER w, 0) AS sell_volume_12h
    FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)""",
)
def tape_window_statistics(spark, sf_dir):
    return tape.window_statistics(trades(spark, sf_dir), {"12h": 12 * 3600}).select("tid", "symbol", "count_12h", "volume_12h", "buy_volume_12h", "sell_volume_12h")


@register(
    "realized_moments",
    f"""WITH {_PANEL}, l AS (SELECT symbol, date, list(ret) OVER w AS a, avg(ret) OVER w AS m, count(ret) OVER w AS n, sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) OVER w AS dn, sum(CASE WHEN ret > 0 THEN ret * ret ELSE 0 END) OVER w AS up FROM panel WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING)),
    p AS (SELECT *, list_avg(list_transform(a, lambda x: (x - m) ** 2)) AS m2, list_avg(list_transform(a, lambda x: (x - m) ** 3)) AS m3, list_avg(list_transform(a, lambda x: (x - m) ** 4)) AS m4 FROM l)
    SELECT symbol, date, round(CASE WHEN n = 30 THEN m3 / m2 ** 1.5 * sqrt(870) / 28 END, 5) AS realized_skew, round(CASE WHEN n = 30 THEN 29 / (28 * 27) * (31 * (m4 / m2 ** 2 - 3) + 6) END, 5) AS realized_kurt,
        round(CASE WHEN n = 30 THEN dn END, 6) AS semivar_down, round(CASE WHEN n = 30 THEN up END, 6) AS semivar_up FROM p""",
)
def realized_moments(spark, sf_dir):
    out = context.realized_moments(panel(spark, sf_dir).where("ret IS NOT NULL"), 30)
    return rounded(out.select("symbol", "date", F.round("realized_skew", 5).alias("realized_skew"), F.round("realized_kurt", 5).alias("realized_kurt"), "semivar_down", "semivar_up"))


@register(
    "residualised",
    f"""WITH {_PANEL}, b AS (SELECT symbol, regr_slope(forward, momentum) AS b, regr_intercept(forward, momentum) AS a FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL AND date < TIMESTAMP '2000-01-01' GROUP BY 1)
    SELECT symbol, date, round(forward - (a + b * momentum), 6) AS resid FROM panel LEFT JOIN b USING (symbol)""",
)
def residualised(spark, sf_dir):
    out = context.residualised(panel(spark, sf_dir), "forward", ["momentum"], F.col("date") < F.lit("2000-01-01").cast("timestamp_ntz"), ["symbol"])
    return rounded(out.select("symbol", "date", "resid"))


_TOB = f"""{TRADES}, q AS (SELECT tid, ts, symbol, floor(price) AS bid, floor(price) + 1 + wallet % 2 AS ask, size AS bid_size, (1 + tid % 9)::DOUBLE AS ask_size FROM trades)"""


def _quotes(spark, sf_dir):
    return trades(spark, sf_dir).select("tid", "ts", "symbol", F.floor("price").cast("double").alias("bid"), (F.floor("price") + 1 + F.col("wallet") % 2).cast("double").alias("ask"), F.col("size").alias("bid_size"), (1 + F.col("tid") % 9).cast("double").alias("ask_size"))


@register(
    "order_flow_imbalance",
    f"""WITH {_TOB} SELECT tid, symbol, coalesce(CASE WHEN bid > lag(bid) OVER o THEN bid_size WHEN bid = lag(bid) OVER o THEN bid_size - lag(bid_size) OVER o ELSE -lag(bid_size) OVER o END
        - CASE WHEN ask < lag(ask) OVER o THEN ask_size WHEN ask = lag(ask) OVER o THEN ask_size - lag(ask_size) OVER o ELSE -lag(ask_size) OVER o END, 0) AS ofi FROM q WINDOW o AS ({_T})""",
)
def order_flow_imbalance(spark, sf_dir):
    return offline.step_ofi(_quotes(spark, sf_dir), order=("ts", "tid")).select("tid", "symbol", "ofi")


@register("microprice_model")
def microprice_model(spark, sf_dir):
    q = _quotes(spark, sf_dir)
    imb = (F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size"))
    q = q.withColumn("imb", imb).withColumn("spread_ticks", F.col("ask") - F.col("bid")).withColumn("mid_ticks", F.col("bid"))
    m = context.MicropriceModel.fit(q, ["symbol"], "imb", "spread_ticks", "mid_ticks")
    return rounded(q.select("tid", "symbol", m.deviation(F.col("imb"), F.col("spread_ticks")).alias("microprice_deviation")))
