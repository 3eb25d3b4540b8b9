"""Queries of the signal algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions.windows import numbered
from fathomline.operators import algorithms as alg
from fathomline.operators import extras, models, signals, tape  # noqa: F401  (their algorithms are registered)
from fathomline.plans.adapters import TRADES, read, rounded, trades
from fathomline.plans.catalogue import register
from fathomline.plans.stats import _PANEL, panel


def ticks(spark, sf_dir):
    """The tape with the columns that the algorithms read."""
    t = tape.with_direction(trades(spark, sf_dir))
    f = tape.flow_block(t, 3600, 6 * 3600, 24 * 3600)
    p, v = F.col("price"), F.col("flow_vwap_deviation")
    return f.select(
        "symbol", "ts", "tid", "price", "size",
        (2 * F.col("flow_aggressor_ratio_medium") - 1).alias("imbalance"),
        (2 * F.col("flow_aggressor_ratio_medium") - 1).alias("imbalance_l1"),
        (2 * F.col("flow_aggressor_ratio_long") - 1).alias("imbalance_l5"),
        (F.col("direction") * F.col("size") / 10).alias("imbalance_l10"),
        F.col("flow_count_short").cast("double").alias("count"),
        (F.col("flow_count_medium") / (1 + F.col("flow_count_long"))).alias("entropy"),
        v.alias("vwap_deviation"), F.abs(v).alias("vpin"), F.abs(v).alias("volatility"), F.abs(v).alias("width"), ((p - 100) / 100).alias("pct"),
        (F.col("size") / 100).alias("spread"), v.alias("funding"), (F.col("direction") * F.col("size")).alias("signed_volume"),
        (v * 3).alias("innovation"), p.alias("value"), v.alias("trend"), v.alias("momentum_short"), (-v).alias("momentum_long"), F.abs(v).alias("effective"), v.alias("realized"),
        (28_800 - F.unix_seconds(F.col("ts").cast("timestamp")) % 28_800).cast("double").alias("to_mark"), F.col("flow_volume_short").alias("depth"),
    )


def _query(name):
    def query(spark, sf_dir):
        out = alg.run(ticks(spark, sf_dir), [alg.REGISTRY[name]()], carry=("tid",))
        return rounded(out.drop("ts"))

    return query


for _name in alg.REGISTRY:
    register(f"alg_{_name}")(_query(_name))


@register("alg_chain")
def alg_chain(spark, sf_dir):
    """Several algorithms in one pass, and their ensemble."""
    chain = [alg.VwapReversion(), alg.FundingReversion(), alg.RegimeGated()]
    out = alg.run(ticks(spark, sf_dir), chain, carry=("tid",))
    return rounded(alg.ensemble(out.drop("ts"), ["alg_vwap_reversion_signal", "alg_funding_reversion_signal", "alg_regime_gated_signal"]))


@register(
    "alg_rolling_z",
    f"""WITH {TRADES} SELECT tid, symbol, round(CASE WHEN stddev_pop(price) OVER w > 1e-12 THEN (price - avg(price) OVER w) / stddev_pop(price) OVER w ELSE 0 END, 5) AS z
    FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, tid ROWS 199 PRECEDING)""",
)
def alg_rolling_z(spark, sf_dir):
    return rounded(alg.windowed(trades(spark, sf_dir), "z", alg.rolling_z("price", 200), 200).select("tid", "symbol", "z"), 5)


@register(
    "alg_oi_divergence",
    f"""WITH {TRADES}, z AS (SELECT tid, symbol, CASE WHEN stddev_pop(price) OVER w > 1e-12 THEN (price - avg(price) OVER w) / stddev_pop(price) OVER w ELSE 0 END AS a, CASE WHEN stddev_pop(size) OVER w > 1e-12 THEN (size - avg(size) OVER w) / stddev_pop(size) OVER w ELSE 0 END AS b
    FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, tid ROWS 49 PRECEDING)) SELECT tid, symbol, round(a - b, 5) AS divergence FROM z""",
)
def alg_oi_divergence(spark, sf_dir):
    return rounded(alg.windowed(trades(spark, sf_dir), "divergence", alg.oi_divergence("price", "size", 50), 50).select("tid", "symbol", "divergence"), 5)


@register(
    "ou_parameters",
    f"""WITH {_PANEL}, d AS (SELECT symbol, close AS y, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS l FROM panel), s AS (SELECT symbol, count(*) AS n, regr_slope(y, l) AS b, regr_intercept(y, l) AS a, regr_sxx(y, l) AS x, regr_syy(y, l) AS q FROM d WHERE l IS NOT NULL GROUP BY 1)
    SELECT symbol, n, round(CASE WHEN b > 0 AND b < 1 THEN -ln(b) END, 5) AS theta, round(a / (1 - b), 4) AS mu, round(CASE WHEN b > 0 AND b < 1 THEN sqrt(greatest(q - b * b * x, 0) / (n - 2) * 2 * -ln(b) / (1 - b * b)) END, 4) AS sigma FROM s""",
)
def ou_parameters(spark, sf_dir):
    out = signals.ou_fit(panel(spark, sf_dir), "close", ["symbol"], ["date"])
    return out.select("symbol", "n", F.round("theta", 5).alias("theta"), F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"))


@register(
    "regime_segments",
    """WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM s)
    SELECT user_id, event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS rows FROM r GROUP BY user_id, r, event_type""",
)
def regime_segments(spark, sf_dir):
    return signals.segments(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@register("spectrum")
def spectrum(spark, sf_dir):
    return rounded(signals.spectrum_by_key(panel(spark, sf_dir).where("ret IS NOT NULL"), "ret", "symbol", "date"))


@register("null_calibration")
def null_calibration(spark, sf_dir):
    p = numbered(panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL"), ["symbol"], ["date"], "date", 86_400 * 365)
    return rounded(signals.null_calibrated(p, "momentum", "forward", ["symbol"]))


@register("momentum_continuation")
def momentum_continuation(spark, sf_dir):
    p = panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL").withColumn("label", (F.col("forward") * F.col("momentum") > 0).cast("double"))
    weights, intercept = signals.fit_logistic(p.where(F.col("date") < F.lit("2000-01-01").cast("timestamp_ntz")), ["momentum", "volume"], "label")
    return rounded(p.select("symbol", "date", signals.continuation(weights, intercept, F.col("volume") > 0).alias("p")), 4)


@register("silhouette")
def silhouette(spark, sf_dir):
    return rounded(signals.silhouette(read(spark, sf_dir, "embeddings"), "embedding", "label"), 5)


@register(
    "hierarchical_combination",
    f"""WITH {_PANEL}, l AS (SELECT symbol, date, coalesce(momentum, 0) AS a, 0.75 * coalesce(ret, 0) + 0.25 * coalesce(-momentum, 0) AS b FROM panel) SELECT symbol, date, round(a, 6) AS level_slow, round(b, 6) AS level_fast,
    round(CASE WHEN a = 0 THEN 0 WHEN sign(b) = sign(a) THEN (a + b) / 2 ELSE a END, 6) AS combined FROM l""",
)
def hierarchical_combination(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("fade", -F.col("momentum"))
    out = signals.hierarchical(p, {"slow": {"momentum": 1.0}, "fast": {"ret": 0.75, "fade": 0.25}})
    return rounded(out.select("symbol", "date", "level_slow", "level_fast", "combined"))
