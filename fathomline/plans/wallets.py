"""Queries of the wallet and position operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import wallets
from fathomline.plans.adapters import POSITIONS, TRADES, positions, read, rounded, trades
from fathomline.plans.catalogue import register


@register(
    "wallet_concentration",
    f"""WITH {POSITIONS},
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value_usd DESC) AS k, row_number() OVER (PARTITION BY grp ORDER BY value_usd) AS i,
                 sum(value_usd) OVER (PARTITION BY grp) AS t, count(*) OVER (PARTITION BY grp) AS n FROM positions WHERE value_usd > 0)
    SELECT grp, any_value(n) AS n_positions, {", ".join(f"round(least(sum(value_usd) FILTER (k <= {t}) / any_value(t), 1), 6) AS top{t}_concentration" for t in (5, 10, 20, 50))},
           round(sum((value_usd / t) ** 2), 6) AS hhi, round((2 * sum(i * value_usd) - (any_value(n) + 1) * any_value(t)) / (any_value(n) * any_value(t)), 6) AS gini,
           round(greatest(sum(value_usd / (t / n) * ln(value_usd / (t / n))) / any_value(n), 0), 6) AS theil,
           round(coalesce(sum(value_usd) FILTER (value_usd >= 8000) / any_value(t), 0), 6) AS whale_share,
           round(coalesce(avg(value_usd) FILTER (value_usd >= 8000) / avg(value_usd) FILTER (value_usd < 8000), 0), 6) AS whale_avg_size_ratio
    FROM r GROUP BY grp""",
)
def wallet_concentration(spark, sf_dir):
    return rounded(wallets.concentration(positions(spark, sf_dir), ["grp"]))


def _risk(b: int) -> str:
    return (
        f"round(coalesce(sum(value_usd) FILTER (is_long AND liquidation_price <= 100 AND liquidation_price >= 100 * (1 - {b} / 100)), 0), 4) AS liquidation_risk_below_{b}pct, "
        f"round(coalesce(sum(value_usd) FILTER (NOT is_long AND liquidation_price >= 100 AND liquidation_price <= 100 * (1 + {b} / 100)), 0), 4) AS liquidation_risk_above_{b}pct"
    )


@register(
    "liquidation_at_risk",
    f"""WITH {POSITIONS}, a AS (
        SELECT grp, {", ".join(_risk(b) for b in (1, 2, 5, 10))},
               coalesce(max(value_usd) FILTER ((is_long AND liquidation_price <= 100 AND liquidation_price >= 90) OR (NOT is_long AND liquidation_price >= 100 AND liquidation_price <= 110)), 0) AS largest_position_at_risk,
               count(*) FILTER ((is_long AND liquidation_price <= 100 AND liquidation_price >= 90) OR (NOT is_long AND liquidation_price >= 100 AND liquidation_price <= 110)) AS positions_at_risk
        FROM positions GROUP BY 1)
    SELECT *, round(CASE WHEN liquidation_risk_below_10pct < 1e-9 AND liquidation_risk_above_10pct < 1e-9 THEN 1 WHEN liquidation_risk_below_10pct < 1e-9 THEN 10
                    ELSE liquidation_risk_above_10pct / liquidation_risk_below_10pct END, 4) AS liquidation_asymmetry FROM a""",
)
def liquidation_at_risk(spark, sf_dir):
    return rounded(wallets.at_risk(positions(spark, sf_dir), ["grp"], 100.0), 4)


@register(
    "liquidation_nearest_cluster",
    f"""WITH {POSITIONS}, b AS (SELECT grp, floor((liquidation_price / 100 - 1) * 100 / 0.5::DOUBLE) AS b, sum(value_usd) AS usd FROM positions GROUP BY 1, 2 HAVING b BETWEEN -40 AND 39)
    SELECT grp, min(abs(b + 0.5::DOUBLE) * 0.5::DOUBLE) FILTER (usd >= 10000) AS nearest_cluster_distance, round(max(usd), 4) AS largest_bucket_usd FROM b GROUP BY 1""",
)
def liquidation_nearest_cluster(spark, sf_dir):
    return rounded(wallets.nearest_cluster(positions(spark, sf_dir), ["grp"], 100.0, least_usd=10_000.0), 4)


_HEAT = f"""{POSITIONS}, heat AS (
    SELECT grp, least(floor((ln(liquidation_price / 100) - ln(0.9)) / (ln(1.1) - ln(0.9)) * 200), 199)::INT AS bin, sum(value_usd) AS usd
    FROM positions WHERE ln(liquidation_price / 100) BETWEEN ln(0.9::DOUBLE) AND ln(1.1::DOUBLE) GROUP BY 1, 2)"""


@register("liquidation_heatmap", f"WITH {_HEAT} SELECT grp, bin, round(usd, 4) AS usd FROM heat")
def liquidation_heatmap(spark, sf_dir):
    return rounded(wallets.heatmap(positions(spark, sf_dir), ["grp"], 100.0), 4)


@register(
    "liquidation_heatmap_block",
    f"""WITH {_HEAT}, c AS (SELECT *, exp(ln(0.9::DOUBLE) + (bin + 0.5) * (ln(1.1::DOUBLE) - ln(0.9::DOUBLE)) / 200) - 1 AS c, sum(usd) OVER (PARTITION BY grp) AS t FROM heat),
    s AS (SELECT grp, coalesce(sum(usd) FILTER (c < 0), 0) AS b, coalesce(sum(usd) FILTER (c >= 0), 0) AS a, sum(abs(c) * usd) / any_value(t) AS d, sum(-(usd / t) * ln(usd / t)) / ln(200) AS e FROM c GROUP BY 1),
    g AS (SELECT grp, bin - row_number() OVER (PARTITION BY grp ORDER BY bin) AS g FROM c WHERE usd > 1000 AND abs(c) <= 0.05),
    l AS (SELECT grp, max(n) AS n FROM (SELECT grp, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT grp, round(b, 4) AS hm_mass_below, round(a, 4) AS hm_mass_above, round(d, 6) AS hm_weighted_distance, round(e, 6) AS hm_entropy, coalesce(n, 0) AS hm_chain_length, round((a - b) / (a + b), 6) AS hm_asymmetry
    FROM s LEFT JOIN l USING (grp)""",
)
def liquidation_heatmap_block(spark, sf_dir):
    out = wallets.heatmap_block(wallets.heatmap(positions(spark, sf_dir), ["grp"], 100.0), ["grp"], chain_usd=1000.0)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("hm_mass_below", "hm_mass_above")}))


_WALLETS = """w AS (SELECT o_custkey AS wallet, max(o_totalprice) AS position, sum(o_totalprice) AS volume FROM orders GROUP BY 1)"""


@register(
    "whale_tiers",
    f"""WITH {_WALLETS}, k AS (SELECT *, greatest((position >= 1e5)::INT + (position >= 4e5)::INT + (position >= 1e7)::INT + (position >= 1e8)::INT, (volume >= 1e6)::INT + (volume >= 4e6)::INT + (volume >= 1e8)::INT + (volume >= 1e9)::INT) AS k FROM w)
    SELECT wallet, ['retail', 'small', 'medium', 'large', 'mega'][k + 1] AS tier, round(0.6 * least(position / 1e7 * 100, 100) + 0.4 * least(volume / 1e8 * 100, 100), 4) AS whale_score FROM k""",
)
def whale_tiers(spark, sf_dir):
    w = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("wallet")).agg(F.max("o_totalprice").alias("position"), F.sum("o_totalprice").alias("volume"))
    p, v = F.col("position"), F.col("volume")
    return rounded(w.select("wallet", wallets.tier(p, v, (1e5, 4e5, 1e7, 1e8), (1e6, 4e6, 1e8, 1e9)).alias("tier"), wallets.whale_score(p, v).alias("whale_score")), 4)


_CHANGES = "changes AS (SELECT o_custkey AS wallet, year(o_orderdate) AS period, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS x FROM orders)"


def _changes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wallet"), F.year("o_orderdate").alias("period"), F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("x"))


@register(
    "whale_directional",
    f"""WITH {_CHANGES}, n AS (SELECT period, wallet, sum(x) AS net FROM changes GROUP BY 1, 2)
    SELECT period, count(*) FILTER (net > 0) AS buyers, count(*) FILTER (net < 0) AS sellers, count(*) AS active_whale_count, round(sum(net), 2) AS whale_net_flow,
           round(count(*) FILTER (net > 0) / count(*) FILTER (net <> 0), 6) AS whale_buy_ratio, round((count(*) FILTER (net > 0) - count(*) FILTER (net < 0)) / count(*) FILTER (net <> 0), 6) AS whale_directional_agreement
    FROM n GROUP BY 1""",
)
def whale_directional(spark, sf_dir):
    out = wallets.directional(_changes(spark, sf_dir), ["period"], amount="x")
    return rounded(out.withColumn("whale_net_flow", F.round("whale_net_flow", 2)))


@register("wallet_heavy_hitters", f"WITH {TRADES} SELECT wallet, count(*) AS trades, round(sum(price * size), 4) AS turnover FROM trades GROUP BY 1 ORDER BY sum(price * size) DESC, wallet LIMIT 20")
def wallet_heavy_hitters(spark, sf_dir):
    return rounded(wallets.heavy_hitters(trades(spark, sf_dir), 20), 4)


@register(
    "wallet_skill",
    f"""WITH {_CHANGES}, s AS (SELECT wallet, count(*) AS trades, avg((x > 0)::INT) AS w, coalesce(sum(x) FILTER (x > 0), 0) AS g, coalesce(-sum(x) FILTER (x < 0), 0) AS l, avg(x) AS m, stddev_samp(x) AS s FROM changes GROUP BY 1)
    SELECT wallet, trades, round(w, 6) AS win_rate, round(CASE WHEN l > 0 THEN g / l WHEN g > 0 THEN 999 ELSE 0 END, 6) AS profit_factor, round(CASE WHEN coalesce(s, 0) <> 0 THEN m / s ELSE 0 END, 6) AS sharpe FROM s""",
)
def wallet_skill(spark, sf_dir):
    return rounded(wallets.skill(_changes(spark, sf_dir), value="x"))


_RANKED = f"""{_CHANGES}, p AS (SELECT period, wallet, round(sum(x), 2) AS pnl FROM changes GROUP BY 1, 2),
ranked AS (
    SELECT period, 'top' AS cohort, wallet, row_number() OVER (PARTITION BY period ORDER BY pnl DESC, wallet)::INT AS rank, pnl FROM p
    UNION ALL SELECT period, 'bottom', wallet, row_number() OVER (PARTITION BY period ORDER BY pnl, wallet)::INT, pnl FROM p),
cohorts AS (SELECT * FROM ranked WHERE rank <= 50)"""


def _cohorts(spark, sf_dir):
    pnl = _changes(spark, sf_dir).groupBy("period", "wallet").agg(F.round(F.sum("x"), 2).alias("pnl"))
    return wallets.rank_cohorts(pnl, "period", 50)


@register("wallet_cohorts", f"WITH {_RANKED} SELECT * FROM cohorts")
def wallet_cohorts(spark, sf_dir):
    return _cohorts(spark, sf_dir)


@register(
    "wallet_cohort_stability",
    f"""WITH {_RANKED}, n AS (SELECT period, cohort, count(*) AS n FROM cohorts GROUP BY 1, 2),
    c AS (SELECT a.period, a.cohort, count(*) AS c FROM cohorts a JOIN cohorts b ON a.period = b.period + 1 AND a.cohort = b.cohort AND a.wallet = b.wallet GROUP BY 1, 2)
    SELECT n.period, n.cohort, round(coalesce(c, 0) / (n.n + b.n - coalesce(c, 0)), 6) AS jaccard
    FROM n JOIN n b ON n.period = b.period + 1 AND n.cohort = b.cohort LEFT JOIN c ON n.period = c.period AND n.cohort = c.cohort""",
)
def wallet_cohort_stability(spark, sf_dir):
    return rounded(wallets.cohort_stability(_cohorts(spark, sf_dir), "period"))


@register(
    "position_change_types",
    f"""WITH {_CHANGES}, p AS (SELECT wallet, period, round(sum(x), 2) AS x FROM changes GROUP BY 1, 2), d AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY wallet ORDER BY period), 0) AS b FROM p)
    SELECT wallet, period, round(x - b, 2) AS delta, CASE WHEN b = 0 AND x <> 0 THEN 'open' WHEN b <> 0 AND x = 0 THEN 'close' WHEN b * x < 0 THEN 'flip' WHEN abs(x) > abs(b) THEN 'increase' WHEN abs(x) < abs(b) THEN 'decrease' ELSE 'none' END AS change_type FROM d""",
)
def position_change_types(spark, sf_dir):
    from pyspark.sql import Window

    p = _changes(spark, sf_dir).groupBy("wallet", "period").agg(F.round(F.sum("x"), 2).alias("x"))
    before = F.coalesce(F.lag("x").over(Window.partitionBy("wallet").orderBy("period")), F.lit(0.0))
    return p.withColumn("b", before).select("wallet", "period", F.round(F.col("x") - F.col("b"), 2).alias("delta"), wallets.change_type(F.col("b"), F.col("x")).alias("change_type"))
