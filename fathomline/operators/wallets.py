"""Wallet and position operators: concentration, liquidation, whales, cohorts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import clip, plogp, ratio
from fathomline.functions.windows import ranked


def concentration(positions: DataFrame, keys: list[str], value: str = "value_usd", whale_usd: float = 8000.0, tops: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """For each key: top-n shares, HHI, Gini, Theil, whale share, average sizes of whales and others.

    Values that aren't positive are left out. Ranks are made within ranges of values, so a key with very many positions
    doesn't gather in one task; the top n are a limited sort.
    """
    p = positions.where(F.col(value) > 0).withColumn("_whale", F.col(value) >= whale_usd)
    x = F.col(value)
    totals = p.groupBy(*keys).agg(F.sum(x).alias("total"), F.count(F.lit(1)).alias("n"))
    order = [F.col(value).desc()]
    top = p.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= max(tops))
    top = top.groupBy(*keys).agg(*[F.sum(F.when(F.col("_k") <= t, x)).alias(f"_top{t}") for t in tops])
    by_rank = ranked(p, keys, [value], F.floor(F.log2(x) * 4))
    joined = by_rank.join(totals, keys)
    share, mean = x / F.col("total"), F.col("total") / F.col("n")
    sums = joined.groupBy(*keys).agg(
        F.first("total").alias("total"),
        F.first("n").alias("n_positions"),
        F.sum(share * share).alias("hhi"),
        F.sum((F.col("_n") + 1) * x).alias("_ranked"),
        F.sum(x / mean * F.log(x / mean)).alias("_theil"),
        F.sum(F.when(F.col("_whale"), x)).alias("_whales"),
        F.avg(F.when(F.col("_whale"), x)).alias("_whale_avg"),
        F.avg(F.when(~F.col("_whale"), x)).alias("_retail_avg"),
    )
    n, total = F.col("n_positions").cast("double"), F.col("total")
    return sums.join(top, keys).select(
        *keys,
        "n_positions",
        *[F.least(F.col(f"_top{t}") / total, F.lit(1.0)).alias(f"top{t}_concentration") for t in tops],
        "hhi",
        clip((2 * F.col("_ranked") - (n + 1) * total) / (n * total), 0, 1).alias("gini"),
        F.greatest(F.col("_theil") / n, F.lit(0.0)).alias("theil"),
        F.coalesce(F.col("_whales") / total, F.lit(0.0)).alias("whale_share"),
        F.coalesce(ratio("_whale_avg", "_retail_avg"), F.lit(0.0)).alias("whale_avg_size_ratio"),
    )


def at_risk(positions: DataFrame, keys: list[str], price: float, bands: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """USD that is liquidated when the price moves by each band in percent: longs below, shorts above; their asymmetry
    (above over below, 10 at most where below is zero, 1 where both are), and the largest position at risk."""
    liq, v = F.col("liquidation_price"), F.col("value_usd")
    long, short = F.col("is_long"), ~F.col("is_long")
    inside = lambda b: (long & (liq <= price) & (liq >= price * (1 - b / 100)), short & (liq >= price) & (liq <= price * (1 + b / 100)))
    aggs = []
    for b in bands:
        below, above = inside(b)
        aggs += [F.coalesce(F.sum(F.when(below, v)), F.lit(0.0)).alias(f"liquidation_risk_below_{b}pct"), F.coalesce(F.sum(F.when(above, v)), F.lit(0.0)).alias(f"liquidation_risk_above_{b}pct")]
    below, above = inside(max(bands))
    out = positions.groupBy(*keys).agg(*aggs, F.coalesce(F.max(F.when(below | above, v)), F.lit(0.0)).alias("largest_position_at_risk"), F.count(F.when(below | above, 1)).alias("positions_at_risk"))
    b, a = F.col(f"liquidation_risk_below_{max(bands)}pct"), F.col(f"liquidation_risk_above_{max(bands)}pct")
    return out.withColumn("liquidation_asymmetry", F.when((b < 1e-9) & (a < 1e-9), 1.0).when(b < 1e-9, 10.0).otherwise(a / b))


def nearest_cluster(positions: DataFrame, keys: list[str], price: float, step_pct: float = 0.5, reach: int = 40, least_usd: float = 1e6) -> DataFrame:
    """Distance in percent to the nearest step of prices that holds ``least_usd``; null where none does."""
    bucket = F.floor((F.col("liquidation_price") / price - 1) * 100 / step_pct)
    b = positions.withColumn("_b", bucket).where(F.col("_b").between(-reach, reach - 1)).groupBy(*keys, "_b").agg(F.sum("value_usd").alias("_usd"))
    distance = F.abs(F.col("_b") + 0.5) * step_pct
    return b.groupBy(*keys).agg(F.min(F.when(F.col("_usd") >= least_usd, distance)).alias("nearest_cluster_distance"), F.max("_usd").alias("largest_bucket_usd"))


def heatmap(positions: DataFrame, keys: list[str], price: float, bins: int = 200, width: float = 0.10) -> DataFrame:
    """(keys, bin, usd): positions by the log price of their liquidation, ``bins`` bins over ±``width``."""
    low, high = math.log(1 - width), math.log(1 + width)
    at = F.log(F.col("liquidation_price") / price)
    bin_ = F.least(F.floor((at - low) / (high - low) * bins).cast("int"), F.lit(bins - 1))
    return positions.where((at >= low) & (at <= high)).groupBy(*keys, bin_.alias("bin")).agg(F.sum("value_usd").alias("usd"))


def heatmap_block(heat: DataFrame, keys: list[str], bins: int = 200, width: float = 0.10, chain_usd: float = 1e5, chain_width: float = 0.05) -> DataFrame:
    """From ``heatmap``: mass below and above, asymmetry, mass-weighted distance, entropy, and the longest run of
    consecutive bins above ``chain_usd`` within ±``chain_width``."""
    low, high = math.log(1 - width), math.log(1 + width)
    centre = F.exp(low + (F.col("bin") + 0.5) * (high - low) / bins) - 1
    h = heat.withColumn("_c", centre)
    total = h.groupBy(*keys).agg(F.sum("usd").alias("_t"))
    sums = h.join(total, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_c") < 0, F.col("usd"))), F.lit(0.0)).alias("hm_mass_below"),
        F.coalesce(F.sum(F.when(F.col("_c") >= 0, F.col("usd"))), F.lit(0.0)).alias("hm_mass_above"),
        (F.sum(F.abs("_c") * F.col("usd")) / F.first("_t")).alias("hm_weighted_distance"),
        (F.sum(plogp(F.col("usd") / F.col("_t"))) / math.log(bins)).alias("hm_entropy"),
    )
    # Consecutive bins keep bin - row number constant.
    hot = h.where((F.col("usd") > chain_usd) & (F.abs("_c") <= chain_width))
    runs = hot.withColumn("_g", F.col("bin") - F.row_number().over(Window.partitionBy(*keys).orderBy("bin"))).groupBy(*keys, "_g").count()
    chain = runs.groupBy(*keys).agg(F.max("count").alias("hm_chain_length"))
    out = sums.join(chain, keys, "left").withColumn("hm_chain_length", F.coalesce("hm_chain_length", F.lit(0)))
    return out.withColumn("hm_asymmetry", ratio(F.col("hm_mass_above") - F.col("hm_mass_below"), F.col("hm_mass_above") + F.col("hm_mass_below")))


TIERS = ("retail", "small", "medium", "large", "mega")


def tier(position: Column, volume: Column, position_cuts=(1e5, 1e6, 1e7, 1e8), volume_cuts=(1e6, 1e7, 1e8, 1e9)) -> Column:
    """The larger of the tiers by position and by volume."""
    rank = lambda x, cuts: sum(((x >= c).cast("int") for c in cuts[1:]), (x >= cuts[0]).cast("int"))
    k = F.greatest(rank(position, position_cuts), rank(volume, volume_cuts))
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), k + 1)


def whale_score(position: Column, volume: Column, position_full: float = 1e7, volume_full: float = 1e8) -> Column:
    """0.6 and 0.4 of position and volume scores, each 100 at most."""
    return 0.6 * F.least(position / position_full * 100, F.lit(100.0)) + 0.4 * F.least(volume / volume_full * 100, F.lit(100.0))


def change_type(before: Column, after: Column) -> Column:
    b, a = F.coalesce(before, F.lit(0.0)), F.coalesce(after, F.lit(0.0))
    return (
        F.when((b == 0) & (a != 0), "open").when((b != 0) & (a == 0), "close").when(b * a < 0, "flip").when(F.abs(a) > F.abs(b), "increase").when(F.abs(a) < F.abs(b), "decrease").otherwise("none")
    )


def directional(changes: DataFrame, keys: list[str], wallet: str = "wallet", amount: str = "position_change_usd") -> DataFrame:
    """Net change by wallet, then counts: buy ratio b / (b + s), agreement (b - s) / (b + s), active wallets, net flow."""
    net = changes.groupBy(*keys, wallet).agg(F.sum(amount).alias("_net"))
    out = net.groupBy(*keys).agg(F.count(F.when(F.col("_net") > 0, 1)).alias("buyers"), F.count(F.when(F.col("_net") < 0, 1)).alias("sellers"), F.count(F.lit(1)).alias("active_whale_count"), F.sum("_net").alias("whale_net_flow"))
    b, s = F.col("buyers").cast("double"), F.col("sellers").cast("double")
    return out.withColumn("whale_buy_ratio", ratio(b, b + s, 0.5)).withColumn("whale_directional_agreement", ratio(b - s, b + s))


def heavy_hitters(trades: DataFrame, n: int, wallet: str = "wallet", amount: Column | None = None) -> DataFrame:
    """The ``n`` wallets with the largest turnover; ties by address."""
    amount = F.col("price") * F.col("size") if amount is None else amount
    return trades.groupBy(wallet).agg(F.count(F.lit(1)).alias("trades"), F.sum(amount).alias("turnover")).orderBy(F.desc("turnover"), wallet).limit(n)


def skill(pnl: DataFrame, wallet: str = "wallet", value: str = "pnl") -> DataFrame:
    """Win rate, profit factor (of gains to losses, 999 without a loss), Sharpe (mean / sample deviation), trades."""
    x = F.col(value)
    out = pnl.groupBy(wallet).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("_g"),
        F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0)).alias("_l"),
        F.avg(x).alias("_m"),
        F.stddev_samp(x).alias("_s"),
    )
    return out.withColumn("profit_factor", F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).when(F.col("_g") > 0, 999.0).otherwise(0.0)).withColumn("sharpe", ratio("_m", "_s")).drop("_g", "_l", "_m", "_s")


def rank_cohorts(pnl: DataFrame, period: str, k: int, wallet: str = "wallet", value: str = "pnl") -> DataFrame:
    """Members of the top and bottom ``k`` by value for each period; ties by address."""
    best = F.row_number().over(Window.partitionBy(period).orderBy(F.desc(value), wallet))
    worst = F.row_number().over(Window.partitionBy(period).orderBy(F.asc(value), wallet))
    top = pnl.withColumn("rank", best).where(F.col("rank") <= k).withColumn("cohort", F.lit("top"))
    bottom = pnl.withColumn("rank", worst).where(F.col("rank") <= k).withColumn("cohort", F.lit("bottom"))
    return top.unionByName(bottom).select(period, "cohort", wallet, "rank", value)


def cohort_stability(members: DataFrame, period: str, wallet: str = "wallet") -> DataFrame:
    """Jaccard similarity of each period's cohort (period numbered in steps of 1) with the one before."""
    size = members.groupBy(period, "cohort").agg(F.count(F.lit(1)).alias("n"))
    a, b = members.select(period, "cohort", wallet), members.select((F.col(period) + 1).alias(period), "cohort", wallet)
    common = a.join(b, [period, "cohort", wallet]).groupBy(period, "cohort").agg(F.count(F.lit(1)).alias("common"))
    before = size.select((F.col(period) + 1).alias(period), "cohort", F.col("n").alias("before"))
    out = size.join(before, [period, "cohort"]).join(common, [period, "cohort"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select(period, "cohort", (F.col("common") / (F.col("n") + F.col("before") - F.col("common"))).alias("jaccard"))


def realised_pnl(account_before: Column, account_after: Column, upnl_before: Column, upnl_after: Column, net_flow: Column) -> Column:
    """Change of account value, less change of unrealised profit, less net deposits."""
    return (account_after - account_before) - (upnl_after - upnl_before) - F.coalesce(net_flow, F.lit(0.0))
