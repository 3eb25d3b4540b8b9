"""Queries of preparation, panels and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions.windows import numbered
from fathomline.operators import extras, offline, price, wallets
from fathomline.plans.adapters import CANDLES, TRADES, candles, read, rounded
from fathomline.plans.catalogue import register
from fathomline.plans.stats import _PANEL, _ranks, panel

_O = "PARTITION BY symbol ORDER BY date"
_P = "u * (0.254829592::DOUBLE + u * (-0.284496736::DOUBLE + u * (1.421413741::DOUBLE + u * (-1.453152027::DOUBLE + u * 1.061405429::DOUBLE)))) * exp(-z * z / 2)"


@register(
    "bollinger_bands",
    f"""WITH {CANDLES}, b AS (SELECT symbol, date, close, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM candles WINDOW w AS ({_O} ROWS 19 PRECEDING))
    SELECT symbol, date, round(CASE WHEN n = 20 THEN CASE WHEN s > 1e-12 THEN (close - m + 2 * s) / (4 * s) ELSE 0.5 END END, 5) AS bb_pct, round(CASE WHEN n = 20 THEN 4 * s / m END, 6) AS bb_width FROM b""",
)
def bollinger_bands(spark, sf_dir):
    return price.bollinger(candles(spark, sf_dir)).select("symbol", "date", F.round("bb_pct", 5).alias("bb_pct"), F.round("bb_width", 6).alias("bb_width"))


@register(
    "prepared_matrix",
    f"""WITH {CANDLES}, s AS (SELECT avg(close) AS a, stddev_pop(close) AS s, avg(volume) AS b, stddev_pop(volume) AS t FROM candles) SELECT symbol, date, round(least(greatest((close - a) / s, -5), 5), 5) AS close, round(least(greatest((volume - b) / t, -5), 5), 5) AS volume FROM candles, s""",
)
def prepared_matrix(spark, sf_dir):
    c = candles(spark, sf_dir).select("symbol", "date", "close", "volume", F.lit(1.0).alias("one"), F.lit(float("nan")).alias("none"))
    out, _ = extras.prepared(c, ["close", "volume", "one", "none"])
    return rounded(out, 5)


@register("time_weighted_average", f"WITH {CANDLES} SELECT symbol, date, round(CASE WHEN count(close) OVER w >= 24 THEN avg(close) OVER w END, 6) AS twa FROM candles WINDOW w AS ({_O} ROWS 29 PRECEDING)")
def time_weighted_average(spark, sf_dir):
    return rounded(extras.time_weighted(candles(spark, sf_dir), "close", 30).select("symbol", "date", "twa"))


_POS = "pos AS (SELECT year(o_orderdate)::BIGINT AS ts_ms, o_custkey AS wallet, o_totalprice * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS position_value, o_totalprice / 100 AS unrealized_pnl, 1000.0::DOUBLE + o_custkey AS account_value FROM orders)"


def _positions(spark, sf_dir):
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("long").alias("ts_ms"), F.col("o_custkey").alias("wallet"), F.when(F.col("o_orderstatus") == "F", -p).otherwise(p).alias("position_value"), (p / 100).alias("unrealized_pnl"), (1000.0 + F.col("o_custkey")).alias("account_value")
    )


@register("account_panel", f"WITH {_POS} SELECT ts_ms, wallet, min(account_value) AS account_value, round(sum(unrealized_pnl), 4) AS unrealized_pnl, count(*) AS coins FROM pos GROUP BY 1, 2")
def account_panel(spark, sf_dir):
    return rounded(extras.account_panel(_positions(spark, sf_dir)), 4)


@register(
    "realised_pnl",
    f"""WITH {_POS}, a AS (SELECT ts_ms, wallet, min(account_value) + sum(position_value) / 1000 AS av, sum(unrealized_pnl) AS u FROM pos GROUP BY 1, 2), l AS (SELECT *, lag(av) OVER o AS b, lag(u) OVER o AS v FROM a WINDOW o AS (PARTITION BY wallet ORDER BY ts_ms)) SELECT ts_ms, wallet, round(av - b - (u - v), 4) AS pnl FROM l WHERE b IS NOT NULL""",
)
def realised_pnl(spark, sf_dir):
    from pyspark.sql import Window

    a = _positions(spark, sf_dir).groupBy("ts_ms", "wallet").agg((F.min("account_value") + F.sum("position_value") / 1000).alias("av"), F.sum("unrealized_pnl").alias("u"))
    o = Window.partitionBy("wallet").orderBy("ts_ms")
    a = a.withColumn("b", F.lag("av").over(o)).withColumn("v", F.lag("u").over(o)).where(F.col("b").isNotNull())
    return rounded(a.select("ts_ms", "wallet", wallets.realised_pnl(F.col("b"), F.col("av"), F.col("v"), F.col("u"), F.lit(0.0)).alias("pnl")), 4)


@register("cohort_net_positioning", f"WITH {_POS}, n AS (SELECT wallet, sum(position_value) AS v, min(account_value) AS a FROM pos WHERE wallet % 10 = 3 AND ts_ms = (SELECT max(ts_ms) FROM pos WHERE ts_ms <= 1999 AND wallet % 10 = 3) GROUP BY 1) SELECT round(sum(v) / sum(a), 5) AS net_positioning, count(*) AS wallets FROM n")
def cohort_net_positioning(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return rounded(extras.net_positioning(p, p.where("wallet % 10 = 3"), "ts_ms", "wallet", 1999), 5)


@register("bimodality", f"WITH {_PANEL}, m AS (SELECT symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM panel WHERE ret IS NOT NULL), s AS (SELECT symbol, avg(d ** 2) AS a, avg(d ** 3) AS b, avg(d ** 4) AS c FROM m GROUP BY 1) SELECT symbol, round((b * b / a ** 3 + 1) / (c / (a * a)), 6) AS bimodality FROM s")
def bimodality(spark, sf_dir):
    return rounded(extras.bimodality(panel(spark, sf_dir).where("ret IS NOT NULL"), "ret", ["symbol"]))


_LONG = "l AS (SELECT symbol, 'momentum' AS feature, momentum AS v, forward AS f FROM panel WHERE forward IS NOT NULL AND momentum IS NOT NULL UNION ALL SELECT symbol, 'volume', volume, forward FROM panel WHERE forward IS NOT NULL)"


@register(
    "tail_scan",
    f"""WITH {_PANEL}, {_LONG}, q AS (SELECT symbol, feature, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM l GROUP BY 1, 2), t AS (SELECT symbol, feature, CASE WHEN v <= lo THEN 'low' WHEN v >= hi THEN 'high' END AS tail, f FROM l JOIN q USING (symbol, feature)),
    s AS (SELECT symbol, feature, tail, count(*) AS n, avg(f) AS a, avg(f) / stddev_samp(f) * sqrt(count(*)) AS z FROM t WHERE tail IS NOT NULL GROUP BY 1, 2, 3), u AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS u FROM s), p AS (SELECT symbol, feature, tail, n, a, {_P} AS p FROM u),
    k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, row_number() OVER (ORDER BY p) AS k FROM p) SELECT symbol, feature, tail, n, round(a * 1e4, 4) AS edge_bps, round(p, 6) AS p, round(least(min(q) OVER (ORDER BY k DESC), 1), 6) AS q FROM k""",
)
def tail_scan(spark, sf_dir):
    out = extras.tails(panel(spark, sf_dir), ["momentum", "volume"], "forward", ["symbol"])
    return rounded(out.withColumn("edge_bps", F.round("edge_bps", 4)))


@register(
    "conjunction_scan",
    f"""WITH {_PANEL}, {" , ".join(f"c{i} AS (SELECT symbol, '{a}' AS a, '{b}' AS b, count(*) FILTER ({x} AND {y} AND forward IS NOT NULL) AS n, round(avg(forward) FILTER ({x} AND {y}), 6) AS mean_forward FROM panel GROUP BY 1)" for i, (a, x, b, y) in enumerate((("up", "momentum > 0", "busy", "volume > 200"), ("up", "momentum > 0", "jump", "abs(ret) > 0.1"), ("busy", "volume > 200", "jump", "abs(ret) > 0.1"))))}
    SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2""",
)
def conjunction_scan(spark, sf_dir):
    c = {"up": F.col("momentum") > 0, "busy": F.col("volume") > 200, "jump": F.abs("ret") > 0.1}
    return rounded(extras.conjunctions(panel(spark, sf_dir), c, "forward", ["symbol"]))


@register(
    "ic_by_year",
    f"""WITH {_PANEL}, b AS (SELECT *, year(date) AS day FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL), r AS (SELECT symbol, day, {_ranks("momentum", "symbol, day")} AS a, {_ranks("forward", "symbol, day")} AS c, {_ranks("momentum", "symbol")} AS wa, {_ranks("forward", "symbol")} AS wc FROM b),
    w AS (SELECT symbol, sign(corr(wa, wc)) AS s FROM r GROUP BY 1) SELECT symbol, day::INT AS day, round(corr(a, c), 6) AS ic, count(*) AS n, sign(corr(a, c)) = any_value(s) AS agrees FROM r JOIN w USING (symbol) GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def ic_by_year(spark, sf_dir):
    p = panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL")
    return rounded(extras.daily_ic(p, "momentum", "forward", F.year("date"), ["symbol"]))


@register("ic_table")
def ic_table(spark, sf_dir):
    p = offline.forward_returns(panel(spark, sf_dir), (1, 5))
    return rounded(extras.ic_table(p, ["momentum", "volume", "ret"], ["fwd_1", "fwd_5"], ["symbol"]))


_SHARPE = "CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(252) ELSE 0 END"


@register(
    "purged_validation",
    f"""WITH {_PANEL}, p AS (SELECT symbol, sign(momentum) * forward AS pnl, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n
        FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL),
    g AS (SELECT unnest(range(6)) AS g), s AS (SELECT (row_number() OVER (ORDER BY a.g, b.g) - 1)::INT AS split, a.g AS a, b.g AS b FROM g a JOIN g b ON a.g < b.g),
    x AS (SELECT symbol, split, pnl, i, n * a // 6 AS a0, n * (a + 1) // 6 AS a1, n * b // 6 AS b0, n * (b + 1) // 6 AS b1 FROM p CROSS JOIN s),
    y AS (SELECT symbol, split, CASE WHEN NOT (i >= a0 - 5 AND i < a1 + 5) AND NOT (i >= b0 - 5 AND i < b1 + 5) THEN pnl END AS inside, CASE WHEN (i >= a0 AND i < a1) OR (i >= b0 AND i < b1) THEN pnl END AS held FROM x)
    SELECT symbol, split, round({_SHARPE.format("inside")}, 6) AS is_sharpe, round({_SHARPE.format("held")}, 6) AS oos_sharpe FROM y GROUP BY 1, 2""",
)
def purged_validation(spark, sf_dir):
    p = numbered(panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL"), ["symbol"], ["date"], "date", 86_400 * 365)
    return rounded(extras.purged_scores(p.withColumn("pnl", F.signum("momentum") * F.col("forward")), "pnl", "_n", ["symbol"], 6, 2, 5))


@register("trailing_losses", f"WITH {_PANEL}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM panel) SELECT symbol, coalesce(min(k) FILTER (NOT coalesce(ret < 0, false)), count(*) + 1) - 1 AS trailing_losses FROM k GROUP BY 1")
def trailing_losses(spark, sf_dir):
    return extras.trailing_losses(panel(spark, sf_dir), ["symbol"], ["date"], "ret")


@register("illegal_transitions")
def illegal_transitions(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in ("proposed", "testing", "validated", "paper", "live")])
    h = read(spark, sf_dir, "events").withColumn("state", F.get(states, (F.col("event_id") % 5).cast("int")))
    return extras.illegal_transitions(h, "user_id", "event_id", "state")


@register("hour_histogram", f"WITH {TRADES} SELECT hour(ts)::INT AS hour, count(*) AS n, round(avg(price), 5) AS mean_price FROM trades GROUP BY 1")
def hour_histogram(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("value") + 100), 5).alias("mean_price"))
