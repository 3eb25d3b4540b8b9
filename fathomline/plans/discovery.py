"""Queries of information, cluster, state, execution and ranking operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fathomline.functions.windows import numbered
from fathomline.operators import book as book_ops
from fathomline.operators import discovery, execution, offline
from fathomline.plans.adapters import BOOKS, TRADES, books, read, rounded, trades
from fathomline.plans.catalogue import register
from fathomline.plans.stats import _PANEL, _ranks, panel

_O = "PARTITION BY symbol ORDER BY date"


def _mi_sql(b: int) -> str:
    return f"""e{b} AS (SELECT symbol, floor((momentum - min(momentum) OVER w) / (max(momentum) OVER w - min(momentum) OVER w) * {b - 1}) AS bx, floor((forward - min(forward) OVER w) / (max(forward) OVER w - min(forward) OVER w) * {b - 1}) AS bf FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL WINDOW w AS (PARTITION BY symbol)),
    c{b} AS (SELECT symbol, bx, bf, count(*)::DOUBLE AS c FROM e{b} GROUP BY 1, 2, 3), m{b} AS (SELECT symbol, c, sum(c) OVER (PARTITION BY symbol) AS n, sum(c) OVER (PARTITION BY symbol, bx) AS cx, sum(c) OVER (PARTITION BY symbol, bf) AS cf FROM c{b}),
    r{b} AS (SELECT symbol, greatest(sum(c / n * log2(c * n / (cx * cf))), 0) AS mi FROM m{b} GROUP BY 1)"""


@register("mutual_information_adaptive", f"WITH {_PANEL}, {_mi_sql(6)}, {_mi_sql(12)}, {_mi_sql(24)}, u AS (SELECT * FROM r6 UNION ALL SELECT * FROM r12 UNION ALL SELECT * FROM r24) SELECT symbol, round(median(mi), 6) AS mi FROM u GROUP BY 1")
def mutual_information_adaptive(spark, sf_dir):
    p = panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL")
    return rounded(discovery.adaptive_mi(p, "momentum", "forward", ["symbol"], 2048))


def _h(cols: str) -> str:
    return f"(SELECT l_returnflag, sum(-(c / n) * log2(c / n)) AS h FROM (SELECT l_returnflag, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY l_returnflag) AS n FROM d GROUP BY l_returnflag, {cols}) GROUP BY 1)"


@register(
    "mutual_information_conditional",
    f"""WITH d AS (SELECT l_returnflag, floor(l_quantity / 10) AS x, floor(l_extendedprice / 20000) AS y, l_linenumber AS z FROM lineitem), x AS {_h("x")}, y AS {_h("y")}, z AS {_h("z")}, xy AS {_h("x, y")}, xz AS {_h("x, z")}, yz AS {_h("y, z")}, xyz AS {_h("x, y, z")}
    SELECT l_returnflag, round(greatest(x.h + y.h - xy.h, 0), 6) AS mi, round(greatest(xz.h + yz.h - xyz.h - z.h, 0), 6) AS cmi, round(xz.h + yz.h - xyz.h - z.h - (x.h + y.h - xy.h), 6) AS interaction
    FROM x JOIN y USING (l_returnflag) JOIN z USING (l_returnflag) JOIN xy USING (l_returnflag) JOIN xz USING (l_returnflag) JOIN yz USING (l_returnflag) JOIN xyz USING (l_returnflag)""",
)
def mutual_information_conditional(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_returnflag", F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_extendedprice") / 20000).alias("y"), F.col("l_linenumber").alias("z"))
    return rounded(discovery.conditional_mi(d, "x", "y", "z", ["l_returnflag"]))


@register(
    "transfer_entropy_linear",
    f"""WITH {_PANEL}, d AS (SELECT symbol, forward AS y, ret AS p, volume AS x FROM panel WHERE forward IS NOT NULL AND ret IS NOT NULL), c AS (SELECT symbol, corr(y, p) AS a, corr(y, x) AS b, corr(x, p) AS c FROM d GROUP BY 1)
    SELECT symbol, round(0.5 * log2((1 - a * a) / (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c))), 6) AS te FROM c""",
)
def transfer_entropy_linear(spark, sf_dir):
    d = panel(spark, sf_dir).where("forward IS NOT NULL AND ret IS NOT NULL")
    return rounded(d.groupBy("symbol").agg(discovery.linear_transfer_entropy("volume", "forward", "ret").alias("te")))


@register(
    "walk_forward_correlation",
    f"""WITH {_PANEL}, i AS (SELECT symbol, momentum AS x, forward AS y, least(floor((row_number() OVER ({_O}) - 1) * 5 / count(*) OVER (PARTITION BY symbol)), 4)::BIGINT AS f FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL),
    k AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS fold) SELECT symbol, fold, round(corr(x, y) FILTER (f < fold), 6) AS is_corr, round(corr(x, y) FILTER (f = fold), 6) AS oos_corr, round(corr(x, y) FILTER (f = fold) / corr(x, y) FILTER (f < fold), 4) AS ratio FROM i, k GROUP BY 1, 2""",
)
def walk_forward_correlation(spark, sf_dir):
    out = discovery.walk_forward_correlation(panel(spark, sf_dir), "momentum", "forward", ["symbol"], ["date"])
    return rounded(out.withColumn("ratio", F.round("ratio", 4)))


@register(
    "ic_expanding",
    f"""WITH {_PANEL}, n AS (SELECT symbol, momentum, forward, row_number() OVER ({_O}) - 1 AS i FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL), e AS (SELECT n.*, x.e AS "end" FROM n JOIN (SELECT unnest([100, 200, 400, 800]) AS e) x ON x.e > i),
    r AS (SELECT symbol, "end", {_ranks("momentum", 'symbol, "end"')} AS a, {_ranks("forward", 'symbol, "end"')} AS b FROM e) SELECT symbol, "end", round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) = "end" """,
)
def ic_expanding(spark, sf_dir):
    p = numbered(panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL"), ["symbol"], ["date"], "date", 86_400 * 365)
    return rounded(discovery.expanding_ic(p, "momentum", "forward", ["symbol"], "_n", [100, 200, 400, 800]))


@register(
    "breakeven_cost",
    f"""WITH {_PANEL}, d AS (SELECT symbol, sign(momentum) * forward AS p, abs(sign(momentum) - lag(sign(momentum)) OVER ({_O})) AS t FROM panel WHERE momentum IS NOT NULL) SELECT symbol, round(avg(p) / avg(t) * 1e4, 4) AS breakeven_bps FROM d GROUP BY 1""",
)
def breakeven_cost(spark, sf_dir):
    return rounded(discovery.breakeven_bps(panel(spark, sf_dir).where("momentum IS NOT NULL"), ["symbol"], ["date"], "momentum", "forward"), 4)


@register(
    "sign_persistence",
    f"""WITH {_PANEL}, d AS (SELECT symbol, {", ".join(f"CASE WHEN sign(ret) <> 0 AND lead(sign(ret), {h}) OVER ({_O}) <> 0 THEN (lead(sign(ret), {h}) OVER ({_O}) = sign(ret))::INT END AS p{h}" for h in (1, 5))} FROM panel WHERE ret IS NOT NULL) SELECT symbol, round(avg(p1), 6) AS p_same_1, round(avg(p5), 6) AS p_same_5 FROM d GROUP BY 1""",
)
def sign_persistence(spark, sf_dir):
    return rounded(discovery.sign_persistence(panel(spark, sf_dir).where("ret IS NOT NULL"), ["symbol"], ["date"], "ret", (1, 5)))


@register(
    "rank_persistence",
    f"""WITH {_PANEL}, r AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY momentum, symbol) AS r FROM panel WHERE momentum IS NOT NULL), l AS (SELECT date, r, {", ".join(f"lag(r, {k}) OVER ({_O}) AS l{k}" for k in (1, 5))} FROM r),
    c AS (SELECT date, {", ".join(f"CASE WHEN count(l{k}) >= 3 THEN CASE WHEN coalesce(stddev_pop(CASE WHEN l{k} IS NOT NULL THEN r END) * stddev_pop(l{k}), 0) > 1e-15 THEN covar_pop(r, l{k}) / (stddev_pop(CASE WHEN l{k} IS NOT NULL THEN r END) * stddev_pop(l{k})) ELSE 0 END END AS c{k}" for k in (1, 5))} FROM l GROUP BY 1)
    SELECT 1 AS lag, round(avg(c1), 6) AS autocorr FROM c UNION ALL SELECT 5, round(avg(c5), 6) FROM c""",
)
def rank_persistence(spark, sf_dir):
    return rounded(discovery.rank_persistence(panel(spark, sf_dir), "date", "symbol", "momentum", (1, 5)))


_SNAP = f"""{BOOKS}, snap AS (SELECT book_id % 20 AS symbol, CASE WHEN any_value(bb) IS NULL OR any_value(ba) IS NULL THEN 'empty' ELSE 'ok' END AS status, (any_value(ba) - any_value(bb)) / ((any_value(bb) + any_value(ba)) / 2) * 5e3 AS half_spread_bps,
    coalesce(sum(px * sz) FILTER (side = 0 AND k = 1), 0) AS touch, coalesce(sum(px * sz) FILTER (side = 0 AND k <= 5), 0) AS depth FROM levels JOIN tops USING (book_id) GROUP BY book_id),
l2 AS (SELECT symbol, count(*) AS seen, count(*) FILTER (status = 'ok') AS n, median(half_spread_bps) FILTER (status = 'ok') AS median_half_spread, quantile_cont(half_spread_bps, 0.9) FILTER (status = 'ok') AS p90_half_spread, median(touch) FILTER (status = 'ok') AS median_touch, median(depth) FILTER (status = 'ok') AS median_depth FROM snap GROUP BY 1)"""


def _l2(spark, sf_dir):
    s = book_ops.flat_snapshot(books(spark, sf_dir)).select((F.col("book_id") % 20).alias("symbol"), "status", "half_spread_bps", F.col("bid_notional_l1").alias("touch"), F.col("bid_notional_5").alias("depth"))
    return discovery.l2_summary(s)


@register("l2_summary", f"WITH {_SNAP} SELECT symbol, seen, n, round(median_half_spread, 5) AS median_half_spread, round(p90_half_spread, 5) AS p90_half_spread, round(median_touch, 3) AS median_touch, round(median_depth, 3) AS median_depth, round(n / seen, 6) AS ok_share FROM l2")
def l2_summary(spark, sf_dir):
    digits = {"median_half_spread": 5, "p90_half_spread": 5, "median_touch": 3, "median_depth": 3, "ok_share": 6}
    return _l2(spark, sf_dir).select("symbol", "seen", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@register("l2_admission", f"WITH {_SNAP} SELECT symbol, concat_ws(',', CASE WHEN median_half_spread > 50 THEN 'median_half_spread' END, CASE WHEN p90_half_spread > 130 THEN 'p90_half_spread' END, CASE WHEN median_touch < 31000 THEN 'median_touch' END) AS failed, NOT (median_half_spread > 50 OR p90_half_spread > 130 OR median_touch < 31000) AS admitted FROM l2")
def l2_admission(spark, sf_dir):
    return discovery.admission(_l2(spark, sf_dir), {"median_half_spread": 50.0, "p90_half_spread": 130.0}, {"median_touch": 31_000.0}).select("symbol", "failed", "admitted")


@register("l2_tradability_curve", f"WITH {_SNAP}, c AS (SELECT unnest([40.0::DOUBLE, 45.0::DOUBLE, 50.0::DOUBLE, 60.0::DOUBLE]) AS ceiling) SELECT ceiling, count(*) FILTER (median_half_spread <= ceiling) AS admitted FROM l2, c GROUP BY 1")
def l2_tradability_curve(spark, sf_dir):
    return discovery.tradability_curve(_l2(spark, sf_dir), "median_half_spread", [40.0, 45.0, 50.0, 60.0])


@register(
    "adjusted_rand",
    """WITH d AS (SELECT label AS a, vec_id % 5 AS b FROM embeddings), n AS (SELECT a, b, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n FROM n), x AS (SELECT sum(c * (c - 1) / 2) AS a FROM (SELECT sum(c) AS c FROM n GROUP BY a)), y AS (SELECT sum(c * (c - 1) / 2) AS b FROM (SELECT sum(c) AS c FROM n GROUP BY b))
    SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, x, y""",
)
def adjusted_rand(spark, sf_dir):
    return rounded(discovery.adjusted_rand(read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5).alias("b")), "label", "b"))


@register("cluster_k_means")
def cluster_k_means(spark, sf_dir):
    return discovery.k_means(read(spark, sf_dir, "embeddings"), "embedding", 10).select("vec_id", "cluster")


@register("principal_components")
def principal_components(spark, sf_dir):
    p = discovery.principal_components(read(spark, sf_dir, "embeddings"), "embedding", 3)
    return rounded(p.select("vec_id", *[F.get("pc", F.lit(i)).alias(f"pc{i}") for i in range(3)]))


@register("hmm_states")
def hmm_states(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("s", F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")).cast("int") - 1)
    # all users' events, in sequences of a month
    model = discovery.fit_hmm(e, ["user_id", F.date_trunc("month", "ts")], "event_id", "s", 2, 5, rounds=5)
    return discovery.decoded_states(e, "user_id", "event_id", "s", model)


@register(
    "lead_lag",
    f"""WITH RECURSIVE {TRADES}, n AS (SELECT DISTINCT ts, min(ts) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600000001 MICROSECONDS FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM trades),
    anchors AS (SELECT min(ts) AS anchor FROM n UNION ALL SELECT next FROM anchors JOIN n ON n.ts = anchor WHERE next IS NOT NULL),
    e AS (SELECT anchor, symbol, min(ts) AS ts FROM trades JOIN anchors ON ts >= anchor AND ts <= anchor + INTERVAL 3600 SECOND GROUP BY 1, 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY ts, symbol) AS k FROM e)
    SELECT symbol, count(*) AS episodes, count(*) FILTER (k = 1) AS led, round(avg(epoch_us(ts) - epoch_us(anchor)) / 1e6, 6) AS mean_delay_s FROM f GROUP BY 1""",
)
def lead_lag(spark, sf_dir):
    return rounded(discovery.lead_lag(trades(spark, sf_dir), "symbol", "ts", 3600))


@register(
    "conditional_predictability",
    f"""WITH {_PANEL}, q AS (SELECT symbol, quantile_cont(volume, [1/3, 2/3]) AS q FROM panel GROUP BY 1), d AS (SELECT symbol, len(list_filter(q, lambda x: x < volume))::INT AS bucket, momentum, forward FROM panel JOIN q USING (symbol) WHERE momentum IS NOT NULL AND forward IS NOT NULL),
    r AS (SELECT symbol, bucket, {_ranks("momentum", "symbol, bucket")} AS a, {_ranks("forward", "symbol, bucket")} AS b FROM d) SELECT symbol, bucket, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY 1, 2""",
)
def conditional_predictability(spark, sf_dir):
    return rounded(discovery.conditional_predictability(panel(spark, sf_dir), "momentum", "forward", "volume", ["symbol"]))


@register("twap_slices", "SELECT o_orderkey, i AS slice, round(o_totalprice / 4, 4) AS slice_quantity, epoch_us(o_orderdate) // 1000000 + i * 900 AS at_s FROM orders, (SELECT unnest([0, 1, 2, 3]) AS i)")
def twap_slices(spark, sf_dir):
    out = execution.twap_slices(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", 4, 900)
    return rounded(out.select("o_orderkey", "slice", "slice_quantity", F.unix_seconds("at").alias("at_s")), 4)


@register("vwap_slices", "WITH p AS (SELECT hour(ts) // 6 AS b, sum(value) AS v FROM events GROUP BY 1) SELECT o_orderkey, b AS bucket, round(o_totalprice * v / (SELECT sum(v) FROM p), 4) AS slice_quantity FROM orders, p")
def vwap_slices(spark, sf_dir):
    p = read(spark, sf_dir, "events").groupBy(F.floor(F.hour("ts") / 6).alias("bucket")).agg(F.sum("value").alias("v"))
    return rounded(execution.vwap_slices(read(spark, sf_dir, "orders"), "o_totalprice", p, "bucket", "v").select("o_orderkey", "bucket", "slice_quantity"), 4)


@register(
    "spread_half_life",
    f"""WITH {_PANEL}, d AS (SELECT symbol, lag(close) OVER ({_O}) AS l, close - lag(close) OVER ({_O}) AS d FROM panel), s AS (SELECT symbol, count(*) AS n, regr_slope(d, l) AS s, regr_sxx(d, l) AS x, regr_syy(d, l) AS y FROM d WHERE l IS NOT NULL GROUP BY 1)
    SELECT symbol, n, round(s, 6) AS slope, round(s / sqrt(greatest(y - s * s * x, 0) / (n - 2) / x), 4) AS t, round(CASE WHEN s < 0 AND s > -1 THEN ln(2) / -ln(1 + s) END, 6) AS half_life FROM s""",
)
def spread_half_life(spark, sf_dir):
    out = execution.spread_half_life(panel(spark, sf_dir), "close", ["symbol"], ["date"])
    return rounded(out.withColumn("t", F.round("t", 4)))


@register("pairs_trades")
def pairs_trades(spark, sf_dir):
    z = offline.temporal_derivatives(panel(spark, sf_dir), "close", (20,))
    return execution.pairs_trades(z, "z_20", "symbol", "date")


@register(
    "event_study",
    f"""WITH {_PANEL}, f AS (SELECT symbol, ret, lead(close, 1) OVER ({_O}) / close - 1 AS fwd_1, lead(close, 5) OVER ({_O}) / close - 1 AS fwd_5 FROM panel)
    SELECT symbol, count(*) FILTER (ret > 0.1) AS events, round(avg(fwd_1) FILTER (ret > 0.1), 6) AS fwd_1_event, round(avg(fwd_1), 6) AS fwd_1_base, round(avg(fwd_5) FILTER (ret > 0.1), 6) AS fwd_5_event, round(avg(fwd_5), 6) AS fwd_5_base FROM f GROUP BY 1""",
)
def event_study(spark, sf_dir):
    d = offline.forward_returns(panel(spark, sf_dir), (1, 5))
    return rounded(execution.event_study(d, F.col("ret") > 0.1, ["fwd_1", "fwd_5"], ["symbol"]))


@register(
    "funding_carry",
    f"""WITH {TRADES}, z AS (SELECT tid, symbol, price / 1e4 AS f, CASE WHEN coalesce(stddev_samp(price) OVER w, 0) > 1e-8 THEN (price - avg(price) OVER w) / stddev_samp(price) OVER w ELSE 0 END AS z FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, tid ROWS 99 PRECEDING))
    SELECT tid, symbol, CASE WHEN abs(z) > 1.5 THEN -sign(z) ELSE 0 END::DOUBLE AS position, round(CASE WHEN abs(z) > 1.5 THEN sign(z) ELSE 0 END * f, 7) AS carry FROM z""",
)
def funding_carry(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("funding", F.col("price") / 1e4)
    return rounded(execution.carry(t, "funding", 100, 1.5).select("tid", "symbol", "position", "carry"), 7)


@register("tension_grid")
def tension_grid(spark, sf_dir):
    return rounded(execution.tension_grid(trades(spark, sf_dir), "size", "price", [(0.1, 0.1), (0.3, 0.1), (0.1, 0.3)]))


@register(
    "tournament_ranking",
    f"""WITH {_PANEL}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM panel WHERE ret IS NOT NULL), s AS (SELECT symbol, avg(ret) FILTER (k <= 7) / stddev_samp(ret) FILTER (k <= 7) * sqrt(365) AS a, avg(ret) / stddev_samp(ret) * sqrt(365) AS b, avg((ret > 0)::INT) AS w FROM k WHERE k <= 30 GROUP BY 1),
    r AS (SELECT *, (rank() OVER (ORDER BY a DESC) + rank() OVER (ORDER BY b DESC) + rank() OVER (ORDER BY w DESC)) / 3 AS m FROM s) SELECT symbol, round(a, 5) AS sharpe_short, round(b, 5) AS sharpe_long, round(w, 6) AS win_rate, row_number() OVER (ORDER BY m, symbol)::INT AS rank FROM r""",
)
def tournament_ranking(spark, sf_dir):
    out = execution.ranking(panel(spark, sf_dir).where("ret IS NOT NULL"), "symbol", "date", "ret")
    return out.select("symbol", F.round("sharpe_short", 5).alias("sharpe_short"), F.round("sharpe_long", 5).alias("sharpe_long"), F.round("win_rate", 6).alias("win_rate"), "rank")


@register("digital_probability")
def digital_probability(spark, sf_dir):
    t = trades(spark, sf_dir)
    return rounded(t.select("tid", execution.digital_probability(F.col("price"), F.lit(120.0), F.lit(0.6), F.lit(0.1)).alias("p")))


@register("maker_quotes", f"WITH {TRADES}, v AS (SELECT tid, price, size - 5 AS q, 0.1 * 0.02 * 0.02 * 0.5::DOUBLE AS v FROM trades) SELECT tid, round(price - q * v - (v + 20 * ln(1 + 0.1 / 1.5)) / 2, 6) AS bid, round(price - q * v + (v + 20 * ln(1 + 0.1 / 1.5)) / 2, 6) AS ask FROM v")
def maker_quotes(spark, sf_dir):
    b, a = execution.quotes(F.col("price"), F.col("size") - 5, 0.1, F.lit(0.02), F.lit(0.5), 1.5)
    return rounded(trades(spark, sf_dir).select("tid", b.alias("bid"), a.alias("ask")))


@register("fifo_pairs")
def fifo_pairs(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("side", F.when(F.col("is_buy"), 1).otherwise(-1))
    return rounded(execution.fifo_pairs(t, "symbol", "tid", "side", "price"))
