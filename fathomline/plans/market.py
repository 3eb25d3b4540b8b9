"""Queries of the order-book, tape, price, liquidity and toxicity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import book, liquidity, price, tape
from fathomline.plans.adapters import BOOKS, TRADES, books, rounded, trades
from fathomline.plans.catalogue import register

H = 3600

_TAPE_ORDER = "PARTITION BY symbol ORDER BY ts, tid"
_STEPS = f"""{TRADES},
steps AS (
    SELECT *, row_number() OVER o - 1 AS i, lag(price) OVER o AS before, price / lag(price) OVER o - 1 AS ret,
           coalesce(sign(price - lag(price) OVER o), 0)::INT AS change,
           CASE WHEN coalesce(sign(price - lag(price) OVER o), 0) = 0 THEN CASE WHEN is_buy THEN 1 ELSE -1 END ELSE sign(price - lag(price) OVER o) END::INT AS direction
    FROM trades WINDOW o AS ({_TAPE_ORDER}))"""


@register(
    "tape_flow_block",
    f"""WITH {TRADES}
    SELECT tid, symbol, count(*) OVER s AS flow_count_short, count(*) OVER m AS flow_count_medium, count(*) OVER g AS flow_count_long,
           sum(size) OVER s AS flow_volume_short, sum(size) OVER m AS flow_volume_medium, sum(size) OVER g AS flow_volume_long,
           round(coalesce(sum(CASE WHEN is_buy THEN size END) OVER m, 0) / sum(size) OVER m, 6) AS flow_aggressor_ratio_medium,
           round(coalesce(sum(CASE WHEN is_buy THEN size END) OVER g, 0) / sum(size) OVER g, 6) AS flow_aggressor_ratio_long,
           round(sum(price * size) OVER m / sum(size) OVER m, 6) AS flow_vwap,
           round((sum(price * size) OVER m / sum(size) OVER m - price) / price, 6) AS flow_vwap_deviation,
           round(sum(size) OVER g / count(*) OVER g, 6) AS flow_avg_trade_size, round(count(*) OVER m / 21600, 6) AS flow_intensity
    FROM trades WINDOW
        s AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
        m AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW),
        g AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""",
)
def tape_flow_block(spark, sf_dir):
    out = tape.flow_block(trades(spark, sf_dir), H, 6 * H, 24 * H)
    return rounded(out.select("tid", "symbol", *[c for c in out.columns if c.startswith("flow_")]))


@register(
    "tape_tick_entropy",
    f"""WITH {_STEPS},
    sums AS (
        SELECT tid, symbol, {", ".join(f"sum(CASE WHEN change = {k} THEN 1 ELSE 0 END) OVER w{h} AS c{h}_{k + 1}, sum(CASE WHEN change = {k} THEN size ELSE 0 END) OVER w{h} AS v{h}_{k + 1}" for h in (6, 24) for k in (-1, 0, 1))}
        FROM steps WINDOW {", ".join(f"w{h} AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND CURRENT ROW)" for h in (6, 24))})
    SELECT tid, symbol, {", ".join(f"round({' + '.join(f'CASE WHEN {p}{h}_{k} > 0 THEN -{p}{h}_{k} / ({p}{h}_0 + {p}{h}_1 + {p}{h}_2) * ln({p}{h}_{k} / ({p}{h}_0 + {p}{h}_1 + {p}{h}_2)) ELSE 0.0::DOUBLE END' for k in range(3))}, 6) AS {n}_{h}h" for h in (6, 24) for p, n in (("c", "ent_tick"), ("v", "ent_vol_tick")))}
    FROM sums""",
)
def tape_tick_entropy(spark, sf_dir):
    out = tape.tick_entropies(trades(spark, sf_dir), {"6h": 6 * H, "24h": 24 * H})
    return rounded(out.select("tid", "symbol", "ent_tick_6h", "ent_vol_tick_6h", "ent_tick_24h", "ent_vol_tick_24h"))


@register("tape_direction", f"WITH {_STEPS} SELECT tid, symbol, change, direction FROM steps")
def tape_direction(spark, sf_dir):
    return tape.with_direction(trades(spark, sf_dir)).select("tid", "symbol", "change", "direction")


@register(
    "tape_hawkes",
    f"""WITH {TRADES},
    x AS (
        SELECT a.tid, a.symbol, count(*) AS n, sum(0.5 * exp(-0.0005 * (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6)) AS e
        FROM trades a JOIN trades b ON a.symbol = b.symbol AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 3 HOUR GROUP BY 1, 2)
    SELECT tid, symbol, round(CASE WHEN n >= 2 THEN n / 10800 ELSE 0 END, 6) AS hawkes_mu, round(CASE WHEN n >= 2 THEN e ELSE 0 END, 6) AS hawkes_excitation,
           round(CASE WHEN n >= 2 THEN e / (n / 10800) ELSE 0 END, 4) AS hawkes_branching
    FROM x""",
)
def tape_hawkes(spark, sf_dir):
    out = tape.hawkes_block(trades(spark, sf_dir), 3 * H, decay=0.0005)
    return rounded(out.select("tid", "symbol", "hawkes_mu", "hawkes_excitation", F.round("hawkes_branching", 4).alias("hawkes_branching")))


def _sum(side: int, what: str, n: int) -> str:
    return f"coalesce(sum({what}) FILTER (side = {side} AND k <= {n}), 0)"


@register(
    "book_raw_block",
    f"""WITH {BOOKS}
    SELECT book_id, round(coalesce((any_value(bb) + any_value(ba)) / 2, 0), 6) AS raw_midprice, round(coalesce(any_value(ba) - any_value(bb), 0), 6) AS raw_spread,
           round(coalesce((any_value(ba) - any_value(bb)) / ((any_value(bb) + any_value(ba)) / 2) * 1e4, 0), 6) AS raw_spread_bps,
           round(coalesce((any_value(bb) * any_value(as1) + any_value(ba) * any_value(bs1)) / (any_value(as1) + any_value(bs1)), 0), 6) AS raw_microprice,
           round({_sum(0, "sz", 5)}, 6) AS raw_bid_depth_5, round({_sum(1, "sz", 5)}, 6) AS raw_ask_depth_5,
           round({_sum(0, "sz", 10)}, 6) AS raw_bid_depth_10, round({_sum(1, "sz", 10)}, 6) AS raw_ask_depth_10,
           {_sum(0, "n", 5)}::DOUBLE AS raw_bid_orders_5, {_sum(1, "n", 5)}::DOUBLE AS raw_ask_orders_5
    FROM levels JOIN tops USING (book_id) GROUP BY book_id""",
)
def book_raw_block(spark, sf_dir):
    out = book.raw_block(books(spark, sf_dir))
    return rounded(out.drop("bids", "asks"))


def _imb(what: str, n: int) -> str:
    b, a = _sum(0, what, n), _sum(1, what, n)
    return f"round(coalesce(({b} - {a}) / nullif({b} + {a}, 0), 0), 6)"


@register(
    "book_imbalance_block",
    f"""WITH {BOOKS},
    cum AS (SELECT *, sum(sz) OVER (PARTITION BY book_id, side ORDER BY k) AS c FROM levels JOIN tops USING (book_id)),
    p AS (
        SELECT book_id, coalesce(sum(c / (1 + abs(px - (bb + ba) / 2) / ((bb + ba) / 2) * 1e4 / 10)) FILTER (side = 0), 0) AS pb,
               coalesce(sum(c / (1 + abs(px - (bb + ba) / 2) / ((bb + ba) / 2) * 1e4 / 10)) FILTER (side = 1), 0) AS pa,
               sum(sz / (1 + 100 * abs(px - (bb + ba) / 2) / ((bb + ba) / 2))) FILTER (side = 0) AS wb,
               sum(sz / (1 + 100 * abs(px - (bb + ba) / 2) / ((bb + ba) / 2))) FILTER (side = 1) AS wa
        FROM cum GROUP BY 1)
    SELECT book_id, {_imb("sz", 1)} AS imbalance_qty_l1, {_imb("sz", 5)} AS imbalance_qty_l5, {_imb("sz", 10)} AS imbalance_qty_l10,
           {_imb("n", 5)}::DOUBLE AS imbalance_orders_l5, {_imb("px * sz", 5)} AS imbalance_notional_l5,
           round(coalesce((any_value(wb) - any_value(wa)) / (any_value(wb) + any_value(wa)), 0), 6) AS imbalance_depth_weighted,
           round(any_value(pb) / greatest(any_value(pb), any_value(pa), 1), 6) AS imbalance_pressure_bid, round(any_value(pa) / greatest(any_value(pb), any_value(pa), 1), 6) AS imbalance_pressure_ask
    FROM levels JOIN p USING (book_id) GROUP BY book_id""",
)
def book_imbalance_block(spark, sf_dir):
    return rounded(book.imbalance_block(books(spark, sf_dir)).drop("bids", "asks"))


@register(
    "book_shape_entropy",
    f"""WITH {BOOKS}, t AS (SELECT book_id, sum(sz) AS s, count(*) AS c FROM levels GROUP BY 1)
    SELECT book_id, round(CASE WHEN any_value(c) > 1 THEN sum(-(sz / s) * ln(sz / s)) / ln(any_value(c)) ELSE 0 END, 6) AS ent_book_shape
    FROM levels JOIN t USING (book_id) GROUP BY 1""",
)
def book_shape_entropy(spark, sf_dir):
    return rounded(books(spark, sf_dir).select("book_id", book.shape_entropy(F.col("bids"), F.col("asks")).alias("ent_book_shape")))


@register(
    "book_flat_snapshot",
    f"""WITH {BOOKS}
    SELECT book_id, (count(*) FILTER (side = 0))::INT AS n_bid_levels, (count(*) FILTER (side = 1))::INT AS n_ask_levels, any_value(bb) AS best_bid, any_value(ba) AS best_ask,
           round((any_value(bb) + any_value(ba)) / 2, 6) AS mid, round((any_value(ba) - any_value(bb)) / ((any_value(bb) + any_value(ba)) / 2) * 5e3, 6) AS half_spread_bps,
           round({_sum(0, "px * sz", 5)}, 4) AS bid_notional_5, round({_sum(1, "px * sz", 5)}, 4) AS ask_notional_5,
           CASE WHEN any_value(bb) IS NULL OR any_value(ba) IS NULL THEN 'empty' ELSE 'ok' END AS status
    FROM levels JOIN tops USING (book_id) GROUP BY 1""",
)
def book_flat_snapshot(spark, sf_dir):
    out = book.flat_snapshot(books(spark, sf_dir))
    out = out.withColumns({c: F.round(c, 4) for c in ("bid_notional_5", "ask_notional_5")})
    return rounded(out.select("book_id", "n_bid_levels", "n_ask_levels", "best_bid", "best_ask", "mid", "half_spread_bps", "bid_notional_5", "ask_notional_5", "status"))


def _w(n: int, last: str = "CURRENT ROW") -> str:
    return f"({_TAPE_ORDER} ROWS BETWEEN {n} PRECEDING AND {last})"


@register(
    "price_volatility_block",
    f"""WITH {_STEPS},
    v AS (
        SELECT *, coalesce(sqrt(avg(ret * ret) OVER {_w(59)}), 0) AS rs, coalesce(sqrt(avg(ret * ret) OVER {_w(299)}), 0) AS rl,
               max(price) OVER {_w(299)} AS hi, min(price) OVER {_w(299)} AS lo, first_value(price) OVER {_w(299)} AS op
        FROM steps),
    z AS (SELECT *, avg(rs) OVER {_w(2000, "1 PRECEDING")} AS m, stddev_samp(rs) OVER {_w(2000, "1 PRECEDING")} AS s, count(rs) OVER {_w(2000, "1 PRECEDING")} AS c FROM v)
    SELECT tid, symbol, round(rs, 6) AS vol_returns_short, round(rl, 6) AS vol_returns_long, round(CASE WHEN rl <> 0 THEN rs / rl ELSE 1 END, 6) AS vol_ratio,
           round(ln(hi / lo) / sqrt(4 * ln(2)), 6) AS vol_parkinson,
           round(sqrt(greatest(0, 0.5 * ln(hi / lo) ** 2 - (2 * ln(2) - 1) * ln(price / op) ** 2)), 6) AS vol_garman_klass,
           round(CASE WHEN c >= 120 AND s > 1e-10 THEN least(greatest((rs - m) / s, -10), 10) ELSE 0 END, 4) AS vol_zscore
    FROM z""",
)
def price_volatility_block(spark, sf_dir):
    out = price.volatility_block(trades(spark, sf_dir), 60, 300, history=2000)
    return rounded(out.select("tid", "symbol", "vol_returns_short", "vol_returns_long", "vol_ratio", "vol_parkinson", "vol_garman_klass", F.round("vol_zscore", 4).alias("vol_zscore")))


@register(
    "price_trend_block",
    f"""WITH {_STEPS},
    t AS (
        SELECT *, {", ".join(f"regr_slope(price, i) OVER {_w(n - 1)} AS s{n}, regr_r2(price, i) OVER {_w(n - 1)} AS q{n}, coalesce(sum(CASE WHEN ret > 0 THEN 1 END) OVER {_w(n - 2)}, 0) AS u{n}, coalesce(sum(CASE WHEN ret < 0 THEN 1 END) OVER {_w(n - 2)}, 0) AS d{n}" for n in (60, 300))},
               list(price) OVER {_w(299)} AS b
        FROM steps),
    e AS (SELECT *, list_reduce(b, lambda a, x: x * (2 / 11) + a * (9 / 11)) AS es, list_reduce(b, lambda a, x: x * (2 / 51) + a * (49 / 51)) AS el FROM t)
    SELECT tid, symbol, {", ".join(f"round(CASE WHEN i >= 19 THEN coalesce(s{n}, 0) ELSE 0 END, 5) AS trend_momentum_{n}, round(CASE WHEN i >= 19 THEN coalesce(q{n}, 0) ELSE 0 END, 5) AS trend_momentum_r2_{n}, round(CASE WHEN i >= 19 AND u{n} + d{n} > 0 THEN greatest(u{n}, d{n}) / (u{n} + d{n}) ELSE 0.5 END, 6) AS trend_monotonicity_{n}" for n in (60, 300))},
           round(CASE WHEN i >= 19 THEN es ELSE 0 END, 6) AS trend_ema_short, round(CASE WHEN i >= 19 THEN el ELSE 0 END, 6) AS trend_ema_long,
           round(CASE WHEN i >= 19 THEN 100 * (es - el) / el ELSE 0 END, 6) AS trend_crossover_norm
    FROM e""",
)
def price_trend_block(spark, sf_dir):
    out = price.trend_block(trades(spark, sf_dir))
    out = out.withColumns({c: F.round(c, 5) for c in out.columns if c.startswith("trend_momentum")})
    return rounded(out.select("tid", "symbol", *[c for c in out.columns if c.startswith("trend_") and c != "trend_crossover"]))


@register(
    "price_permutation_entropy",
    f"""WITH {_STEPS},
    p AS (
        SELECT tid, symbol, ts, CASE WHEN lag(ret, 2) OVER o IS NOT NULL THEN
            ((lag(ret, 2) OVER o <= lag(ret) OVER o)::INT * 4 + (lag(ret, 2) OVER o <= ret)::INT * 2 + (lag(ret) OVER o <= ret)::INT) END AS k
        FROM steps WINDOW o AS ({_TAPE_ORDER})),
    c AS (SELECT tid, symbol, {", ".join(f"sum((k = {j})::INT) OVER {_w(13)} AS c{j}" for j in range(8))}, count(k) OVER {_w(13)} AS n FROM p)
    SELECT tid, symbol, round(CASE WHEN n = 14 THEN ({" + ".join(f"CASE WHEN c{j} > 0 THEN -(c{j} / 14) * ln(c{j} / 14) ELSE 0 END" for j in range(8))}) / ln(6) ELSE 0 END, 6) AS ent_permutation_16
    FROM c""",
)
def price_permutation_entropy(spark, sf_dir):
    return rounded(price.permutation_entropy(trades(spark, sf_dir), 16, 3).select("tid", "symbol", "ent_permutation_16"))


@register(
    "price_dispersion_entropy",
    f"""WITH {_STEPS},
    l AS (SELECT tid, symbol, list(ret) OVER {_w(31)} AS a FROM steps),
    u AS (SELECT tid, symbol, len(list_filter(a, lambda x: x IS NOT NULL)) AS n, list_min(a) AS lo, list_max(a) AS hi, unnest(a) AS x FROM l),
    b AS (SELECT tid, symbol, any_value(n) AS n, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS c FROM u WHERE x IS NOT NULL GROUP BY tid, symbol, bin)
    SELECT tid, symbol, round(CASE WHEN any_value(n) >= 32 THEN sum(-(c / n) * ln(c / n)) / ln(10) ELSE 0 END, 6) AS ent_dispersion_32 FROM b GROUP BY 1, 2
    UNION ALL SELECT tid, symbol, 0 FROM steps WHERE i = 0""",
)
def price_dispersion_entropy(spark, sf_dir):
    return rounded(price.returns_entropy(trades(spark, sf_dir), 32).select("tid", "symbol", "ent_dispersion_32"))


@register("price_hurst")
def price_hurst(spark, sf_dir):
    return rounded(price.hurst_by_key(trades(spark, sf_dir), 300))


def _slope_sql(y: str, x: str, w: str) -> str:
    return f"CASE WHEN var_pop({x}) OVER {w} > 1e-12 THEN covar_pop({y}, {x}) OVER {w} / var_pop({x}) OVER {w} ELSE 0 END"


@register(
    "illiquidity_lambdas",
    f"""WITH {_STEPS},
    d AS (SELECT *, price - before AS d, (price - before) * lag(price - before) OVER o AS dd, CASE WHEN before IS NOT NULL THEN size * direction END AS sv, CASE WHEN before IS NOT NULL THEN size END AS sz FROM steps WINDOW o AS ({_TAPE_ORDER})),
    l AS (
        SELECT tid, symbol, CASE WHEN i >= 29 THEN abs({_slope_sql("d", "sv", _w(98))}) ELSE 0 END AS k, CASE WHEN i >= 19 THEN 1e6 * sum(abs(ret)) OVER {_w(98)} / sum(sz) OVER {_w(98)} ELSE 0 END AS a,
               CASE WHEN i >= 49 THEN 1e6 * abs({_slope_sql("ret", "sv", _w(98))}) ELSE 0 END AS h, avg(dd) OVER {_w(97)} AS r
        FROM d)
    SELECT tid, symbol, round(k, 5) AS illiq_kyle_100, round(a, 3) AS illiq_amihud_100, round(h, 3) AS illiq_hasbrouck_100, round(CASE WHEN r < 0 THEN 2 * sqrt(-r) ELSE 0 END, 5) AS illiq_roll_100, round((k + a + h) / 3, 3) AS illiq_composite_100
    FROM l""",
)
def illiquidity_lambdas(spark, sf_dir):
    out = liquidity.lambdas(trades(spark, sf_dir), 100)
    digits = {"illiq_kyle_100": 5, "illiq_amihud_100": 3, "illiq_hasbrouck_100": 3, "illiq_roll_100": 5, "illiq_composite_100": 3}
    return out.select("tid", "symbol", *[F.round(c, d).alias(c) for c, d in digits.items()])


@register(
    "toxicity_spreads",
    f"""WITH {_STEPS},
    d AS (SELECT *, price - before AS e, lag(direction, 5) OVER o * (price / lag(price, 5) OVER o - 1) * 1e4 AS adv FROM steps WINDOW o AS ({_TAPE_ORDER})),
    l AS (SELECT *, list(price) OVER {_w(99)} AS ps, sum(price * size) OVER {_w(99)} / sum(size) OVER {_w(99)} AS vw FROM d),
    x AS (
        SELECT tid, symbol, 2 * list_avg(list_transform(ps, lambda p: abs(p - vw))) AS a, 2 * avg(direction * e) OVER {_w(99)} AS b, avg(adv) OVER {_w(94)} AS c, sum(direction * size) OVER {_w(99)} / sum(size) OVER {_w(99)} AS f
        FROM l)
    SELECT tid, symbol, round(a, 5) AS toxic_effective_spread, round(b, 8) AS toxic_realized_spread, round(c, 5) AS toxic_adverse_selection, round(f, 6) AS toxic_flow_imbalance FROM x""",
)
def toxicity_spreads(spark, sf_dir):
    out = liquidity.spreads(trades(spark, sf_dir), 100)
    digits = {"toxic_effective_spread": 5, "toxic_realized_spread": 8, "toxic_adverse_selection": 5, "toxic_flow_imbalance": 6}
    return out.select("tid", "symbol", *[F.round(c, d).alias(c) for c, d in digits.items()])


@register("toxicity_vpin")
def toxicity_vpin(spark, sf_dir):
    out = liquidity.toxicity_blocks(trades(spark, sf_dir), 500, 50)
    index = liquidity.toxicity_index(F.col("toxic_vpin"), F.lit(0.0), F.abs("toxic_flow_imbalance"))
    return rounded(out.withColumn("toxic_index", index))
