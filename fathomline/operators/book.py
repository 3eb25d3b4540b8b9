"""Order-book operators: functions of the arrays ``bids`` and ``asks`` of struct<px:double, sz:double, n:int>.

Both sides are sorted from the best price outwards. A missing side gives nulls in the elementary operators and 0.0 in
the feature blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.numeric import plogp, ratio

LEVEL = "array<struct<px:double,sz:double,n:int>>"


def truncated(levels: Column, most: int) -> Column:
    return F.slice(levels, 1, most)


def best(levels: Column) -> Column:
    return F.get(levels, F.lit(0)).px


def mid(bids: Column, asks: Column) -> Column:
    return (best(bids) + best(asks)) / 2


def spread(bids: Column, asks: Column) -> Column:
    return best(asks) - best(bids)


def spread_bps(bids: Column, asks: Column) -> Column:
    return F.when(mid(bids, asks) > 0, spread(bids, asks) / mid(bids, asks) * 1e4)


def microprice(bids: Column, asks: Column) -> Column:
    """Prices weighted by the other side's size; the mid where both sizes are zero."""
    b, a = F.get(bids, F.lit(0)), F.get(asks, F.lit(0))
    return F.when(b.sz + a.sz > 0, (b.px * a.sz + a.px * b.sz) / (b.sz + a.sz)).otherwise(mid(bids, asks))


def _sum(levels: Column, n: int, of) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda s, x: s + of(x))


def depth(levels: Column, n: int) -> Column:
    return _sum(levels, n, lambda x: x.sz)


def notional(levels: Column, n: int) -> Column:
    return _sum(levels, n, lambda x: x.px * x.sz)


def orders(levels: Column, n: int) -> Column:
    return _sum(levels, n, lambda x: x.n.cast("double"))


def imbalance(b: Column, a: Column) -> Column:
    return ratio(b - a, b + a)


def volume_imbalance(bids: Column, asks: Column, n: int) -> Column:
    return imbalance(depth(bids, n), depth(asks, n))


def order_imbalance(bids: Column, asks: Column, n: int) -> Column:
    return imbalance(orders(bids, n), orders(asks, n))


def depth_weighted_imbalance(bids: Column, asks: Column) -> Column:
    """Sizes weighted by 1 / (1 + 100 |px - mid| / mid)."""
    m = mid(bids, asks)
    w = lambda x: x.sz / (1 + 100 * F.abs(x.px - m) / m)
    b, a = (F.aggregate(s, F.lit(0.0), lambda t, x: t + w(x)) for s in (bids, asks))
    return F.when(m > 0, imbalance(b, a)).otherwise(0.0)


def pressures(bids: Column, asks: Column) -> tuple[Column, Column]:
    """Cumulative depth over 1 + distance in bps / 10, summed over levels, both divided by the larger (1 at least)."""
    m = mid(bids, asks)

    def side(levels: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("p"))
        step = lambda s, x: F.struct((s.c + x.sz).alias("c"), (s.p + (s.c + x.sz) / (1 + F.abs(x.px - m) / m * 1e4 / 10)).alias("p"))
        return F.coalesce(F.aggregate(levels, zero, step, lambda s: s.p), F.lit(0.0))

    b, a = side(bids), side(asks)
    top = F.greatest(b, a, F.lit(1.0))
    return b / top, a / top


def shape_entropy(bids: Column, asks: Column) -> Column:
    """Shannon entropy of all level sizes over its largest value; 0 for fewer than two levels."""
    sizes = F.transform(F.concat(bids, asks), lambda x: x.sz)
    all_ = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + plogp(x / all_))
    return F.when((all_ > 0) & (F.size(sizes) > 1), h / F.log(F.size(sizes).cast("double"))).otherwise(0.0)


def status(bids: Column, asks: Column) -> Column:
    return F.when((F.size(bids) == 0) | (F.size(asks) == 0), "empty").when(best(bids) > best(asks), "crossed").when(best(bids) == best(asks), "locked").otherwise("ok")


def raw_block(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """The ten raw columns; missing values are 0.0."""
    b, a = F.col(bids), F.col(asks)
    out = {
        "raw_midprice": mid(b, a),
        "raw_spread": spread(b, a),
        "raw_spread_bps": spread_bps(b, a),
        "raw_microprice": microprice(b, a),
        "raw_bid_depth_5": depth(b, 5),
        "raw_ask_depth_5": depth(a, 5),
        "raw_bid_depth_10": depth(b, 10),
        "raw_ask_depth_10": depth(a, 10),
        "raw_bid_orders_5": orders(b, 5),
        "raw_ask_orders_5": orders(a, 5),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()})


def imbalance_block(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """The eight imbalance columns."""
    b, a = F.col(bids), F.col(asks)
    bid_pressure, ask_pressure = pressures(b, a)
    out = {
        "imbalance_qty_l1": volume_imbalance(b, a, 1),
        "imbalance_qty_l5": volume_imbalance(b, a, 5),
        "imbalance_qty_l10": volume_imbalance(b, a, 10),
        "imbalance_orders_l5": order_imbalance(b, a, 5),
        "imbalance_notional_l5": imbalance(notional(b, 5), notional(a, 5)),
        "imbalance_depth_weighted": depth_weighted_imbalance(b, a),
        "imbalance_pressure_bid": bid_pressure,
        "imbalance_pressure_ask": ask_pressure,
    }
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()})


def flat_snapshot(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """The flat snapshot row of a book; spreads are null unless the book is in order."""
    b, a = F.col(bids), F.col(asks)
    b0, a0 = F.get(b, F.lit(0)), F.get(a, F.lit(0))
    ok = status(b, a) == "ok"
    return df.withColumns(
        {
            "n_bid_levels": F.size(b),
            "n_ask_levels": F.size(a),
            "best_bid": b0.px,
            "best_ask": a0.px,
            "mid": F.when(ok, mid(b, a)),
            "spread": F.when(ok, spread(b, a)),
            "spread_bps": F.when(ok, spread_bps(b, a)),
            "half_spread_bps": F.when(ok, spread_bps(b, a) / 2),
            "bid_notional_l1": notional(b, 1),
            "ask_notional_l1": notional(a, 1),
            "bid_notional_5": notional(b, 5),
            "ask_notional_5": notional(a, 5),
            "status": status(b, a),
        }
    )
