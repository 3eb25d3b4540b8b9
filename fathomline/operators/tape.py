"""Trade-tape operators over time frames that end at the latest trade, both ends included.

Input: ``symbol``, ``ts``, ``tid``, ``price``, ``size``, ``is_buy``; a row of output for each trade, as of that trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.numeric import plogp, ratio
from fathomline.functions.windows import MICROS, drop_halo, micros, rows, sequenced, time_sums


def with_direction(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``direction``: 1 or -1 by the change from the trade before; for no change or no trade before, the aggressor's."""
    df = sequenced(trades, list(keys), ["ts", "tid"], "ts", back=1)
    before = F.lag("price").over(rows(list(keys)))
    own = F.when(F.col("is_buy"), 1).otherwise(-1)
    change = F.signum(F.col("price") - before).cast("int")
    out = df.withColumn("direction", F.when(before.isNull() | (change == 0), own).otherwise(change))
    # change alone, for entropies over {down, unchanged, up}
    out = out.withColumn("change", F.coalesce(change, F.lit(0)))
    return drop_halo(out).drop("_n")


def _entropy(parts: list[Column]) -> Column:
    """Entropy, natural log, of shares; what is left below 1e-9 of a running sum is rounding."""
    parts = [F.when(p > 1e-9, p).otherwise(0.0) for p in parts]
    all_ = parts[0] + parts[1] + parts[2]
    return F.when(all_ > 0, plogp(parts[0] / all_) + plogp(parts[1] / all_) + plogp(parts[2] / all_)).otherwise(0.0)


def window_statistics(trades: DataFrame, seconds: dict[str, int], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each labelled window in seconds: count, volume, buy and sell volume, aggressor ratio (0.5 without volume), VWAP,
    average size, intensity, as ``{name}_{label}``."""
    size = F.col("size")
    sums = {"count": F.lit(1), "volume": size, "buy_volume": F.when(F.col("is_buy"), size), "_notional": F.col("price") * size}
    df = time_sums(trades, list(keys), "ts", sums, seconds)
    for x, s in seconds.items():
        c, v = F.col(f"count_{x}"), F.col(f"volume_{x}")
        df = df.withColumns(
            {
                f"count_{x}": c.cast("long"),
                f"sell_volume_{x}": v - F.col(f"buy_volume_{x}"),
                f"aggressor_ratio_{x}": ratio(f"buy_volume_{x}", v, 0.5),
                f"vwap_{x}": ratio(f"_notional_{x}", v, None),
                f"avg_trade_size_{x}": ratio(v, c),
                f"intensity_{x}": c / s,
            }
        ).drop(f"_notional_{x}")
    return df


def flow_block(trades: DataFrame, short: int = 1, medium: int = 5, long: int = 30, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The twelve flow columns for windows of three lengths in seconds."""
    df = window_statistics(trades, {"short": short, "medium": medium, "long": long}, keys)
    out = {f"flow_{n}_{x}": F.col(f"{n}_{x}") for n in ("count", "volume") for x in ("short", "medium", "long")}
    out |= {f"flow_aggressor_ratio_{x}": F.col(f"aggressor_ratio_{x}") for x in ("medium", "long")}
    out |= {
        "flow_vwap": F.col("vwap_medium"),
        "flow_vwap_deviation": ratio(F.col("vwap_medium") - F.col("price"), F.col("price")),
        "flow_avg_trade_size": F.col("avg_trade_size_long"),
        "flow_intensity": F.col("intensity_medium"),
    }
    return df.select(*trades.columns, *[c.alias(n) for n, c in out.items()])


def tick_entropies(trades: DataFrame, windows: dict[str, int], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``ent_tick_{name}`` and ``ent_vol_tick_{name}`` for each named window in seconds: entropy of {down, unchanged, up} by
    counts and by volume."""
    moves = {"down": F.col("change") == -1, "same": F.col("change") == 0, "up": F.col("change") == 1}
    sums = {f"_n_{k}": F.when(c, 1) for k, c in moves.items()} | {f"_v_{k}": F.when(c, F.col("size")) for k, c in moves.items()}
    directed = with_direction(trades, keys)
    df = time_sums(directed, list(keys), "ts", sums, windows)
    made = {f"ent_{n}tick_{x}": _entropy([F.col(f"_{p}_{k}_{x}") for k in moves]) for x in windows for p, n in (("n", ""), ("v", "vol_"))}
    return df.select(*directed.columns, *[c.alias(n) for n, c in made.items()])


def hawkes_block(trades: DataFrame, seconds: int = 30, kick: float = 0.5, decay: float = 1.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Fixed-kernel self-excitation: base rate n / seconds, excitation sum of kick * exp(-decay * age) over the frame, and
    their ratio; zeros for fewer than two trades.

    exp(-decay * age) is a quotient of weights that grow with time, exp(decay * time since the bucket began), so the
    excitation is a sliding sum of weights over the trade's own. Later weights are the larger, so what rounding leaves of
    trades that are gone is small beside the trade's own. Buckets are short enough for weights to stay finite.
    """
    if not 0 <= decay < 1e6:
        raise ValueError("decay is from 0 to a million a second")
    k, bucket, reach = list(keys), max(4 * seconds, 86_400), seconds
    if decay:
        # Beyond 746 / decay a kernel of doubles is zero.
        bucket, reach = min(bucket, 600 / decay), min(seconds, 746 / decay)
    size = round(bucket * MICROS)

    def weight(cell: Column) -> Column:
        return F.exp(F.lit(float(decay)) * (micros("ts") - cell * size) / MICROS)

    count, weights = {"_n": F.lit(1)}, {"_w": weight(F.col("_bucket"))}
    if bucket >= seconds:
        df = time_sums(trades, k, "ts", count | weights, {"all": seconds, "near": reach}, bucket)
    else:  # a halo of many buckets for the few that are counted
        df = time_sums(time_sums(trades, k, "ts", count, {"all": seconds}), k, "ts", weights, {"near": reach}, bucket)
    n, sum_ = F.col("_n_all"), F.col("_w_near")
    excitation = kick * sum_ / weight(F.floor(micros("ts") / size))
    df = df.withColumn("hawkes_mu", F.when(n >= 2, n / seconds).otherwise(0.0)).withColumn("hawkes_excitation", F.when(n >= 2, excitation).otherwise(0.0))
    df = df.withColumn("hawkes_branching", ratio("hawkes_excitation", "hawkes_mu"))
    return df.select(*trades.columns, "hawkes_mu", "hawkes_excitation", "hawkes_branching")
