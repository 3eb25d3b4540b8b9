"""Bars, time grids and causal alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import nan_to_null, ratio
from fathomline.functions.windows import MICROS, micros


def bucket(ts: str, seconds: int) -> Column:
    """Start of the bar, as a number of bars since the epoch."""
    return F.floor(micros(ts) / (seconds * MICROS))


def default_bars(df: DataFrame, columns: list[str], seconds: int, ts: str = "ts", order: str = "tid", keys: tuple[str, ...] = ("symbol",), least: int = 1) -> DataFrame:
    """First, last and sample deviation of each column, and ``n_ticks``; bars with fewer ticks than ``least`` are left out.
    NaN counts as missing."""
    aggs = [F.count(F.lit(1)).alias("n_ticks")]
    for c in columns:
        x = nan_to_null(c)
        aggs += [F.min_by(x, order).alias(f"{c}_first"), F.max_by(x, order).alias(f"{c}_last"), F.stddev_samp(x).alias(f"{c}_std")]
    return df.groupBy(*keys, bucket(ts, seconds).alias("bar")).agg(*aggs).where(F.col("n_ticks") >= least)


#: Kinds of columns and the aggregates that each gets.
KINDS = {"price": ("open", "high", "low", "close", "mean"), "sum": ("sum",), "max": ("max",), "entropy": ("mean", "std", "slope"), "default": ("mean", "std", "last")}


def typed_bars(df: DataFrame, kinds: dict[str, str], seconds: int, ts: str = "ts", order: str = "tid", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a key with the aggregates of each column's kind; slopes are least-squares over the tick number, 0 for fewer
    than two values."""
    df = df.withColumn("bar", bucket(ts, seconds))
    if "entropy" in kinds.values():
        df = df.withColumn("_i", (F.row_number().over(Window.partitionBy(*keys, "bar").orderBy(order)) - 1).cast("double"))
    make = {
        "open": lambda x: F.min_by(x, order),
        "high": F.max,
        "low": F.min,
        "close": lambda x: F.max_by(x, order),
        "last": lambda x: F.max_by(x, order),
        "mean": F.avg,
        "std": F.stddev_samp,
        "sum": F.sum,
        "max": F.max,
        "slope": lambda x: F.coalesce(F.regr_slope(x, F.col("_i")), F.lit(0.0)),
    }
    aggs = [make[a](nan_to_null(c)).alias(f"{c}_{a}") for c, k in kinds.items() for a in KINDS[k]]
    return df.groupBy(*keys, "bar").agg(F.count(F.lit(1)).alias("tick_count"), *aggs)


def multi_timeframe(df: DataFrame, kinds: dict[str, str], frames: dict[str, int], **options) -> dict[str, DataFrame]:
    """``typed_bars`` for each named length."""
    return {name: typed_bars(df, kinds, seconds, **options) for name, seconds in frames.items()}


def vwap_bars(trades: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Open, high, low, close, volume, VWAP, buy share and trade count of each bar."""
    v = F.sum("size")
    return trades.groupBy(*keys, bucket("ts", seconds).alias("bar")).agg(
        F.min_by("price", "tid").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "tid").alias("close"),
        v.alias("volume"),
        (F.sum(F.col("price") * F.col("size")) / v).alias("vwap"),
        (F.coalesce(F.sum(F.when(F.col("is_buy"), F.col("size"))), F.lit(0.0)) / v).alias("buy_share"),
        F.count(F.lit(1)).alias("trades"),
    )


def bar_counters(trades: DataFrame, seconds: int, jump: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Jumps larger than ``jump`` and the largest absolute change between adjacent prices inside each bar."""
    df = trades.withColumn("bar", bucket("ts", seconds))
    d = F.abs(F.col("price") - F.lag("price").over(Window.partitionBy(*keys, "bar").orderBy("tid")))
    return df.withColumn("_d", d).groupBy(*keys, "bar").agg(F.count(F.when(F.col("_d") > jump, 1)).alias("bar_jump_count"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("bar_max_abs_return"))


def tick_bars(df: DataFrame, ticks: int, price: str = "price") -> DataFrame:
    """Bars of a number of ticks; ``df`` has ``symbol`` and ``_n`` from ``windows.numbered``."""
    return df.groupBy("symbol", F.floor(F.col("_n") / ticks).alias("bar")).agg(
        F.min_by(price, "_n").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "_n").alias("close"), F.count(F.lit(1)).alias("ticks")
    )


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], horizon_seconds: int, strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` at or before (``strict``: before) its time, within the
    horizon; null where there is none.

    The rows of both sides are put in one ordered stream and carried forward. Time is cut into pieces of the horizon;
    rows of ``right`` also go to the next piece. No pair of rows is formed. Columns of ``left`` come back under their
    names; taken columns must not clash with them.
    """
    size = horizon_seconds * MICROS
    taken = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in columns])
    a = left.select(*keys, micros(left_ts).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(taken).schema[0].dataType).alias("_r"), F.lit(0 if strict else 1).alias("_side"))
    b = right.select(*keys, micros(right_ts).alias("_t"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), taken.alias("_r"), F.lit(1 if strict else 0).alias("_side"))
    a = a.withColumn("_piece", F.floor(F.col("_t") / size))
    b = b.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_t") / size), F.floor(F.col("_t") / size) + 1)))
    w = Window.partitionBy(*keys, "_piece").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    near = micros(F.col("_last._at")) >= F.col("_t") - size
    return both.select("_row.*", *[F.when(near, F.col(f"_last.{c}")).alias(c) for c in columns])


def wide(df: DataFrame, index: str, keys: str, value: str, names: list[str]) -> DataFrame:
    """One column for each of ``names``, holes kept as nulls."""
    return df.groupBy(index).pivot(keys, names).agg(F.max(value))


def cross_symbol(latest: DataFrame, value: str) -> DataFrame:
    """For each symbol's latest value: minus the mean of the others, that mean, and the sample deviation of all."""
    s = latest.agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), F.stddev_samp(value).alias("cross_obi_std"))
    # One row of totals.
    out = latest.crossJoin(F.broadcast(s))
    others = ratio(F.col("_s") - F.col(value), F.col("_n") - 1)
    return out.withColumn("cross_obi_mean", others).withColumn("cross_obi_diff", F.col(value) - others).drop("_s", "_n")
