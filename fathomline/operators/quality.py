"""Data-quality checks: each gives a small report table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.windows import drop_halo, micros, rows, sequenced


def missing_shares(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """For each column the share of null or NaN, whether it is constant, and whether it passes; one pass."""
    bad = lambda c: F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double"))
    one = df.agg(*[F.struct(bad(c).alias("missing"), (F.min(c) == F.max(c)).alias("constant")).alias(c) for c in columns])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.missing").alias("missing"), F.coalesce(F.col(f"{c}.constant"), F.lit(True)).alias("constant")) for c in columns])).alias("r"))
    return long.select("r.*").withColumn("ok", F.col("missing") <= most)


def gaps(df: DataFrame, keys: list[str], ts: str, tie: str, least_seconds: int) -> DataFrame:
    """Adjacent rows of a key further apart than ``least_seconds``."""
    d = sequenced(df, keys, [ts, tie], ts, 1)
    gap = (micros(ts) - F.lag(micros(ts)).over(rows(keys))) / 1e6
    return drop_halo(d.withColumn("gap_s", gap)).where(F.col("gap_s") > least_seconds).select(*keys, tie, "gap_s")


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows outside the bounds of each column."""
    one = df.agg(*[F.count(F.when(~F.col(c).between(lo, hi), 1)).alias(c) for c, (lo, hi) in bounds.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in bounds]), F.array(*[F.col(c) for c in bounds]))).alias("column", "outside"))


def balance(df: DataFrame, key: str, most: float = 3.0) -> DataFrame:
    """Rows of each key, and the ratio of the largest count to each."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ratio", F.max("n").over(Window.partitionBy()) / F.col("n")).withColumn("ok", F.col("ratio") <= most)


def rates(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows a second of each key over its own range."""
    span = (F.max(micros(ts)) - F.min(micros(ts))) / 1e6
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(span > 0, F.count(F.lit(1)) / span).alias("rows_per_s"))


def disorder(df: DataFrame, keys: list[str], ts: str, sequence: str) -> DataFrame:
    """Rows whose sequence number isn't above that of the row before."""
    d = sequenced(df, keys, [ts, sequence], ts, 1)
    bad = F.col(sequence) <= F.lag(sequence).over(rows(keys))
    return drop_halo(d.withColumn("_bad", bad)).groupBy(*keys).agg(F.count(F.when(F.col("_bad"), 1)).alias("disordered"))


def freshness(df: DataFrame, ts: str, now: Column, most_hours: float) -> DataFrame:
    hours = (micros(now) - F.max(micros(ts))) / 3.6e9
    return df.agg(hours.alias("stale_hours"), (hours <= most_hours).alias("ok"))


def usable_columns(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Why a column can't be used: all missing, too few values, constant; or ok."""
    x = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    one = df.agg(*[F.struct(F.count(x(c)).alias("n"), (F.min(x(c)) == F.max(x(c))).alias("k")).alias(c) for c in columns])
    why = lambda c: F.when(F.col(f"{c}.n") == 0, "all_missing").when(F.col(f"{c}.n") < least, "too_few").when(F.col(f"{c}.k"), "constant").otherwise("ok")
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), why(c).alias("reason")) for c in columns])).alias("r")).select("r.*")
