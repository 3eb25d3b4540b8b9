"""Alert rules, cooldown, latest rows, research-store queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(df: DataFrame, conditions: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row (keys, ``alert``) for each condition that a row of ``df`` meets; null conditions don't fire."""
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(fired).alias("alert"))


def cooldown(alerts: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol", "alert"), ts: str = "ts") -> DataFrame:
    """Alerts that fire: of a key, those at least ``seconds`` after the last one fired. What fires depends on what fired
    before, so a key's alerts go through one small loop in order; alerts are few after ``rules``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        keep, last = [], None
        for t in pdf[ts]:
            fire = last is None or (t - last).total_seconds() >= seconds
            keep.append(fire)
            last = t if fire else last
        return pdf[keep]

    return alerts.groupBy(*keys).applyInPandas(one, alerts.schema)


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(ts, tie)).alias("_r")).select("_r.*")


def health(df: DataFrame, now: Column, ts: str = "ts", key: str = "symbol", degraded_s: int = 3600, dead_s: int = 86_400) -> DataFrame:
    """Age of each key's newest row and its state."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(F.col(ts).cast("timestamp")))) / 1e6
    out = df.groupBy(key).agg(age.alias("age_s"))
    return out.withColumn("state", F.when(F.col("age_s") >= dead_s, "dead").when(F.col("age_s") >= degraded_s, "degraded").otherwise("ok"))


def listing(df: DataFrame, filters: dict[str, object], created: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows that equal the filters (None: any), newest first, one page."""
    for c, v in filters.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(F.col(created).desc(), tie).offset(offset).limit(limit)


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of the columns, and overall."""
    out = df.groupingSets([[], *[[F.col(c)] for c in columns]], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns], F.lit("all"))
    return out.select(which.alias("column"), F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("")).alias("value"), "n")


def co_occurrence(df: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs of different items of a group (sets of bounded size, such as the features of a hypothesis)."""
    sets = df.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("s"))
    a = sets.select(group, "s", F.posexplode("s").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def category(name: Column, prefixes: dict[str, str]) -> Column:
    """The category of the first prefix that fits."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(c)) for p, c in prefixes.items()], F.lit("other"))
