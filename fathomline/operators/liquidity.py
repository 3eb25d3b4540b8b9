"""Illiquidity and toxicity over windows of trades."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fathomline.functions.numeric import ratio
from fathomline.functions.windows import drop_halo, numbered, row_sum, rows, running, sequenced
from fathomline.operators.tape import with_direction


def lambdas(trades: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Over the last n trades: Kyle (|slope| of price changes on signed volume, from 30 trades on), Amihud (sum of
    |returns| over sum of volumes, times 1e6, from 20 on), Hasbrouck (|slope| of returns on signed volume, times 1e6, from
    50 on), Roll (2 sqrt of minus the mean product of adjacent price changes), and the mean of the first three."""
    k = list(keys)
    df = sequenced(with_direction(trades, keys), k, ["ts", "tid"], "ts", n + 2)
    before = F.lag("price").over(rows(k))
    df = df.withColumn("_d", F.col("price") - before).withColumn("_r", F.when(before > 0, F.col("price") / before - 1))
    df = df.withColumn("_dd", F.col("_d") * F.lag("_d").over(rows(k))).withColumn("_sv", F.when(F.col("_d").isNotNull(), F.col("size") * F.col("direction")))
    # Running sums over the bucket; a frame's sums are differences of these.
    d, r, sv = F.col("_d"), F.col("_r"), F.col("_sv")
    has = r.isNotNull()
    parts = {"d_n": d.isNotNull().cast("double"), "d": d, "s": sv, "ss": sv * sv, "ds": d * sv, "r_n": has.cast("double"), "r": r, "rs": r * sv, "s_r": F.when(has, sv), "abs": F.abs(r), "size": F.when(has, F.col("size")), "dd_n": F.col("_dd").isNotNull().cast("double"), "dd": F.col("_dd")}
    df = df.withColumns({f"_sum_{c}": F.sum(F.coalesce(x, F.lit(0.0))).over(running(k)) for c, x in parts.items()})
    df = df.withColumns({f"_w_{c}": row_sum(f"_sum_{c}", k, n - 2 if c.startswith("dd") else n - 1) for c in parts})
    g = lambda c: F.col(f"_w_{c}")
    variance = g("ss") / F.nullif(g("d_n"), F.lit(0.0)) - F.pow(g("s") / F.nullif(g("d_n"), F.lit(0.0)), F.lit(2))
    slope = lambda xy, x, y, m: F.when(variance > 1e-12, (xy / F.nullif(m, F.lit(0.0)) - x / F.nullif(m, F.lit(0.0)) * (y / F.nullif(m, F.lit(0.0)))) / variance).otherwise(0.0)
    from_ = lambda least, x: F.when(F.col("_n") >= least - 1, x).otherwise(0.0)
    roll = g("dd") / F.nullif(g("dd_n"), F.lit(0.0))
    df = df.withColumns(
        {
            f"illiq_kyle_{n}": from_(30, F.abs(slope(g("ds"), g("d"), g("s"), g("d_n")))),
            f"illiq_amihud_{n}": from_(20, 1e6 * ratio(g("abs"), g("size"))),
            f"illiq_hasbrouck_{n}": from_(50, 1e6 * F.abs(slope(g("rs"), g("r"), g("s_r"), g("r_n")))),
            f"illiq_roll_{n}": F.when(roll < -1e-12, 2 * F.sqrt(-roll)).otherwise(0.0),
        }
    )
    df = df.withColumn(f"illiq_composite_{n}", (F.col(f"illiq_kyle_{n}") + F.col(f"illiq_amihud_{n}") + F.col(f"illiq_hasbrouck_{n}")) / 3)
    return drop_halo(df).drop("_n", "_d", "_r", "_dd", "_sv", *[f"_sum_{c}" for c in parts], *[f"_w_{c}" for c in parts])


def spreads(trades: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Over the last n trades: effective spread 2 mean |p - vwap| and realised spread, the mean of 2 direction (p - p
    before); adverse selection, the mean of direction times the return over the next five, in bps (of
    the trades whose five are known by now); and the flow imbalance by direction."""
    k = list(keys)
    df = sequenced(with_direction(trades, keys), k, ["ts", "tid"], "ts", n + 6)
    before, ago = F.lag("price").over(rows(k)), F.lag("price", 5).over(rows(k))
    df = df.withColumn("_e", F.col("price") - before).withColumn("_adv", F.lag("direction", 5).over(rows(k)) * (F.col("price") / ago - 1) * 1e4)
    p, z, way = F.col("price"), F.col("size"), F.col("direction")
    parts = {"z": z, "e_n": F.col("_e").isNotNull().cast("double"), "e": way * F.col("_e"), "adv_n": F.col("_adv").isNotNull().cast("double"), "adv": F.col("_adv"), "flow": way * z}
    df = df.withColumns({f"_sum_{c}": F.sum(F.coalesce(x.cast("double"), F.lit(0.0))).over(running(k)) for c, x in parts.items()})
    df = df.withColumns({f"_w_{c}": row_sum(f"_sum_{c}", k, n - 5 if c.startswith("adv") else n) for c in parts})
    g = lambda c: F.col(f"_w_{c}")
    df = with_distance(df, "price", "size", k, n)
    df = df.withColumns(
        {
            "toxic_effective_spread": 2 * F.col("_distance"),
            "toxic_realized_spread": 2 * g("e") / F.nullif(g("e_n"), F.lit(0.0)),
            "toxic_adverse_selection": g("adv") / F.nullif(g("adv_n"), F.lit(0.0)),
            "toxic_flow_imbalance": ratio(g("flow"), g("z")),
        }
    )
    return drop_halo(df).drop("_n", "_e", "_adv", "_distance", *[f"_sum_{c}" for c in parts], *[f"_w_{c}" for c in parts])


def with_distance(df: DataFrame, value: str, weight: str, keys: list[str], n: int) -> DataFrame:
    """``df`` (from ``row_halo``) with ``_distance``: the mean of |value - weighted mean| over the last ``n`` rows, by one pass
    over each bucket's rows; null where the weights add up to nothing."""
    schema = StructType([*df.schema.fields, StructField("_distance", DoubleType())])
    # One value after another, as an aggregate adds them, so that results agree to the last bit.
    added = lambda v: np.cumsum(np.nan_to_num(v, nan=0.0), axis=1)[:, -1]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        x, w = (np.concatenate((np.full(n - 1, np.nan), table.column(c).cast("double").to_numpy())) for c in (value, weight))
        out = np.empty(table.num_rows)
        for i in range(0, len(out), 4096):
            xs, ws = (np.lib.stride_tricks.sliding_window_view(v[i : i + 4096 + n - 1], n) for v in (x, w))
            total = added(ws)
            centre = added(xs * ws) / np.where(total == 0, np.nan, total)
            out[i : i + 4096] = np.where(total == 0, np.nan, added(np.abs(xs - centre[:, None])) / np.maximum((~np.isnan(xs)).sum(axis=1), 1))
        return table.append_column("_distance", pa.array(out, from_pandas=True))

    return df.groupBy(*keys, "_bucket").applyInArrow(one, schema)


def vpin(size: np.ndarray, direction: np.ndarray, buckets: int) -> float:
    """Buckets of total / ``buckets`` filled trade by trade, a trade never split; the last counts if over half full.
    Sum of |buy - sell| over buckets, divided by the volume in them."""
    total = size.sum()
    if total <= 0 or len(size) < 2:
        return 0.0
    want, gap, seen, b, s = total / buckets, 0.0, 0.0, 0.0, 0.0
    for v, d in zip(size, direction):
        if d > 0:
            b += v
        else:
            s += v
        if b + s >= want:
            gap, seen, b, s = gap + abs(b - s), seen + b + s, 0.0, 0.0
    if b + s > want / 2:
        gap, seen = gap + abs(b - s), seen + b + s
    return float(gap / seen) if seen > 0 else 0.0


def toxicity_blocks(trades: DataFrame, rows_each: int = 500, buckets: int = 50, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """VPIN and its change between the halves (10 buckets each) for consecutive blocks of trades of a key. The fill is
    sequential within a block, so blocks go to Python one by one."""
    k = list(keys)
    df = numbered(with_direction(trades, keys), k, ["ts", "tid"], "ts").withColumn("block", F.floor(F.col("_n") / rows_each))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        v, d = pdf["size"].to_numpy(), pdf["direction"].to_numpy()
        h = len(v) // 2
        change = vpin(v[h:], d[h:], 10) - vpin(v[:h], d[:h], 10) if len(v) >= 40 else 0.0
        flow = float((v * d).sum() / v.sum()) if v.sum() > 0 else 0.0
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in k}, "block": [pdf["block"].iloc[0]], "toxic_vpin": [vpin(v, d, buckets)], "toxic_vpin_roc": [change], "toxic_flow_imbalance": [flow]})

    kinds = ", ".join(f"{c} {trades.schema[c].dataType.simpleString()}" for c in k)
    return df.select(*k, "block", "_n", "size", "direction").groupBy(*k, "block").applyInPandas(one, f"{kinds}, block long, toxic_vpin double, toxic_vpin_roc double, toxic_flow_imbalance double")


def toxicity_index(vpin_: Column, adverse: Column, flow_abs: Column) -> Column:
    return 0.5 * vpin_ + 0.3 * F.least(F.abs(adverse) / 100, F.lit(1.0)) + 0.2 * flow_abs
