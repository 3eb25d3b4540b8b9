"""Window frames that don't gather a whole key in one task.

A market has few symbols, so a window partitioned by symbol alone runs in as many tasks as there are symbols. The
frames of this library are finite. A key's rows are therefore cut into buckets, each bucket also gets the rows before
it that its frames reach back to (the halo), the window runs by key and bucket, and halo rows are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; a timestamp without a zone, or a date, is taken in the session's zone (UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_halo(df: DataFrame, ts: str, back_seconds: float, ahead_seconds: float = 0, bucket_seconds: float | None = None) -> DataFrame:
    """``df`` with ``_bucket`` and ``_own``: each row once in its own bucket, and as halo in those whose frames reach it."""
    size = round((bucket_seconds or max(4 * (back_seconds + ahead_seconds), 86_400)) * MICROS)
    at = micros(ts)
    first = F.floor((at - round(ahead_seconds * MICROS)) / size)
    last = F.floor((at + round(back_seconds * MICROS)) / size)
    return df.withColumn("_bucket", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_bucket") == F.floor(at / size))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_bucket", "_own")


def time_frame(keys: list[str], ts: str, back_seconds: int, ahead_seconds: int = 0):
    """A range frame over ``time_halo`` rows: from ``back_seconds`` before to ``ahead_seconds`` after, both included."""
    return Window.partitionBy(*keys, "_bucket").orderBy(micros(ts)).rangeBetween(-back_seconds * MICROS, ahead_seconds * MICROS)


def numbered(df: DataFrame, keys: list[str], order: list[str], ts: str, grain_seconds: int = 86_400) -> DataFrame:
    """``df`` with ``_n``: each row's number within its key by ``order`` (whose first column is ``ts``), from 0."""
    return ranked(df, keys, order, F.floor(micros(ts) / (grain_seconds * MICROS)))


def ranked(df: DataFrame, keys: list[str], order: list, grain: Column) -> DataFrame:
    """``df`` with ``_n`` as in ``numbered``; ``grain`` grows with the order.

    Rows are numbered within (key, grain) and the counts of earlier grains are added; the table of counts has a row for
    each key and grain only, so no task sees a whole key.
    """
    cut = df.withColumn("_grain", grain)
    counts = cut.groupBy(*keys, "_grain").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_grain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(*keys, "_grain").orderBy(*order)) - 1
    return cut.withColumn("_inside", inside).join(before, [*keys, "_grain"]).withColumn("_n", F.col("_before") + F.col("_inside")).drop("_grain", "_inside", "_before")


def row_halo(df: DataFrame, back: int, ahead: int = 0, bucket_rows: int | None = None) -> DataFrame:
    """Like ``time_halo`` for frames of rows; ``df`` has ``_n`` from ``numbered``."""
    size = bucket_rows or max(4 * (back + ahead), 50_000)
    first = F.floor((F.col("_n") - ahead) / size)
    last = F.floor((F.col("_n") + back) / size)
    first = F.greatest(first, F.lit(0))
    return df.withColumn("_bucket", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_bucket") == F.floor(F.col("_n") / size))


def rows(keys: list[str], back: int | None = None, ahead: int = 0):
    """A frame of the ``back`` rows before, this one, and ``ahead`` after it; without ``back`` the bare ordered window."""
    w = Window.partitionBy(*keys, "_bucket").orderBy("_n")
    return w if back is None else w.rowsBetween(-back, ahead)


def sequenced(df: DataFrame, keys: list[str], order: list[str], ts: str, back: int, ahead: int = 0) -> DataFrame:
    """``numbered`` and then ``row_halo``."""
    return row_halo(numbered(df, keys, order, ts), back, ahead)


def time_sums(df: DataFrame, keys: list[str], ts: str, sums: dict[str, Column], seconds: dict[str, float], bucket_seconds: float | None = None) -> DataFrame:
    """``df`` with ``{name}_{label}``: each named Column summed over the last ``seconds`` of each label, both ends included.

    A sliding frame would add up its rows again for every row. Here each row is put in twice or more, once with its
    values and once for each label with the negative ones just after they leave the frame, and running sums over that
    stream give all frames in one pass. Nulls count as zero. A summed Column may refer to ``_bucket``, of ``bucket_seconds``.
    """
    d = time_halo(df, ts, max(seconds.values()), bucket_seconds=bucket_seconds).withColumn("_v", F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()]))
    t = 2 * micros(ts)
    # kind 0 enters all frames; kind k leaves frame k, after what enters at the same time.
    moves = [F.struct(t.alias("t"), F.lit(0).alias("kind"))] + [F.struct((t + 2 * round(s * MICROS) + 1).alias("t"), F.lit(k).alias("kind")) for k, s in enumerate(seconds.values(), 1)]
    row = F.struct(*[F.col(c) for c in df.columns])
    stream = d.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_bucket", "_v", F.when(F.col("_own"), row).alias("_row"), F.explode(F.array(*moves)).alias("_m")).select("*", "_m.*")
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    step = lambda k, n: F.when(F.col("kind") == 0, F.col(f"_v.{n}")).when(F.col("kind") == k, -F.col(f"_v.{n}"))
    made = {f"{n}_{label}": F.sum(step(k, n)).over(w) for k, label in enumerate(seconds, 1) for n in sums}
    out = stream.withColumn("_row", F.when(F.col("kind") == 0, F.col("_row"))).withColumns(made)
    return out.where(F.col("_row").isNotNull()).select("_row.*", *made)


def row_sum(cumulative: str, keys: list[str], n: int, last: int = 0) -> Column:
    """Sum over the ``n`` rows that end ``last`` rows before this one, from a column of running sums over ``rows(keys)``."""
    w = rows(keys)
    end = F.col(cumulative) if last == 0 else F.coalesce(F.lag(cumulative, last).over(w), F.lit(0.0))
    return end - F.coalesce(F.lag(cumulative, n + last).over(w), F.lit(0.0))


def running(keys: list[str]):
    """From a bucket's first row to this one."""
    return Window.partitionBy(*keys, "_bucket").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
