"""Structured Streaming counterparts of the tape, bar and alert operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.operators import algorithms as alg


def bars(trades: DataFrame, width: str, late: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV bars of event time; a bar is final when the watermark passes it, later trades are left out."""
    w = F.window("ts", width)
    return (
        trades.withWatermark("ts", late)
        .groupBy(w.alias("w"), *keys)
        .agg(F.min_by("price", "tid").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tid").alias("close"), F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"))
        .select(F.col("w.start").alias("bar_start"), *keys, "open", "high", "low", "close", "volume", "vwap")
    )


def sliding_flow(trades: DataFrame, width: str, slide: str, late: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Count, volume and aggressor ratio over sliding windows."""
    w = F.window("ts", width, slide)
    buy = F.coalesce(F.sum(F.when(F.col("is_buy"), F.col("size"))), F.lit(0.0))
    return trades.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), (buy / F.sum("size")).alias("aggressor_ratio")).select(F.col("w.end").alias("at"), *keys, "n", "volume", "aggressor_ratio")


def deduplicated(trades: DataFrame, late: str, keys: tuple[str, ...] = ("symbol", "tid")) -> DataFrame:
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def cooled(alerts: DataFrame, seconds: int, late: str) -> DataFrame:
    """Alerts (symbol, alert, ts) that fire, ``seconds`` apart at least for a symbol and kind; the last firing is the state."""

    def one(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        for pdf in pdfs:
            keep = []
            for t in pdf.sort_values("ts")["ts"]:
                if last is None or (t - last).total_seconds() >= seconds:
                    keep.append(t)
                    last = t
            if keep:
                yield pd.DataFrame({"symbol": key[0], "alert": key[1], "ts": keep})
        if last is not None:
            state.update((int(last.value // 1000),))

    return alerts.withWatermark("ts", late).groupBy("symbol", "alert").applyInPandasWithState(one, "symbol string, alert string, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def algorithm(ticks: DataFrame, make: alg.Algorithm, late: str) -> DataFrame:
    """A signal algorithm over a stream of (symbol, ts, needed columns): what it keeps between ticks is pickled as the
    key's state, so a stream gives what a batch gives if ticks come in order."""
    names = [f"alg_{make.name}_{m}" for m in make.makes]
    needs = list(make.needs)

    def one(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        a = pickle.loads(state.get[0]) if state.exists else pickle.loads(pickle.dumps(make))
        for pdf in pdfs:
            pdf = pdf.sort_values("ts", kind="stable")
            out = [list(a.step(dict(zip(needs, row))).values()) for row in pdf[needs].to_numpy(float)]
            yield pd.concat([pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].to_numpy()}), pd.DataFrame(out, columns=names)], axis=1)
        state.update((bytearray(pickle.dumps(a)),))

    return ticks.withWatermark("ts", late).select("symbol", "ts", *needs).groupBy("symbol").applyInPandasWithState(one, "symbol string, ts timestamp, " + ", ".join(f"{n} double" for n in names), "state binary", "append", GroupStateTimeout.NoTimeout)


def latest_sink(stream: DataFrame, path: str, keys: list[str], ts: str, checkpoint: str):
    """Keeps the newest row of each key as a table at ``path``/<batch>, merged batch by batch; returns the query."""
    from fathomline.operators.alerts import latest

    def put(df: DataFrame, batch: int) -> None:
        new = latest(df, keys, ts, ts)
        if batch:
            old = df.sparkSession.read.parquet(f"{path}/batch={batch - 1}")
            new = latest(old.unionByName(new), keys, ts, ts)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
