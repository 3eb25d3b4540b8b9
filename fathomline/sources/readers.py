"""Readers and catalogues of Parquet tables, and parsers of JSON payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline import schema
from fathomline.operators import book

#: Directories are named YYYY-MM-DD, with a suffix or without, or dt=YYYY-MM-DD as the writer does.
DATE = r"(?:^|/)(?:dt=)?(\d{4}-\d{2}-\d{2})[^/]*/[^/]*$"


def dated_folders(spark: SparkSession, root: str) -> dict[str, str]:
    """The dated directories right below ``root`` and their dates, by Hadoop's file system: one listing, no file is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().toString() for s in found if s.isDirectory())
    return {n: m[1] for n in names if (m := re.search(DATE, f"{n}/x"))}


def feature_table(spark: SparkSession, root: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The feature table below ``root``, its dated directories read together: schemas merged, unreadable files skipped.

    Directories outside the dates aren't listed or opened; filters on symbol and columns reach the scan. ``dt`` is the
    directory's date, null for files outside of dated ones. Timestamp and symbol are always kept. Rows come in no order;
    sort where they leave.
    """
    dated = dated_folders(spark, root) if start or end else {}
    wanted = [n for n, d in dated.items() if (not start or d >= start) and (not end or d <= end)]
    df = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(*(wanted or [root]))
    df = df.withColumn("dt", F.try_to_date(F.regexp_extract(F.col("_metadata.file_path"), DATE, 1)))
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if start:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    if columns:
        df = df.select(*dict.fromkeys(["timestamp_ns", "symbol", "dt", *columns]))
    return df


def trade_table(spark: SparkSession, path: str) -> DataFrame:
    """Trades with ``ts``; unsigned ids are read as decimals and cast back."""
    df = spark.read.parquet(path)
    return df.withColumn("tid", F.col("tid").cast("long")).withColumn("ts", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000)))


def candle_panel(spark: SparkSession, root: str, interval: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """``{SYMBOL}_{interval}.parquet`` files as one long panel; a repeated (symbol, timestamp) is kept once, dates are
    inclusive."""
    df = spark.read.schema(schema.CANDLES).parquet(f"{root}/*_{interval}.parquet")
    df = df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)_{interval}\.parquet", 1))
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if start:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("timestamp") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy("symbol", "timestamp").agg(F.min(row).alias("r")).select("r.*")


def listing(spark: SparkSession, path: str, ts: str | None = None) -> DataFrame:
    """A row for each file: rows, size, and the range of ``ts``."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if ts:
        aggs += [F.min(ts).alias("first"), F.max(ts).alias("last")]
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(*aggs)


def manifest(df: DataFrame, date: Column, symbol: str, file: Column) -> DataFrame:
    """For each date: files, rows, symbols."""
    return df.groupBy(date.alias("dt")).agg(F.countDistinct(file).alias("n_files"), F.count(F.lit(1)).alias("total_rows"), F.sort_array(F.collect_set(symbol)).alias("symbols"))


def messages(df: DataFrame, data: str = "data", channel: str = "channel") -> DataFrame:
    """``kind`` of each message by its channel: book, trades, context or unknown."""
    kind = F.when(F.col(channel) == "l2Book", "book").when(F.col(channel) == "trades", "trades").when(F.col(channel).isin("activeAssetCtx", "activeAssetData"), "context").otherwise("unknown")
    return df.withColumn("kind", kind).withColumn("payload", F.col(data))


def _levels(side: Column, most: int) -> Column:
    level = lambda x: F.struct(x.px.try_cast("double").alias("px"), x.sz.try_cast("double").alias("sz"), x.n.alias("n"))
    return F.slice(F.coalesce(F.filter(F.transform(side, level), lambda x: x.px.isNotNull()), F.array().cast(book.LEVEL)), 1, most).cast(book.LEVEL)


def parse_books(df: DataFrame, json: str = "payload", most_levels: int = 20) -> DataFrame:
    """Book messages (JSON with coin, time, levels) as symbol, time_ms, bids, asks; numbers arrive as strings, malformed
    ones are dropped."""
    p = F.from_json(json, schema.BOOK_MESSAGE)
    d = df.withColumn("_p", p)
    return d.select(
        *[F.col(c) for c in df.columns],
        F.col("_p.coin").alias("symbol"),
        F.col("_p.time").alias("time_ms"),
        _levels(F.get("_p.levels", F.lit(0)), most_levels).alias("bids"),
        _levels(F.get("_p.levels", F.lit(1)), most_levels).alias("asks"),
    )


def parse_trades(df: DataFrame, json: str = "payload") -> DataFrame:
    """Trade messages (JSON arrays) as a row for each trade."""
    t = df.withColumn("_t", F.explode(F.from_json(json, schema.TRADE_MESSAGE)))
    return t.select(F.col("_t.coin").alias("symbol"), F.col("_t.time").alias("time_ms"), F.col("_t.tid").alias("tid"), F.col("_t.px").try_cast("double").alias("price"), F.col("_t.sz").try_cast("double").alias("size"), (F.col("_t.side") == "B").alias("is_buy"))


def predictions(spark: SparkSession, path: str, ts: str = "timestamp") -> DataFrame:
    """Predictions with a time and a value; NaN left out."""
    return spark.read.parquet(path).where(F.col("prediction").isNotNull() & ~F.isnan("prediction")).where(F.col(ts).isNotNull())


def ledger_flow(kind: Column, usdc: Column, sender: Column, wallet: Column) -> Column:
    """Signed flow into a wallet's margin account; null for kinds that aren't known, so that they can't pass as zero."""
    return F.when(kind == "deposit", usdc).when(kind == "withdraw", -usdc).when(kind == "internalTransfer", F.when(sender == wallet, -usdc).otherwise(usdc)).when(kind.isin("spotGenesis", "rewardsClaim"), F.lit(0.0))
