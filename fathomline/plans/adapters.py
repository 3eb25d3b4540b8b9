"""Market tables from the star-schema tables, and the same as SQL, so that each query has both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import book


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a tape: tid, ts, symbol, wallet, price, size, is_buy."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("tid"),
        "ts",
        F.col("event_type").alias("symbol"),
        F.col("user_id").alias("wallet"),
        (F.col("value") + 100).alias("price"),
        (1 + F.col("user_id") % 10).cast("double").alias("size"),
        (F.col("event_id") % 3 == 0).alias("is_buy"),
    )


TRADES = """trades AS (
    SELECT event_id AS tid, ts, event_type AS symbol, user_id AS wallet, value + 100 AS price,
           (1 + user_id % 10)::DOUBLE AS size, event_id % 3 = 0 AS is_buy
    FROM events)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as books, one an order: bids and asks around 1000, a level for each quantity and line."""
    line = read(spark, sf_dir, "lineitem")
    line = line.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("side"), "l_quantity").agg(
        F.round(F.sum("l_extendedprice") / 1000, 6).alias("sz"), F.count(F.lit(1)).cast("int").alias("n")
    )
    step = F.col("l_quantity") * 0.5
    level = F.struct(F.when(F.col("side") == 0, 1000 - step).otherwise(1000.25 + step).alias("px"), "sz", "n")
    both = line.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("side") == 0, level)).alias("b"), F.collect_list(F.when(F.col("side") == 1, level)).alias("a"))
    return both.select(
        F.col("l_orderkey").alias("book_id"),
        F.array_sort("b", lambda x, y: F.signum(y.px - x.px).cast("int")).cast(book.LEVEL).alias("bids"),
        F.array_sort("a", lambda x, y: F.signum(x.px - y.px).cast("int")).cast(book.LEVEL).alias("asks"),
    )


#: levels: a row for each level with its rank from the best price.
BOOKS = """lv AS (
    SELECT l_orderkey AS book_id, l_linenumber % 2 AS side, l_quantity, round(sum(l_extendedprice) / 1000, 6) AS sz, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3),
levels AS (
    SELECT book_id, side, CASE WHEN side = 0 THEN 1000 - l_quantity * 0.5::DOUBLE ELSE 1000.25::DOUBLE + l_quantity * 0.5::DOUBLE END AS px, sz, n,
           row_number() OVER (PARTITION BY book_id, side ORDER BY l_quantity) AS k
    FROM lv),
tops AS (
    SELECT book_id, max(px) FILTER (side = 0) AS bb, min(px) FILTER (side = 1) AS ba,
           coalesce(sum(sz) FILTER (side = 0 AND k = 1), 0) AS bs1, coalesce(sum(sz) FILTER (side = 1 AND k = 1), 0) AS as1
    FROM levels GROUP BY 1)"""


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a daily panel: symbol, date, close (mean price), high, low, volume."""
    line = read(spark, sf_dir, "lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    return line.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("date")).agg(
        F.round(F.avg("px"), 6).alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").alias("volume")
    )


CANDLES = """candles AS (
    SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS date, round(avg(l_extendedprice / l_quantity), 6) AS close,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume
    FROM lineitem GROUP BY 1, 2)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as open positions: wallet, nation, segment, value_usd (absolute balance), is_long, liquidation_price."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("wallet"),
        F.col("c_nationkey").alias("grp"),
        F.col("c_mktsegment").alias("segment"),
        F.abs("c_acctbal").alias("value_usd"),
        (F.col("c_custkey") % 2 == 0).alias("is_long"),
        (100 + (F.col("c_custkey") % 41 - 20) * 0.6).alias("liquidation_price"),
    )


POSITIONS = """positions AS (
    SELECT c_custkey AS wallet, c_nationkey AS grp, c_mktsegment AS segment, abs(c_acctbal) AS value_usd, c_custkey % 2 = 0 AS is_long,
           100 + (c_custkey % 41 - 20) * 0.6::DOUBLE AS liquidation_price
    FROM customer)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare alike."""
    return df.select([F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
