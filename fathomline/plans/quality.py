"""Queries of scans, catalogues and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline import schema
from fathomline.operators import quality
from fathomline.plans.adapters import CANDLES, TRADES, candles, read, rounded, trades
from fathomline.plans.catalogue import register
from fathomline.sources import readers, writers


@register(
    "quality_missing",
    """SELECT 'c_acctbal' AS "column", 0.0::DOUBLE AS missing, min(c_acctbal) = max(c_acctbal) AS constant, true AS ok FROM customer UNION ALL SELECT 'c_nationkey', 0.0, min(c_nationkey) = max(c_nationkey), true FROM customer""",
)
def quality_missing(spark, sf_dir):
    return quality.missing_shares(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@register(
    "quality_gaps",
    f"""WITH {TRADES}, g AS (SELECT symbol, tid, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts, tid)) / 1e6 AS gap_s FROM trades) SELECT symbol, tid, round(gap_s, 3) AS gap_s FROM g WHERE gap_s > 7200""",
)
def quality_gaps(spark, sf_dir):
    return rounded(quality.gaps(trades(spark, sf_dir), ["symbol"], "ts", "tid", 7200), 3)


@register(
    "quality_ranges",
    """SELECT 'l_discount' AS "column", count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) AS outside FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (NOT l_quantity BETWEEN 1 AND 40) FROM lineitem""",
)
def quality_ranges(spark, sf_dir):
    return quality.out_of_range(read(spark, sf_dir, "lineitem"), {"l_discount": (0.0, 0.05), "l_quantity": (1.0, 40.0)})


@register("quality_balance", f"WITH {TRADES}, n AS (SELECT symbol, count(*) AS n FROM trades GROUP BY 1) SELECT symbol, n, round(max(n) OVER () / n, 6) AS ratio, max(n) OVER () / n <= 3 AS ok FROM n")
def quality_balance(spark, sf_dir):
    return rounded(quality.balance(trades(spark, sf_dir), "symbol"))


@register("quality_rates", f"WITH {TRADES} SELECT symbol, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS rows_per_s FROM trades GROUP BY 1")
def quality_rates(spark, sf_dir):
    return rounded(quality.rates(trades(spark, sf_dir), "symbol", "ts"), 9)


@register(
    "quality_disorder",
    f"""WITH {TRADES}, d AS (SELECT symbol, wallet <= lag(wallet) OVER (PARTITION BY symbol ORDER BY ts, wallet) AS bad FROM trades) SELECT symbol, count(*) FILTER (bad) AS disordered FROM d GROUP BY 1""",
)
def quality_disorder(spark, sf_dir):
    return quality.disorder(trades(spark, sf_dir), ["symbol"], "ts", "wallet")


@register("quality_freshness", "SELECT round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3.6e9, 6) AS stale_hours, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3.6e9 <= 48 AS ok FROM events")
def quality_freshness(spark, sf_dir):
    return rounded(quality.freshness(read(spark, sf_dir, "events"), "ts", F.lit("2024-02-01 00:00:00").cast("timestamp"), 48))


@register("quality_usable_columns", """SELECT 'close' AS "column", 'ok' AS reason UNION ALL SELECT 'none', 'all_missing' UNION ALL SELECT 'one', 'constant'""")
def quality_usable_columns(spark, sf_dir):
    c = candles(spark, sf_dir).withColumn("none", F.lit(float("nan"))).withColumn("one", F.lit(1.0))
    return quality.usable_columns(c, ["close", "none", "one"], 10)


@register("scan_symbol_time_range", f"WITH {TRADES} SELECT tid, symbol, price FROM trades WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def scan_symbol_time_range(spark, sf_dir):
    t = trades(spark, sf_dir)
    return t.where(F.col("symbol").isin("click", "view") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("tid", "symbol", "price")


@register("catalog_manifest", f"WITH {TRADES} SELECT ts::DATE AS dt, 1::BIGINT AS n_files, count(*) AS total_rows, count(DISTINCT symbol) AS n_symbols FROM trades GROUP BY 1")
def catalog_manifest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("*", F.col("_metadata.file_path").alias("file"))
    out = readers.manifest(e, F.to_date("ts"), "event_type", F.col("file"))
    return out.select("dt", "n_files", "total_rows", F.size("symbols").cast("long").alias("n_symbols"))


@register("file_listing", "SELECT count(*) AS rows, min(event_id) AS first, max(event_id) AS last FROM events")
def file_listing(spark, sf_dir):
    return readers.listing(spark, f"{sf_dir}/events.parquet", "event_id").groupBy().agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


@register("json_payload", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_payload(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("schema_alignment", "SELECT c_custkey AS sequence_id, isnan('nan'::DOUBLE) AS padded FROM customer")
def schema_alignment(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sequence_id"))
    return schema.aligned(c, schema.features()).select("sequence_id", F.isnan("raw_midprice").alias("padded"))


@register(
    "upsert_latest",
    f"""WITH {CANDLES}, o AS (SELECT symbol, date, close FROM candles WHERE date < TIMESTAMP '2000-01-01'), n AS (SELECT symbol, date, close * 2 AS close FROM candles WHERE date >= TIMESTAMP '1999-12-01')
    SELECT symbol, date, round(close, 6) AS close FROM n UNION ALL SELECT symbol, date, round(close, 6) FROM o ANTI JOIN n USING (symbol, date)""",
)
def upsert_latest(spark, sf_dir):
    c = candles(spark, sf_dir).select("symbol", "date", "close")
    old = c.where(F.col("date") < F.lit("2000-01-01").cast("timestamp_ntz"))
    new = c.where(F.col("date") >= F.lit("1999-12-01").cast("timestamp_ntz")).withColumn("close", F.col("close") * 2)
    return rounded(writers.upsert(old, new, ["symbol", "date"]))
