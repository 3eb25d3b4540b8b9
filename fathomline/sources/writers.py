"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline import schema


def write_features(df: DataFrame, root: str, algorithms: tuple[str, ...] = (), rows_per_file: int = 1_000_000, mode: str = "append") -> None:
    """The feature table by date, zstd, every column of the schema present, NaN for missing values. Files appear when the
    write commits."""
    out = schema.egress(schema.aligned(df, schema.features(algorithms)))
    out = out.withColumn("dt", F.to_date(F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000))))
    out.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("dt").parquet(root)


def write_trades(df: DataFrame, root: str, mode: str = "append") -> None:
    out = df.select([F.col(f.name).cast(f.dataType) for f in schema.TRADES])
    out.withColumn("dt", F.to_date(F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000)))).write.mode(mode).option("compression", "zstd").partitionBy("dt").parquet(root)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the new one."""
    a = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[F.col(c) for c in a.columns if c != "_new"])
    return a.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, "_new").alias("r")).select("r.*")


def save_predictions(df: DataFrame, path: str, model: str, ts: str = "timestamp") -> None:
    df.select(ts, "prediction").where(F.col("prediction").isNotNull()).withColumn("model_name", F.lit(model)).write.mode("overwrite").parquet(path)


def save_findings(df: DataFrame, path: str) -> None:
    """Results as JSON lines, nested columns as they are."""
    df.write.mode("overwrite").json(path)
