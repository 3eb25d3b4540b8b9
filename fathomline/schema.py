"""Table schemas, built from one registry of feature blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.numeric import null_to_nan

SCHEMA_VERSION = 1

#: Blocks whose columns this library makes, by prefix: name -> columns.
BLOCKS: dict[str, tuple[str, ...]] = {
    "raw": ("raw_midprice", "raw_spread", "raw_spread_bps", "raw_microprice", "raw_bid_depth_5", "raw_ask_depth_5", "raw_bid_depth_10", "raw_ask_depth_10", "raw_bid_orders_5", "raw_ask_orders_5"),
    "imbalance": ("imbalance_qty_l1", "imbalance_qty_l5", "imbalance_qty_l10", "imbalance_orders_l5", "imbalance_notional_l5", "imbalance_depth_weighted", "imbalance_pressure_bid", "imbalance_pressure_ask"),
    "flow": ("flow_count_short", "flow_count_medium", "flow_count_long", "flow_volume_short", "flow_volume_medium", "flow_volume_long", "flow_aggressor_ratio_medium", "flow_aggressor_ratio_long", "flow_vwap", "flow_vwap_deviation", "flow_avg_trade_size", "flow_intensity"),
    "hawkes": ("hawkes_mu", "hawkes_excitation", "hawkes_branching"),
}
BASE = [T.StructField("timestamp_ns", T.LongType(), False), T.StructField("symbol", T.StringType(), False), T.StructField("sequence_id", T.LongType(), False)]

TRADES = T.StructType([BASE[0], BASE[1], T.StructField("tid", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("is_buy", T.BooleanType())])
CANDLES = T.StructType([T.StructField("timestamp", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
FUNDING = T.StructType([T.StructField("time", T.LongType()), T.StructField("funding_rate", T.DoubleType()), T.StructField("premium", T.DoubleType())])
_LEVEL = T.ArrayType(T.StructType([T.StructField("px", T.StringType()), T.StructField("sz", T.StringType()), T.StructField("n", T.IntegerType())]))
BOOK_MESSAGE = T.StructType([T.StructField("coin", T.StringType()), T.StructField("time", T.LongType()), T.StructField("levels", T.ArrayType(_LEVEL))])
TRADE_MESSAGE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("coin", "side", "px", "sz")] + [T.StructField("time", T.LongType()), T.StructField("tid", T.LongType())]))


def features(algorithms: tuple[str, ...] = ()) -> T.StructType:
    """The feature table: key columns, every block, and the columns of algorithms."""
    names = [c for block in BLOCKS.values() for c in block] + [f"alg_{a}" for a in algorithms]
    return T.StructType(BASE + [T.StructField(c, T.DoubleType(), False, {"schema_version": SCHEMA_VERSION}) for c in names])


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with every column of the schema: missing doubles as NaN, other missing ones as null; unknown columns are kept."""
    have = set(df.columns)
    missing = {f.name: (F.lit(float("nan")) if isinstance(f.dataType, T.DoubleType) else F.lit(None)).cast(f.dataType) for f in schema if f.name not in have}
    return df.withColumns(missing).select([f.name for f in schema] + [c for c in df.columns if c not in {f.name for f in schema}])


def validate_columns(columns: list[str], schema: T.StructType, optional: set[str] = frozenset()) -> dict[str, list[str]]:
    """Missing base, missing optional and unexpected columns."""
    want, have = {f.name for f in schema}, set(columns)
    return {"missing_base": sorted(want - have - optional), "missing_optional": sorted((want & optional) - have), "unexpected": sorted(have - want)}


def egress(df: DataFrame) -> DataFrame:
    """Nulls of doubles as NaN, as the table format has them."""
    return df.select([null_to_nan(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def block_of(column: str) -> str:
    return next((name for name, cols in BLOCKS.items() if column in cols), "other")
