"""Loading of bars, signals and records from anything that Spark reads, and bars from event streams."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.series import number

ORDERS = "ts timestamp_ntz, order_id string, symbol string, side string, quantity double, status string, venue string, limit_price double, created_ts timestamp_ntz, updated_ts timestamp_ntz"
FILLS = "ts timestamp_ntz, order_id string, symbol string, side string, quantity double, fill_price double, fee double, venue string, arrival_price double, latency_ms double"
POSITIONS = "ts timestamp_ntz, symbol string, quantity double, mark_price double, realized_pnl double, unrealized_pnl double"
TARGETS = "ts timestamp_ntz, symbol string, target_quantity double, target_weight double"
EQUITY = "ts timestamp_ntz, equity double, cash double, gross_exposure double, net_exposure double"


def read(spark: SparkSession, source: str, kind: str = "table", **options: str) -> DataFrame:
    """A catalog table, or a path or query of any Spark source (``parquet``, ``jdbc``, ...); filters on it are pushed down."""
    if kind == "table":
        return spark.table(source)
    if kind == "jdbc":
        return spark.read.format("jdbc").option("dbtable", source).options(**options).load()
    return spark.read.format(kind).options(**options).load(source)


def _first_per_time(df: DataFrame) -> DataFrame:
    """One row for each ``ts``: the least by its other columns, in their order."""
    rest = [c for c in df.columns if c != "ts"]
    return df.groupBy("ts").agg(F.min(F.struct(*rest)).alias("own")).select("ts", "own.*")


def load_signal(table: DataFrame, *, ts_col: str, value_col: str, start: object = None, end: object = None, where: Column | str | None = None) -> DataFrame:
    """``ts, signal_value``: numeric values in the closed time range, one for each time."""
    kind = table.schema[ts_col].dataType
    rows = table.where(F.col(value_col).isNotNull())
    if start is not None:
        rows = rows.where(F.col(ts_col) >= F.lit(str(start)).cast(kind))
    if end is not None:
        rows = rows.where(F.col(ts_col) <= F.lit(str(end)).cast(kind))
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col(ts_col).try_cast("timestamp").cast("timestamp_ntz").alias("ts"), number(value_col).alias("signal_value"))
    return _first_per_time(rows.dropna())


def load_ohlc(table: DataFrame, *, open_time_col: str = "open_time", close_time_col: str = "close_time", open_col: str = "open", high_col: str = "high", low_col: str = "low", close_col: str = "close", volume_col: str | None = None, start_ms: int | None = None, end_ms: int | None = None, where: Column | str | None = None) -> DataFrame:
    """``ts, close_ts, open, high, low, close[, volume]`` from times in milliseconds, in the closed range, one for each time."""
    rows = table
    if start_ms is not None:
        rows = rows.where(F.col(open_time_col) >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col(open_time_col) <= end_ms)
    if where is not None:
        rows = rows.where(where)
    times = {"ts": open_time_col, "close_ts": close_time_col}
    legs = {"open": open_col, "high": high_col, "low": low_col, "close": close_col} | ({"volume": volume_col} if volume_col else {})
    rows = rows.select(
        *(F.timestamp_millis(F.col(c).try_cast("bigint")).cast("timestamp_ntz").alias(n) for n, c in times.items()),
        *(number(c).alias(n) for n, c in legs.items()),
    )
    return _first_per_time(rows.dropna(subset=["ts", "open", "high", "low", "close"]))


def records(spark: SparkSession, rows: DataFrame | Iterable | None, schema: str) -> DataFrame:
    """A table of ``schema`` from nothing, a DataFrame, or dataclass instances, dicts or objects; missing fields are null."""
    if isinstance(rows, DataFrame):
        return rows
    names = [f.split(" ")[0] for f in schema.split(", ")]
    out = []
    for row in rows or ():
        own = row if isinstance(row, dict) else dataclasses.asdict(row) if dataclasses.is_dataclass(row) else vars(row)
        out.append(tuple(own.get(n) for n in names))
    return spark.createDataFrame(out, schema)


def bars_from_events(events: DataFrame, every: str = "hour", *, symbol: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """``symbol, ts, open, high, low, close, volume`` from single values; volume counts them."""
    at = F.struct(F.col(ts), F.col(tie))
    v = number(value)
    return events.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(every, F.col(ts)).cast("timestamp_ntz").alias("bar")).agg(
        F.min_by(v, at).alias("open"),
        F.max(v).alias("high"),
        F.min(v).alias("low"),
        F.max_by(v, at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    ).withColumnRenamed("bar", "ts")
