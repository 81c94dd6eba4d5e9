"""Results as JSON payloads, one row a strategy, and as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def iso(ts: Column) -> Column:
    """A time as ``yyyy-MM-ddTHH:mm:ss`` without zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def shown(df: DataFrame) -> DataFrame:
    """``df`` with its times as ISO text."""
    return df.withColumns({f.name: iso(F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("timestamp", "timestamp_ntz")})


def payload(metrics: DataFrame, curve: DataFrame, trades: DataFrame, keys: Sequence[str] = ("symbol", "strategy_id"), ts: str = "ts") -> DataFrame:
    """``keys, payload``: JSON of a strategy's metrics, bars and trades, for curves already down-sampled and trades already limited."""
    keys = list(keys)
    points = shown(curve).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ts, *(c for c in curve.columns if c not in (*keys, ts))))).alias("bars"))
    deals = shown(trades).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(c for c in trades.columns if c not in keys)))).alias("trades"))
    own = shown(metrics).select(*keys, F.struct(*(c for c in metrics.columns if c not in keys)).alias("metrics"))
    both = own.join(points, keys, "left").join(deals, keys, "left")
    return both.select(*keys, F.to_json(F.struct(*keys, "metrics", "bars", "trades"), {"ignoreNullFields": "false"}).alias("payload"))


def research_report(table: DataFrame, keys: Sequence[str] = ("symbol", "strategy_id")) -> DataFrame:
    """``keys, report``: JSON of a row of metrics, without bars."""
    return table.select(*keys, F.to_json(F.struct(*shown(table).columns), {"ignoreNullFields": "false"}).alias("report"))


def write(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    """Writes a result table, in folders by the given columns."""
    out = df.write.format(kind).mode("errorifexists")
    (out.partitionBy(*by) if by else out).save(path)
