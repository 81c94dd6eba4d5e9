"""Order-management metrics over live streams: event-time windows, late rows dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.oms import CANCELLED, FILLED, REJECTED, slippage_bps


def live_order_ratios(orders: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """``window_start, orders, fill_ratio, cancel_ratio, reject_ratio`` of each window of an order stream (or table)."""
    status = F.lower(F.col("status").cast("string"))
    own = orders.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"))
    names = {"fill_ratio": FILLED, "cancel_ratio": CANCELLED, "reject_ratio": REJECTED}
    sums = own.agg(F.count("*").alias("orders"), *(F.count_if(status.isin(*s)).alias(n) for n, s in names.items()))
    return sums.select(F.col("w.start").alias("window_start"), "orders", *((F.col(n) / F.col("orders")).alias(n) for n in names))


def live_slippage(fills: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """``window_start, venue, fills, avg_slippage_bps`` of each window and venue of a fill stream (or table)."""
    bps = slippage_bps(fills)
    own = fills.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "venue")
    return own.agg(F.count("*").alias("fills"), F.avg(bps).alias("avg_slippage_bps")).select(F.col("w.start").alias("window_start"), "venue", "fills", "avg_slippage_bps")
