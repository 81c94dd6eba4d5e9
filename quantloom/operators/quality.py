"""Data-quality checks of price bars and signals: one aggregation, one row for each issue found.

With ``by``, the keys of a series, each series is checked apart and its issues carry its keys. Issue codes
and severities are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.series import number
from .align import micros, time_of

ISSUE = "code string, severity string, count bigint, message string"


def _issues(df: DataFrame, checks: list[tuple[str, str, str, Column]], extra: list[DataFrame] = (), by: Sequence[str] = ()) -> DataFrame:
    """Rows of checks whose count isn't zero; all plain checks are one pass."""
    sums = df.groupBy(*by).agg(*(F.coalesce(c, F.lit(0)).cast("bigint").alias(f"c{k}") for k, (*_, c) in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(f"c{k}").alias("count"), F.lit(text).alias("message")) for k, (code, severity, text, _) in enumerate(checks)))
    out = sums.select(*by, F.inline(rows))
    for more in extra:
        out = out.unionByName(more)
    return out.where("count > 0")


def _one(spark, code: str, text: str, count: int = 1) -> DataFrame:
    return spark.createDataFrame([(code, "error", count, text)], ISSUE)


def _repeats(df: DataFrame, t: Column, code: str, severity: str, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each time, rows without time among them."""
    per = df.groupBy(*by, t.alias("__t")).agg((F.count("*") - 1).alias("__n"))
    return per.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("count")).select(*by, F.lit(code).alias("code"), F.lit(severity).alias("severity"), "count", F.lit(text).alias("message"))


def _missing(df: DataFrame, t: Column, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Steps between the first and the last time at which no row stands."""
    by = list(by)
    times = df.select(*by, t.alias("__t")).where("__t IS NOT NULL")
    ends = times.groupBy(*by).agg(F.min("__t").alias("__a"), F.max("__t").alias("__b"), F.count("*").alias("__n")).where("__n > 1")
    both = times.join(ends, by) if by else times.crossJoin(F.broadcast(ends))  # without keys, ends is one row
    on_step = both.where(((F.col("__t") - F.col("__a")) % step) == 0)
    have = on_step.groupBy(*by).agg(F.countDistinct("__t").alias("__have"), F.first("__a").alias("__a"), F.first("__b").alias("__b")).where("__have > 0")
    count = F.floor((F.col("__b") - F.col("__a")) / step) + 1 - F.col("__have")
    return have.select(*by, F.lit("missing_bars").alias("code"), F.lit("warning").alias("severity"), count.cast("bigint").alias("count"), F.lit("the expected spacing implies bars that are missing").alias("message"))


def validate_ohlc(df: DataFrame, *, ts_col: str = "ts", open_col: str = "open", high_col: str = "high", low_col: str = "low", close_col: str = "close", volume_col: str = "volume", sequence_col: str | None = None, expected_freq: str | None = None, allow_empty: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``code, severity, count, message`` for each issue of a bar table, behind the keys ``by``; no rows if it is fine.

    Arrival order is that of ``sequence_col``; without one it isn't checked, since rows of a DataFrame have none.
    """
    spark = df.sparkSession
    missing = [c for c in (ts_col, open_col, high_col, low_col, close_col) if c not in df.columns]
    if df.isEmpty() and not allow_empty:
        return _one(spark, "empty_ohlc", "there are no bars")
    if missing:
        return _one(spark, "missing_ohlc_columns", f"columns are missing: {missing}", len(missing))
    t = time_of(ts_col)
    o, h, low, c = (number(x) for x in (open_col, high_col, low_col, close_col))
    checks = [("invalid_timestamp", "error", "times that can't be read", F.count_if(t.isNull()))]
    checks += [("non_numeric_ohlc", "error", f"{name} holds what isn't a number", F.count_if(x.isNull())) for name, x in ((open_col, o), (high_col, h), (low_col, low), (close_col, c))]
    checks += [
        ("non_positive_close", "error", "close must be above zero", F.count_if(c <= 0)),
        ("high_below_open_or_close", "error", "high must not be below open or close", F.count_if(h < F.greatest(o, c))),
        ("low_above_open_or_close", "error", "low must not be above open or close", F.count_if(low > F.least(o, c))),
    ]
    if volume_col in df.columns:
        v = number(volume_col)
        checks.append(("invalid_volume", "error", "volume must be a number from zero", F.count_if(v.isNull() | (v < 0))))
    extra = [_repeats(df, t, "duplicate_timestamps", "error", "times occur more than once", by)]
    if sequence_col:
        extra.append(_out_of_order(df, t, sequence_col, by))
    if expected_freq is not None:
        extra.append(_missing(df, t, micros(expected_freq), by))
    return _issues(df, checks, extra, by)


def _out_of_order(df: DataFrame, t: Column, sequence_col: str, by: Sequence[str] = ()) -> DataFrame:
    """One issue if times fall, or are missing, in the order of ``sequence_col``.

    Ranges of the sequence are checked apart, then their ends against each other.
    """
    dealt = df.select(*by, F.col(sequence_col).alias("__s"), t.alias("__t")).repartitionByRange(*by, "__s").withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy(*by, "__p").orderBy("__s")
    inside = dealt.withColumn("__bad", F.col("__t").isNull() | (F.col("__t") < F.lag("__t").over(w)))
    parts = inside.groupBy(*by, "__p").agg(F.max(F.coalesce("__bad", F.lit(False))).alias("__bad"), F.min("__t").alias("__low"), F.max("__t").alias("__high"))
    across = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bad = F.col("__bad") | F.coalesce(F.col("__low") < F.max("__high").over(across), F.lit(False))
    found = parts.select(*by, bad.alias("__bad")).groupBy(*by).agg(F.max(F.col("__bad").cast("bigint")).alias("count"))
    return found.select(*by, F.lit("timestamp_not_monotonic").alias("code"), F.lit("error").alias("severity"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.lit("times must not fall").alias("message"))


def validate_signal(df: DataFrame, *, ts_col: str = "ts", signal_col: str = "signal", event_ts_col: str | None = None, available_ts_col: str | None = None, duplicate_policy: str = "error", nan_policy: str = "warn", inf_policy: str = "error", stale_after: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Issues of a signal table. A policy is ``error``, ``warn``, or anything else to ignore."""
    spark = df.sparkSession
    if df.isEmpty():
        return _one(spark, "empty_signal", "there are no signals")
    missing = [c for c in (ts_col, signal_col) if c not in df.columns]
    if missing:
        return _one(spark, "missing_signal_columns", f"columns are missing: {missing}", len(missing))
    severity = {"error": "error", "warn": "warning"}
    t, x = time_of(ts_col), number(signal_col)
    checks = [("invalid_signal_timestamp", "error", "times that can't be read", F.count_if(t.isNull()))]
    if nan_policy in severity:
        checks.append(("nan_signal", severity[nan_policy], "the signal holds what isn't a number", F.count_if(x.isNull())))
    if inf_policy in severity:
        checks.append(("inf_signal", severity[inf_policy], "the signal holds infinities", F.count_if(F.abs(x) == float("inf"))))
    event = time_of(event_ts_col) if event_ts_col in df.columns else None
    available = time_of(available_ts_col) if available_ts_col in df.columns else None
    if event is not None:
        checks.append(("invalid_event_ts", "error", "event times that can't be read", F.count_if(event.isNull())))
    if available is not None:
        checks.append(("invalid_available_ts", "error", "availability times that can't be read", F.count_if(available.isNull())))
    if event is not None and available is not None:
        checks.append(("available_before_event_ts", "warning", "signals were available before their event", F.count_if(available < event)))
    if stale_after is not None and available is not None:
        checks.append(("stale_signal", "warning", "signals are older than allowed", F.count_if(t - available > micros(stale_after))))
    extra = [_repeats(df, t, "duplicate_signal_timestamps", severity[duplicate_policy], "times occur more than once", by)] if duplicate_policy in severity else []
    return _issues(df, checks, extra, by)


def raise_if_errors(report: DataFrame) -> None:
    """Raises ``ValueError`` with all errors of a report; a report has a few rows."""
    found: Sequence = report.where("severity = 'error'").orderBy("code").limit(100).collect()
    if found:
        raise ValueError("; ".join(f"{r['code']}: {r['message']}" for r in found))
