"""SQL tables read in ranges, with filters in the SQL, on SQLite."""

from __future__ import annotations

import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, In, LessThan, StringContains

from quantloom.sources.market import load_ohlc, load_signal
from quantloom.sources.sql import Range, SqlReader, cuts_of, read_sql

START = datetime(2024, 1, 1)
SIGNAL, OHLC = "ts timestamp_ntz, v double, name string", "open_time bigint, close_time bigint, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sql") / "market.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE signals (ts TEXT, v REAL, "name" TEXT)')
        rows = [((START + timedelta(hours=k)).isoformat(" "), None if k % 17 == 0 else k / 4, "ab"[k % 2]) for k in range(500)]
        db.executemany("INSERT INTO signals VALUES (?, ?, ?)", [*rows, rows[3], (None, 1.0, "a"), ("never", 2.0, "a")])
        db.execute("CREATE TABLE bars (open_time INTEGER, close_time INTEGER, open REAL, high REAL, low REAL, close REAL, volume REAL)")
        db.executemany("INSERT INTO bars VALUES (?, ?, ?, ?, ?, ?, ?)", [(k * 60_000, k * 60_000 + 59_999, k, k + 1, k - 1, k, None if k % 5 else k) for k in range(1000)])
    return path


def table(spark, database, name, schema, **more):
    return read_sql(spark, connector="sqlite3:connect", target=database, table=name, schema=schema, **more)


def test_a_table_is_read_by_several_tasks(spark, database):
    bars = table(spark, database, "bars", OHLC, partition_column="open_time", partitions=6)
    sizes = [r["count"] for r in bars.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 1000 and max(sizes) < 200
    whole = table(spark, database, "bars", OHLC)
    assert sorted(bars.collect(), key=str) == sorted(whole.collect(), key=str)


def test_loaders_send_their_bounds(spark, database):
    bars = table(spark, database, "bars", OHLC, partition_column="open_time", partitions=4)
    out = load_ohlc(bars, volume_col="volume", start_ms=120_000, end_ms=600_000)
    assert [r["close"] for r in out.orderBy("ts").collect()] == [float(k) for k in range(2, 11)]
    signals = table(spark, database, "signals", SIGNAL, where="name = 'a'", partition_column="ts", partitions=4)
    out = load_signal(signals, ts_col="ts", value_col="v", start="2024-01-03 00:00:00", end="2024-01-05 00:00:00").orderBy("ts").collect()
    want = [k for k in range(48, 97, 2) if k % 17]
    assert [(r["ts"], r["signal_value"]) for r in out] == [(START + timedelta(hours=k), k / 4) for k in want]


def test_filters_are_in_the_sql(spark, database):
    reader = SqlReader(None, {"table": "main.bars", "connector": "sqlite3:connect", "target": database, "partition_column": "open_time", "partitions": "3", "where": "close > 0"})
    asked = [GreaterThanOrEqual(("open_time",), 60_000), LessThan(("open_time",), 30 * 60_000), In(("close",), (1.0, 2.0)), StringContains(("close",), "1"), GreaterThan(("name",), "a")]
    assert list(reader.pushFilters(asked)) == asked  # Spark tests them again
    sql, values = reader.select("*", ("x < ?", (5,)))
    assert sql == 'SELECT * FROM "main"."bars" WHERE (close > 0) AND "open_time" >= ? AND "open_time" < ? AND "close" IN (?, ?) AND x < ?'
    assert values == (60_000, 30 * 60_000, 1.0, 2.0, 5)
    # the range that is cut is that of the rows left: 1 and 2 minutes
    assert reader.partitions() == [Range('("open_time" < ? OR "open_time" IS NULL)', (80_000,)), Range('"open_time" >= ? AND "open_time" < ?', (80_000, 100_000)), Range('"open_time" >= ?', (100_000,))]
    plan = table(spark, database, "bars", OHLC).where("open_time >= 60000 AND close_time < 200000 AND high > 1.5")
    assert [r["open_time"] for r in plan.orderBy("open_time").collect()] == [60_000, 120_000]


def test_odd_tables(spark, database):
    every = table(spark, database, "signals", SIGNAL, partition_column="v", partitions=5)
    assert every.count() == 503 and every.where("ts IS NULL").count() == 2 and every.where("v IS NULL").count() == 30
    assert every.where("name = 'nobody'").count() == 0
    with pytest.raises(ValueError, match="module:function"):
        read_sql(spark, connector="os; x", target="", table="t", schema="a int")


def test_cuts():
    assert cuts_of(0, 10, 4) == [2, 5, 7] and cuts_of(1, 2, 8) == [] and cuts_of(3, 3, 4) == [] and cuts_of(None, None, 4) == []
    assert cuts_of(0.0, 1.0, 2) == [0.5] and cuts_of("2024-01-01 00:00:00", "2024-01-03 00:00:00", 2) == ["2024-01-02 00:00:00"]
