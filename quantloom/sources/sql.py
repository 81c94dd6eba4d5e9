"""A SQL table read by many tasks through any Python DB-API driver, with filters in the SQL.

``read_sql`` cuts the range of one column into partitions; each task opens its own connection and fetches
its own range in batches. Comparisons of a column with a number or a time, equality with any plain value, and
"is not null" are sent along, values as parameters, and Spark tests them again, so a database that compares
otherwise can only send too many rows. Times are to be stored as ``YYYY-MM-DD HH:MM:SS[.ffffff]`` or in a
column type that compares with such text.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "quantloom_sql"
#: Rows that a task holds at a time.
FETCH = 10_000
_ORDERED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Range(InputPartition):
    """Rows of one partition: a condition and its parameters."""

    condition: str
    values: tuple


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def plain(value: object) -> object:
    """A parameter as databases take it."""
    if isinstance(value, datetime):
        return value.isoformat(" ")
    return value.isoformat() if isinstance(value, date) else value


class SqlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> SqlReader:
        return SqlReader(schema, dict(self.options))


class SqlReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options
        self.pushed: list[tuple[str, tuple]] = [(f"({options['where']})", ())] if options.get("where") else []
        self.mark = options.get("mark", "?")

    def connect(self):
        module, _, function = self.options["connector"].partition(":")
        return getattr(importlib.import_module(module), function or "connect")(self.options["target"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for own in filters:
            path = getattr(own, "attribute", ())
            column = quoted(path[0]) if len(path) == 1 else None
            value = getattr(own, "value", None)
            if column is not None:
                if type(own) in _ORDERED and isinstance(value, (int, float, datetime, date)):
                    self.pushed.append((f"{column} {_ORDERED[type(own)]} {self.mark}", (plain(value),)))
                elif isinstance(own, EqualTo) and isinstance(value, (int, float, str, datetime, date)):
                    self.pushed.append((f"{column} = {self.mark}", (plain(value),)))
                elif isinstance(own, In) and 0 < len(own.value) <= 500 and all(isinstance(v, (int, float, str)) for v in own.value):
                    self.pushed.append((f"{column} IN ({', '.join([self.mark] * len(own.value))})", tuple(own.value)))
                elif isinstance(own, IsNotNull):  # not its opposite: what can't be read is null in Spark alone
                    self.pushed.append((f"{column} IS NOT NULL", ()))
            yield own

    def select(self, columns: str, *more: tuple[str, tuple]) -> tuple[str, tuple]:
        """SQL of the table with all conditions, and its parameters."""
        parts = [p for p in (*self.pushed, *more) if p[0]]
        where = " WHERE " + " AND ".join(c for c, _ in parts) if parts else ""
        table = ".".join(map(quoted, self.options["table"].split(".")))
        return f"SELECT {columns} FROM {table}{where}", tuple(v for _, own in parts for v in own)

    def partitions(self) -> Sequence[InputPartition]:
        """Equal parts of the column's range, as it is under the conditions; nulls go with the first."""
        column, n = self.options.get("partition_column"), int(self.options.get("partitions", "1"))
        if not column or n <= 1:
            return [Range("", ())]
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(*self.select(f"MIN({quoted(column)}), MAX({quoted(column)})"))
            low, high = cursor.fetchone()
        finally:
            connection.close()
        cuts = cuts_of(low, high, n)
        if not cuts:
            return [Range("", ())]
        name, mark = quoted(column), self.mark
        first = Range(f"({name} < {mark} OR {name} IS NULL)", (cuts[0],))
        inner = [Range(f"{name} >= {mark} AND {name} < {mark}", own) for own in zip(cuts, cuts[1:])]
        return [first, *inner, Range(f"{name} >= {mark}", (cuts[-1],))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        columns = ", ".join(quoted(f.name) for f in self.schema)
        arrow = to_arrow_schema(self.schema)
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(*self.select(columns, (partition.condition, partition.values)))
            while rows := cursor.fetchmany(FETCH):
                arrays = [pa.array([_read(v, f.type) for v in own], f.type) for own, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            connection.close()


def cuts_of(low: object, high: object, n: int) -> list:
    """Bounds of ``n`` equal parts between numbers, or between times, which may be text; none where there is nothing to cut."""
    if low is None or low == high:
        return []
    if isinstance(low, (str, datetime, date)):
        a, b = (x if isinstance(x, datetime) else datetime.fromisoformat(str(x)) for x in (low, high))
        cuts = [a + (b - a) * k / n for k in range(1, n)]
        seconds = {c - timedelta(microseconds=c.microsecond) for c in cuts}  # whole seconds, as most times are stored
        return [plain(c) for c in sorted(c for c in seconds if a < c <= b)]
    cuts = {low + (high - low) * k // n if isinstance(low, int) else low + (high - low) * k / n for k in range(1, n)}
    return sorted(c for c in cuts if low < c <= high)


def _read(value: object, kind: pa.DataType) -> object:
    """A fetched value as its Arrow type; what can't be read is null."""
    if value is None:
        return None
    try:
        if pa.types.is_timestamp(kind):
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
        if pa.types.is_floating(kind):
            return float(value)
        if pa.types.is_integer(kind):
            return int(value)
    except ValueError:
        return None
    return str(value) if pa.types.is_string(kind) else value


def read_sql(spark: SparkSession, *, connector: str, target: str, table: str, schema: str, partition_column: str | None = None, partitions: int = 8, where: str | None = None, mark: str = "?") -> DataFrame:
    """A lazy table of ``schema`` (names and types of the columns wanted) from ``table``.

    ``connector`` names a DB-API function, ``module:function``, that takes ``target``; ``mark`` is its sign
    of a parameter. ``where`` is SQL that is always sent along. Filters later set on the table go into the
    SQL; for these the session's setting for Python data sources is turned on.
    """
    if not re.fullmatch(r"[\w.]+(:[\w.]+)?", connector):
        raise ValueError(f"connector must be module:function, not {connector!r}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqlSource)
    options = {"connector": connector, "target": target, "table": table, "partitions": str(partitions), "mark": mark}
    options |= {k: v for k, v in (("partition_column", partition_column), ("where", where)) if v}
    return spark.read.format(NAME).schema(schema).options(**options).load()
