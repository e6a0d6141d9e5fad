"""Running aggregates and neighbours over keys that may hold most of the rows.

A window by such a key alone would sort all its rows in one task.  Here a key's rows are cut into ranges that follow its
order: each range is swept by itself, the ranges' totals, a row for each, are swept once more, and what lies before a
range is added to its rows.  Rows and totals meet by key and range, as which the rows are dealt already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampNTZType, TimestampType

_JOINED = {"sum": lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)), "min": F.least, "max": F.greatest, "last": lambda own, before: F.coalesce(own, before)}
_TAKEN = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True)}
_LOW = -(2**62)


def ranges_of(df: DataFrame, column: str) -> Column:
    """Ranges that follow a column: days of a time, thousands of a number; of a struct its first field; else one range."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, StructType):
        c, kind = c[kind.fields[0].name], kind.fields[0].dataType
    if isinstance(kind, TimestampType | TimestampNTZType | DateType):
        return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    return F.floor(c / 4096) if isinstance(kind, NumericType) else F.lit(0)


def running(df: DataFrame, keys: list[str], ranges: Column, order: list[Column], wanted: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """df with a column for each of wanted: the sum, min, max or last known value of all rows up to this one, or before it.

    ranges: a whole number that never falls along order within a key; null counts as least.  wanted: name, then one of
    sum, min, max, last and the value.  Rows with a null key are left out.  An empty sum is 0.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = df.where(known).withColumns({"_range": F.coalesce(ranges.cast("long"), F.lit(_LOW)), **{f"_v_{n}": v for n, (_, v) in wanted.items()}})
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    span = within.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_o_{n}": _TAKEN[how](f"_v_{n}").over(span) for n, (how, _) in wanted.items()})
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumns({f"_t_{n}": F.last(f"_v_{n}", True).over(whole) for n, (how, _) in wanted.items() if how == "last"})
    totals = own.groupBy(*keys, "_range").agg(*[(F.first(f"_t_{n}") if how == "last" else _TAKEN[how](f"_v_{n}")).alias(f"_t_{n}") for n, (how, _) in wanted.items()])
    offsets = totals.select(*keys, "_range", *[_TAKEN[how](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (how, _) in wanted.items()])
    out = own.join(offsets, [*keys, "_range"]).withColumns({n: _JOINED[how](F.col(f"_o_{n}"), F.col(f"_b_{n}")) for n, (how, _) in wanted.items()})
    return out.select(*df.columns, *wanted)
