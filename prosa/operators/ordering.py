"""Running sums, positions and ranks over whole tables without a single-task window.

The order is cut into cells by time, days and hours in it. Sums per cell come first, with map-side
combining; they are accumulated over the days and over the hours of a day, and the window over rows runs inside an hour.
Nothing is counted, sampled or collected beforehand, and a null time is a cell of its own.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def running_sum(df: DataFrame, value: Column, order: Sequence[str], alias: str, within: Sequence[str] = ()) -> DataFrame:
    """Running total of ``value`` over the whole table (or within groups) in ``order``.

    The first ordering column is a timestamp; nulls come first. A window over all days sees a row per day and group,
    one over a day its hours, the last one the rows of an hour.
    """
    keys = [F.col(name) for name in within]
    cells = df.withColumns({"_value": value, "_day": F.date_trunc("day", order[0]), "_hour": F.date_trunc("hour", order[0])})
    hours = cells.groupBy(*keys, "_day", "_hour").agg(F.sum("_value").alias("_sum"))
    days = hours.groupBy(*keys, "_day").agg(F.sum("_sum").alias("_sum"))
    to_here = (Window.unboundedPreceding, -1)
    days = days.withColumn("_days", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(*to_here)))
    hours = hours.withColumn("_hours", F.sum("_sum").over(Window.partitionBy(*keys, "_day").orderBy("_hour").rowsBetween(*to_here)))
    names = {name: f"_g_{name}" for name in (*within, "_day", "_hour")}
    days = days.select(*[F.col(n).alias(f"_d_{n}") for n in (*within, "_day")], "_days")
    met = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_d_{n}")) for n in (*within, "_day")])
    before = hours.join(days, met).select(
        *[F.col(n).alias(g) for n, g in names.items()],
        (F.coalesce("_days", F.lit(0)) + F.coalesce("_hours", F.lit(0))).alias("_before"))
    inside = Window.partitionBy(*keys, "_day", "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(g)) for n, g in names.items()])
    return (cells.withColumn("_inside", F.sum("_value").over(inside)).join(before, match)
            .withColumn(alias, F.col("_inside") + F.col("_before")).select(*df.columns, alias))


def position(df: DataFrame, order: Sequence[str], alias: str = "position") -> DataFrame:
    """1-based position of each row in the whole table."""
    return running_sum(df, F.lit(1).cast("long"), order, alias)


def rank_by(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Descending rank with gaps by a column of few distinct values (a percentage rounded to two
    places has at most 10,001): the window runs over the distinct values, not over the rows.

    The rows are used twice. Rank a stored table rather than a long plan.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_rows"))
    above = (Window.orderBy(F.col(value).desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(
        F.col(value).alias("_value"),
        (F.coalesce(F.sum("_rows").over(above), F.lit(0)) + 1).alias(alias),
    )
    return (df.join(ranks, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value"))


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key. The limit on the row number is applied before the shuffle too, so a key
    with very many versions sends one row per map task."""
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return (df.withColumn("_version", F.row_number().over(window))
            .where(F.col("_version") == 1).drop("_version"))
