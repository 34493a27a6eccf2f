"""Running sums and numbers over a whole table in an order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import cut

RANGE = "__range"


def running(df: DataFrame, order: Sequence[Column | str], number: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """df with its rows' numbers from 0 in an order, and with running sums (new column: summed column), own row included.

    The rows are put in ranges of that order and kept there. A row for each range, of which there are as
    many as shuffle partitions, tells what comes before the next ones; in a range a window does the rest. Rows
    that are equal in the order are numbered in any order. Nulls add nothing to a sum, as in a window.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()))
    totals = ranged.groupBy(RANGE).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(sums.values())))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(RANGE), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{RANGE}_n"), *(F.sum(f"s{i}").over(before).alias(f"{RANGE}_s{i}") for i in range(len(sums))))
    inside = Window.partitionBy(RANGE).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(cut(starts)), RANGE)
    added = {name: total(F.sum(c).over(upto), F.col(f"{RANGE}_s{i}")) for i, (name, c) in enumerate(sums.items())}
    if number is not None:
        added[number] = F.row_number().over(inside) - 1 + F.col(f"{RANGE}_n")
    return out.withColumns(added).drop(RANGE, f"{RANGE}_n", *(f"{RANGE}_s{i}" for i in range(len(sums))))


def total(own: Column, before: Column) -> Column:
    return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)
