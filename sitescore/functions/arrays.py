"""Column expressions on square blocks stored as row-major arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_size(block: Column) -> Column:
    """nt of a block of nt * nt values."""
    return F.rint(F.sqrt(F.size(block).cast("double"))).cast("int")


def transpose(block: Column, nt: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(block) - 1), lambda i: F.get(block, (i % nt) * nt + F.floor(i / nt).cast("int")))


def nan_to_zero(block: Column) -> Column:
    return F.transform(block, lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x))


def symmetric(block: Column, nt: Column) -> Column:
    """The mean of a block and its transpose."""
    return F.zip_with(block, transpose(block, nt), lambda x, y: 0.5 * (x + y))


def entries(block: Column, nt: Column) -> Column:
    """array<struct<t, t2, value>> of a block's cells."""
    return F.transform(block, lambda x, i: F.struct(F.floor(i / nt).cast("int").alias("t"), (i % nt).cast("int").alias("t2"), x.alias("value")))
