"""Running aggregates and prefix sums over groups too large for one task.

A plain window puts each group into one task. Here a group is cut into blocks:
block totals are pre-aggregated, carried forward over the few blocks of the
group, and added to a window inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


def _blocked(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.coalesce(F.expr(f"`{pos}` div {width}"), F.lit(-(2**62))))


def running_max(df: DataFrame, keys: Sequence[str], pos: str, order: Sequence[str], value: Column, out: str, width: int) -> DataFrame:
    """Largest ``value`` up to and including each row, and over its whole group.

    Rows of a group (``keys``) are ordered by ``pos`` and then ``order``; ``width``
    positions make a block. Adds ``out`` and ``out + "_all"``. A null ``pos``
    comes before all others; null values are passed over. Keys may not be null. The join
    with the carried totals and the window inside a block share one shuffle of the rows.
    """
    rows = _blocked(df.withColumn("__value", value), pos, width)
    group = Window.partitionBy(*keys)
    before = group.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, _BLOCK).agg(F.max("__value").alias("__total"))
    carried = totals.select(*keys, _BLOCK, F.max("__total").over(before).alias("__carry"), F.max("__total").over(group).alias("__all"))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(F.col(pos).asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*keys, _BLOCK])
        .withColumn(out, F.greatest(F.max("__value").over(inside), F.col("__carry")))
        .withColumn(out + "_all", F.col("__all"))
        .drop("__value", _BLOCK, "__carry", "__all")
    )


def sums_before(df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], width: int) -> DataFrame:
    """Per distinct (``keys``, ``pos``) the sums of ``values`` over smaller positions of the group.

    Gives one row per key and position, with ``<value>_before`` (null if there is
    nothing before). Rows are pre-aggregated per position; null positions are left out.
    """
    at = df.where(F.col(pos).isNotNull()).groupBy(*keys, pos).agg(*[F.sum(v).alias(v) for v in values])
    rows = _blocked(at, pos, width)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, _BLOCK).agg(*[F.sum(v).alias(v) for v in values])
    carried = totals.select(*keys, _BLOCK, *[F.sum(v).over(before).alias(f"__c_{v}") for v in values])
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)

    def both(v: str) -> Column:
        local, carry = F.sum(v).over(inside), F.col(f"__c_{v}")
        return F.when(local.isNotNull() | carry.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))

    return rows.join(carried, [*keys, _BLOCK]).select(*keys, pos, *[both(v).alias(f"{v}_before") for v in values])


def prefix_sum(df: DataFrame, keys: Sequence[str], unique: Sequence[str], value: str, out: str, within: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """Exclusive prefix sum of ``value`` within each group, in a fixed but arbitrary order.

    The order is by ``within``, a hash bucket of ``unique`` and then ``unique`` itself, hence the
    same on every evaluation. Adds ``out`` and ``out + "_total"``, the sum of the
    group. ``keys``, ``within`` and ``unique`` may not be null.
    """
    rows = df.withColumn(_BLOCK, F.pmod(F.xxhash64(*unique), F.lit(buckets)).cast("int"))
    blocks = [*keys, *within, _BLOCK]
    totals = rows.groupBy(*blocks).agg(F.sum(value).alias("__sum"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(*within, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*blocks, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carry"), F.sum("__sum").over(group).alias(out + "_total"))
    inside = Window.partitionBy(*blocks).orderBy(*unique).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carried, blocks)
        .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__carry"))
        .drop(_BLOCK, "__carry")
    )
