"""Joins with a side whose size is checked first, and joins on order."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.scans import running_max
from siltstone.session import BROADCAST_LIMIT, planned_bytes


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", salt_by: Sequence[str] = (), salts: int = 8, limit: int | None = None) -> DataFrame:
    """Join many ``rows`` with a smaller ``table`` on equal ``keys`` (inner, left, left_semi or left_anti).

    The table is broadcast if the size Spark plans for it is at most ``limit``
    bytes (without it the configuration ``spark.siltstone.broadcastLimit``, else :data:`~siltstone.session.BROADCAST_LIMIT`). Beyond that both sides are shuffled; with ``salt_by``, columns that
    vary within a key, hot keys are spread over ``salts`` tasks and the table is
    repeated once per salt. Null keys match nothing.
    """
    if limit is None:
        limit = int(rows.sparkSession.conf.get("spark.siltstone.broadcastLimit", None) or BROADCAST_LIMIT)
    if planned_bytes(table) <= limit:
        return rows.join(F.broadcast(table), list(keys), how)
    if not salt_by:
        return rows.join(table, list(keys), how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: str, right_pos: str, values: Sequence[str], width: int) -> DataFrame:
    """Each left row with the ``values`` of the last right row at or before its position.

    Both sides are merged in one sort by position; hot keys are cut into blocks of
    ``width`` positions. Ties of the right side go to the largest values. A left
    row without match, with a null position or a null key, gets nulls.
    """
    names = left.columns
    known = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    right = right.where(known)
    nulls = left.where(~known).select(*names, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    left = left.where(known)
    l = left.select(*keys, F.col(left_pos).alias("__pos"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).cast(right.select(F.struct(right_pos, *values)).schema[0].dataType).alias("__found"))
    r = right.where(F.col(right_pos).isNotNull()).select(*keys, F.col(right_pos).alias("__pos"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"), F.struct(right_pos, *values).alias("__found"))
    merged = running_max(l.unionByName(r), keys, "__pos", ["__side"], F.col("__found"), "__last", width)
    hit = merged.where("__side = 1")
    found = hit.select(*[F.col(f"__row.{n}").alias(n) for n in names], *[F.when(F.col("__pos").isNotNull(), F.col(f"__last.{v}")).alias(v) for v in values])
    return found.unionByName(nulls)
