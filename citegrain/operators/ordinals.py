"""Consecutive numbers within a key without putting a hot key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from citegrain.operators.frames import first_n

_BLOCK_BITS = 12


def ordinals(rows: DataFrame, key: str, order: str, name: str, block: int = 1 << _BLOCK_BITS, then=()) -> DataFrame:
    """1..n per key in ``order`` (a numeric position, nulls first; columns ``then`` decide among equal ones).

    Positions are cut into blocks; rows are ranked inside (key, block) and the sizes of the
    earlier blocks are added. The running total sees one row per block instead of one per row.
    """
    blocked = rows.withColumn("_block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62))))
    sizes = blocked.groupBy(key, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(order, *then)
    return (
        blocked.withColumn(name, F.row_number().over(inside))
        .join(offsets, [key, "_block"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_block", "_before")
    )


def first_or_all(rows: DataFrame, key: str, order: list[str], n: int | None, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key or, without ``n``, all rows, ranked; ``order`` starts with a numeric position."""
    if n is not None:
        return first_n(rows, key, order, n, rank=rank)
    return ordinals(rows, key, order[0], rank, then=order[1:])
