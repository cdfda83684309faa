"""DataFrame helpers: optional columns, first-n and first-wins without hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# WindowGroupLimit pre-filters ranks on the map side up to this limit (Spark default).
MAP_SIDE_RANK_LIMIT = 1000


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add missing optional columns as typed NULLs."""
    missing = {name: F.lit(None).cast(kind) for name, kind in types.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def first_n(df: DataFrame, keys, order, n: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """First ``n`` rows per key in a total order, ranked 1..n.

    Up to 1000 rows Spark limits each group before the shuffle. Beyond that a salted
    first pass bounds what any single task sees of a hot key to ``salts * n`` rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    if n > MAP_SIDE_RANK_LIMIT:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", spread)
            .withColumn("_pre", F.row_number().over(salted))
            .where(F.col("_pre") <= n)
            .drop("_salt", "_pre")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= n)


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the earliest in ``order``. Partial aggregation bounds hot keys."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[_as_col(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(flags) -> Column:
    """Sum of boolean columns as an integer."""
    out = F.lit(0)
    for flag in flags:
        out = out + F.coalesce(flag.cast("int"), F.lit(0))
    return out


def steps(value: Column, *rules, default=0) -> Column:
    """First threshold reached wins: steps(v, (10, 5), (3, 2)) → 5 from 10, 2 from 3, else default."""
    out = None
    for threshold, result in rules:
        test = threshold if isinstance(threshold, Column) else value >= threshold
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.lit(default))
