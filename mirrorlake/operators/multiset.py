"""Tables without a key: equal rows are interchangeable, a change hits one of them, null equals null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_signed(base: DataFrame, changes: DataFrame, columns: list[str], sign: str = "sign") -> DataFrame:
    """Add (+1) and remove (-1) full row images; equal rows are counted, combined before the shuffle."""
    every = base.select(*columns, F.lit(1).alias(sign)).unionByName(changes.select(*columns, sign))
    counted = every.groupBy(*columns).agg(F.sum(sign).alias("_n")).where("_n > 0")
    return counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*columns)


def delete_one_each(base: DataFrame, deletes: DataFrame, columns: list[str]) -> DataFrame:
    """Multiset difference: each delete takes one of the equal rows."""
    return base.select(*columns).exceptAll(deletes.select(*columns))


def numbered(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Number equal rows, to match one of N."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*columns).orderBy(order)))


def matched(rows: DataFrame, others: DataFrame, columns: list[str], of: str) -> DataFrame:
    """Rows with how many of ``others`` equal them in ``columns`` (null equals null), and the least and greatest ``of`` of these.

    ``others`` are reduced to distinct keys first, so a key that very many share, null too, makes no pairs.
    """
    keys = others.groupBy(*columns).agg(F.count(F.lit(1)).alias("matches"), F.min(of).alias("least"), F.max(of).alias("greatest"))
    keys = keys.withColumnsRenamed({c: f"_{c}" for c in columns})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return rows.join(keys, on).drop(*[f"_{c}" for c in columns])


def overdrawn(base: DataFrame, changes: DataFrame, columns: list[str], order: str, sign: str = "sign") -> DataFrame:
    """Removals that find no row at their time."""
    w = Window.partitionBy(*columns).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    every = base.groupBy(*columns).agg(F.count(F.lit(1)).alias(sign)).withColumn("_o", F.lit(-1).cast("long")).unionByName(
        changes.select(*columns, F.col(sign).cast("long").alias(sign), F.col(order).cast("long").alias("_o"))
    )
    return every.withColumn("left", F.sum(sign).over(w)).where(f"left < 0 AND {sign} < 0").select(*columns, F.col("_o").alias(order))
