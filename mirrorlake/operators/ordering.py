"""Orders, ordinals, pages and batches of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import checkpoint_ready, ship


def snapshot_ordinals(rows: DataFrame, table: str, order: list[str], *, per_table: bool = True, parts: int = 64) -> DataFrame:
    """Adds ``ordinal`` from 1, by table and order; restarting with each table, or running on.

    Numbers are made in two levels: within ranges of the order, and by the ranges' counts before, so no table is one task's.
    """
    keys = [table, *order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    checkpoint_ready(rows.sparkSession)
    ranged = ranged.checkpoint()  # read twice: both must see the same ranges
    counts = ranged.groupBy("_range", table).count()
    scope = Window.partitionBy(table) if per_table else Window.partitionBy(F.lit(0))  # a row for each range and table
    before = counts.select("_range", table, (F.sum("count").over(scope.orderBy("_range", table).rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range", table).orderBy(*order)))
    joined = within.join(before, (within["_range"] == before["_range"]) & within[table].eqNullSafe(before[table])).select(*[within[c] for c in rows.columns], "_n", "_before")
    return joined.select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_n")).cast("long").alias("ordinal"))


def change_order(changes: DataFrame, position: str, order: tuple[str, ...] = ("command_id", "seqval", "table_number", "operation")) -> DataFrame:
    """Adds ``ordinal``, the place of a change in the transaction of its commit position."""
    return changes.withColumn("ordinal", F.row_number().over(Window.partitionBy(position).orderBy(*order)).cast("long"))


def running_position(statements: DataFrame, source: str, order: str, position: str, durable: Column) -> DataFrame:
    """Adds ``reached``: the greatest position up to a statement, or what was durable before if that is greater."""
    so_far = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return statements.withColumn("reached", F.greatest(F.max(position).over(so_far), durable))


def next_page(rows: DataFrame, keys: list[str], after: tuple | None, size: int = 512) -> DataFrame:
    """The ``size`` rows that follow a key; the bound reaches the scan as filters on the first key."""
    if after is not None:
        later = F.lit(False)
        for i in range(len(keys)):
            same = F.lit(True)
            for k, v in zip(keys[:i], after, strict=False):
                same = same & (F.col(k) == v)
            later = later | (same & (F.col(keys[i]) > after[i]))
        rows = rows.where((F.col(keys[0]) >= after[0]) & later)
    return rows.orderBy(*keys).limit(size)


def latest(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The latest row of each group, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])


def scope_order(tables: DataFrame, order: str = "ordinal") -> DataFrame:
    """Steps of a snapshot's replacement: tables are emptied in reverse order, then filled in order."""
    last = tables.agg(F.max(order).alias("_last"))
    both = tables.crossJoin(F.broadcast(last))  # one row
    clear = both.select(*tables.columns, F.lit("delete").alias("action"), (F.col("_last") - F.col(order)).alias("step"))
    fill = both.select(*tables.columns, F.lit("insert").alias("action"), (F.col("_last") + F.col(order)).alias("step"))
    return clear.unionByName(fill)


def batches(rows: DataFrame, group: str, order: str, size: str, *, most_rows: int = 500, most_bytes: int = 1 << 20) -> DataFrame:
    """Adds ``chunk`` from 0: a row opens a new chunk of its group if it would go beyond the bytes, or the rows are full; one that has reached the bytes is closed.

    Where a chunk ends depends on all rows before, so a group is walked in order; only its key, order and sizes are.
    """

    def run(parts):
        held, n, total, chunk = None, 0, 0, 0
        for batch in parts:
            out = np.empty(batch.num_rows, np.int64)
            for i, (g, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if i == 0 and held is None or (g,) != held:
                    held, n, total, chunk = (g,), 0, 0, 0
                elif n and (n >= most_rows or total >= most_bytes or total + s > most_bytes):
                    n, total, chunk = 0, 0, chunk + 1
                out[i] = chunk
                n, total = n + 1, total + s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], [group, order, "chunk"])

    ship(rows.sparkSession)
    slim = rows.select(group, order, F.col(size).cast("long").alias("_size"))
    schema = T.StructType([slim.schema[group], slim.schema[order], T.StructField("chunk", T.LongType())])
    numbered = slim.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)
    return rows.join(numbered, [group, order])
