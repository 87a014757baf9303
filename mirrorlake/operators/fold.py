"""Fold an ordered change log into one change for each key, and fold that into a table.

A log row has the key columns, an order column, ``op`` (insert, update or delete), and for
each data column ``c`` a flag ``c__set``: not set means absent, the old value stays.

The fold needs no window: for each key the place of its last insert or delete and, for each
column, the last set value and its place are plain aggregates, combined before the shuffle,
so a key with very many changes costs one partial row a task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import checkpoint_ready


def fold(changes: DataFrame, keys: list[str], columns: list[str], order: str = "seq") -> DataFrame:
    """A change to a deleted row, before the next insert, has no effect (see ``unmatched`` to refuse it).

    One row a key: keys, ``deleted``, ``fresh`` (the row began with an insert), each column and its ``__set`` flag."""
    reset = F.col("op").isin("insert", "read", "delete")
    o = F.col(order)
    aggs: list[Column] = [
        F.max(F.when(reset, o)).alias("_reset"),
        F.max_by("op", F.when(reset, o)).alias("_reset_op"),
        F.max(o).alias("last_order"),
    ]
    for c in columns:
        there = F.when(F.col(f"{c}__set") & (F.col("op") != "delete"), o)
        aggs += [F.max_by(F.struct(F.col(c).alias("v")), there).alias(f"_{c}"), F.max(there).alias(f"_{c}_at")]
    out = changes.groupBy(*keys).agg(*aggs)
    fresh = F.coalesce(F.col("_reset_op").isin("insert", "read"), F.lit(False))
    picks = []
    for c in columns:
        live = F.col(f"_{c}_at").isNotNull() & (F.col("_reset").isNull() | (F.col(f"_{c}_at") >= F.col("_reset")))
        picks += [F.when(live, F.col(f"_{c}.v")).alias(c), live.alias(f"{c}__set")]
    return out.select(*keys, F.coalesce(F.col("_reset_op") == "delete", F.lit(False)).alias("deleted"), fresh.alias("fresh"), "last_order", *picks)


def apply_fold(base: DataFrame, folded: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The next version of a keyed table."""
    f = folded.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "deleted", "fresh", *[F.col(c).alias(f"_n_{c}") for c in columns], *[f"{c}__set" for c in columns])
    on = [base[k].eqNullSafe(f[f"_k_{k}"]) for k in keys]
    joined = base.withColumn("_old", F.lit(True)).join(f, on, "full_outer")
    known = F.col("deleted").isNotNull()
    stays = (~known) | (~F.col("deleted") & (F.col("fresh") | F.col("_old").isNotNull()))
    value = lambda c: F.when(~known, F.col(c)).when(F.col("fresh") | F.col(f"{c}__set"), F.col(f"_n_{c}")).otherwise(F.col(c))
    other = [c for c in base.columns if c not in keys and c not in columns]
    return joined.where(stays).select(
        *[F.when(F.col("_old").isNull(), F.col(f"_k_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        *[value(c).alias(c) for c in columns],
        *[F.when(F.coalesce(F.col("fresh"), F.lit(False)), F.lit(None)).otherwise(F.col(c)).alias(c) for c in other],
    )


def unmatched(base: DataFrame, changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Changes that don't hit exactly one row: updates and deletes of an absent key, inserts of a present one."""
    w = Window.partitionBy(*keys).orderBy(order)
    there = base.select(*keys).distinct().withColumn("_there", F.lit(True))
    seen = changes.select(*keys, order, "op").withColumn("_before", F.lag("op").over(w))
    full = seen.join(there, keys, "left")
    present = F.when(F.col("_before").isNull(), F.coalesce("_there", F.lit(False))).otherwise(F.col("_before") != "delete")
    bad = F.when(F.col("op").isin("insert", "read"), present).otherwise(~present)
    return full.where(bad).select(*keys, order, "op")


def lineage(changes: DataFrame, order: str = "seq", old: str = "old_key", new: str = "key") -> DataFrame:
    """Follow keys that updates change: (order, root key of the row that the change meets).

    Rows are renamed in chains (1 to 2, 2 to 3) and keys come back after a delete, so this is sequential within a set of
    connected keys. Only the rename edges are walked, grouped by connected set; keys without renames never get here.
    """
    edges = changes.where(F.col(old).isNotNull() & ~F.col(old).eqNullSafe(F.col(new)))
    touched = edges.select(F.col(old).alias("k")).union(edges.select(F.col(new).alias("k"))).distinct()
    labels = touched.withColumn("label", F.col("k"))
    checkpoint_ready(changes.sparkSession)
    while True:
        spread = (
            edges.select(F.col(old).alias("a"), F.col(new).alias("b")).union(edges.select(F.col(new).alias("a"), F.col(old).alias("b")))
            .join(labels.withColumnsRenamed({"k": "b"}), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("near"))
        )
        after = labels.join(spread, "k").select("k", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        after = after.checkpoint()
        labels = after.select("k", "label")
        if not after.where("moved").limit(1).count():
            break
    meets = F.coalesce(F.col(old), F.col(new))
    todo = changes.select(F.col(order).alias("o"), "op", meets.alias("was"), F.col(new).alias("now")).join(labels.withColumnsRenamed({"k": "was"}), "was", "left")
    alone = todo.where("label IS NULL").select("o", F.col("was").alias("root"))
    schema = T.StructType([T.StructField("o", changes.schema[order].dataType), T.StructField("root", changes.schema[new].dataType)])

    def walk(batches):
        label, at = None, {}
        for batch in batches:
            roots = []
            for set_, op, was, now in zip(*[batch.column(c).to_pylist() for c in ("label", "op", "was", "now")], strict=True):
                if set_ != label:
                    label, at = set_, {}
                root = at.pop(was, was)
                roots.append(root)
                if op != "delete" and (root != now):
                    at[now] = root
            yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array(roots, batch.schema.field("was").type)], ["o", "root"])

    connected = todo.where("label IS NOT NULL").repartition("label").sortWithinPartitions("label", "o")
    walked = connected.mapInArrow(walk, schema)
    return alone.unionByName(walked).withColumnsRenamed({"o": order})
