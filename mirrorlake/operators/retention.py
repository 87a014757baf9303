"""What the log keeps: acknowledged messages go when they are old or the archive is too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evictable(messages: DataFrame, *, delivered: int | Column, max_bytes: int | Column, oldest: Column) -> DataFrame:
    """seq of delivered messages to drop, always the oldest first.

    A message goes if it or a later delivered one is older than ``oldest``, or if what is delivered
    from it on exceeds ``max_bytes``. The running sum is over envelopes of one source's log.
    ``delivered`` and ``max_bytes`` are values or columns of ``messages``.
    """
    done = messages.where(F.col("seq") <= delivered)
    newest_first = Window.partitionBy("source_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    sized = done.withColumn("_bytes", F.sum("bytes").over(newest_first)).withColumn("_old", F.max((F.col("created_at") < oldest).cast("int")).over(newest_first))
    return sized.where((F.col("_bytes") > max_bytes) | (F.col("_old") == 1)).select("source_id", "seq")
