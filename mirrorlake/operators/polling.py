"""Reading sources that are polled: change tables between watermarks, and a trigger outbox that is emptied after publishing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorlake.model import SequenceError
from mirrorlake.operators.assemble import next_transaction


class RetentionGap(SequenceError):
    """Changes that were not read yet are gone from the source."""


def check_range(after, minimum: dict) -> None:
    """Refuse to read on after ``after`` where a change table's low watermark is unknown or past it."""
    for table, low in sorted(minimum.items()):
        if low is None:
            raise SequenceError(f"table {table} has no low watermark")
        if after < low:
            raise RetentionGap(f"table {table} starts at {low}, after {after}")


def poll(change_tables: dict[int, DataFrame], after, *, minimum: dict, upper, position: str = "lsn") -> DataFrame:
    """The next whole transaction after ``after`` and up to the high watermark ``upper``, that was fixed before; no rows if there is none.

    ``minimum`` has the low watermark of each table. The bounds are values, so that they reach the scans.
    """
    check_range(after, {n: minimum.get(n) for n in change_tables})
    bounded = {n: df.where(F.col(position) <= upper) for n, df in change_tables.items()}
    return next_transaction(bounded, after, position)


def oldest_statement(events: DataFrame) -> DataFrame:
    """The events of the statement that holds the smallest change_id."""
    first = events.agg(F.min_by("statement_id", "change_id").alias("_first"))
    return events.join(F.broadcast(first), F.col("statement_id") == F.col("_first")).drop("_first")  # one row


def discard_through(events: DataFrame, boundary: Column) -> DataFrame:
    """The events that a snapshot up to ``boundary`` doesn't hold."""
    return events.where(F.col("change_id") > boundary)


def without_published(events: DataFrame, published: DataFrame) -> DataFrame:
    """What stays in the outbox once the statements in ``published`` are durable; run again, it changes nothing."""
    return events.join(published.select("statement_id").distinct(), "statement_id", "left_anti")


def without_owner(values: DataFrame, events: DataFrame) -> DataFrame:
    """The values whose event still exists."""
    return values.join(events.select("change_id"), "change_id", "left_semi")


def minima(change_tables: dict[int, DataFrame], position: str = "lsn") -> DataFrame:
    """table_number and its smallest position, null for a table without rows."""
    parts = [df.agg(F.min(position).alias(position)).select(F.lit(n).alias("table_number"), position) for n, df in sorted(change_tables.items())]
    return reduce(DataFrame.unionByName, parts)
