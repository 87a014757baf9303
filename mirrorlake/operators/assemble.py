"""Transactions out of an ordered log: grammar, ordinals, chunks, the gate of durable commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transactions(frames: DataFrame, *, source: str = "source_id", order: str = "seq", action: str = "action", xid: str = "xid") -> DataFrame:
    """Rows of complete transactions of a begin/change/commit stream (B, I, U, D, C).

    Adds tx (number of the begin record in the source), ordinal and changes; rows of a transaction
    whose commit has not come, or whose commit names another id, are left out.
    """
    w = Window.partitionBy(source).orderBy(order)
    numbered = frames.withColumn("tx", F.sum(F.when(F.col(action) == "B", 1).otherwise(0)).over(w))
    per = numbered.groupBy(source, "tx").agg(
        F.max_by(action, order).alias("_last"),
        F.min(xid).alias("_least"),
        F.max(xid).alias("_most"),
        F.min_by(action, order).alias("_first"),
    )
    whole = per.where("_first = 'B' AND _last = 'C' AND _least = _most AND tx > 0").select(source, "tx")
    rows = numbered.where(F.col(action).isin("I", "U", "D")).join(whole, [source, "tx"], "left_semi")
    place = Window.partitionBy(source, "tx").orderBy(order)
    return rows.withColumn("ordinal", F.row_number().over(place))


def grammar_errors(frames: DataFrame, *, source: str = "source_id", order: str = "seq", action: str = "action", xid: str = "xid") -> DataFrame:
    """Frames that break begin/change/commit: nested begin, change or commit outside, commit of another id, truncate or message."""
    w = Window.partitionBy(source).orderBy(order)
    seen = frames.withColumn("_before", F.lag(action).over(w)).withColumn("_open", F.lag(xid).over(w))
    start = F.col(action) == "B"
    inside = F.coalesce(F.col("_before").isin("B", "I", "U", "D"), F.lit(False))
    bad = (start & inside) | (~start & ~inside) | (~start & (F.col("_open") != F.col(xid))) | ~F.col(action).isin("B", "I", "U", "D", "C")
    return seen.where(F.coalesce(bad, F.lit(True))).select(*frames.columns)


def with_ordinals(rows: DataFrame, tx: str, order: str) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(tx).orderBy(order)).cast("long"))


def with_chunks(rows: DataFrame, tx: str, order: str, size: int) -> DataFrame:
    """Number the chunks of ``size`` rows inside each transaction from 0."""
    place = F.row_number().over(Window.partitionBy(tx).orderBy(order)) - 1
    return rows.withColumn("chunk", F.floor(place / size).cast("long"))


def gate(rows: DataFrame, commits: DataFrame, tx: str, *, durable: Column | None = None) -> DataFrame:
    """Only rows whose transaction has a commit, and one past what is durable already."""
    done = commits if durable is None else commits.where(durable)
    return rows.join(done.select(tx).distinct(), tx, "left_semi")


def next_transaction(change_tables: dict[int, DataFrame], after, position: str = "lsn") -> DataFrame:
    """The rows of the smallest commit position past ``after`` over all change tables, padded to the widest, in order."""
    every = None
    for number, table in sorted(change_tables.items()):
        part = table.withColumn("table_number", F.lit(number)).where(F.col(position) > after)
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    least = every.agg(F.min(position).alias("_least"))
    return every.join(F.broadcast(least), F.col(position) == F.col("_least")).drop("_least")  # one row


# ---- before and after images ---------------------------------------------------------------


def pair_images(changes: DataFrame, keys: list[str], values: list[str], *, op: str = "operation") -> DataFrame:
    """Operations 1 delete, 2 insert, 3 before and 4 after an update, paired by position: op, old and new values.

    An update's two images are rows of one position, so they meet in one aggregation.
    """
    pick = lambda c, n: F.max(F.when(F.col(op).isin(*n), F.struct(F.col(c).alias("v"))))["v"]
    kind = F.when(F.max(op) == 4, "update").when(F.max(op) == 2, "insert").otherwise("delete")
    return changes.groupBy(*keys).agg(
        kind.alias("op"), *[pick(c, (1, 3)).alias(f"old_{c}") for c in values], *[pick(c, (2, 4)).alias(f"new_{c}") for c in values]
    )


def pairing_errors(changes: DataFrame, keys: list[str], *, op: str = "operation") -> DataFrame:
    """Positions with half an update, a repeated image or a mixture."""
    n = lambda k: F.sum((F.col(op) == k).cast("int"))
    counted = changes.groupBy(*keys).agg(*[n(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    good = "(n1 = 1 AND n2 + n3 + n4 = 0) OR (n2 = 1 AND n1 + n3 + n4 = 0) OR (n3 = 1 AND n4 = 1 AND n1 + n2 = 0)"
    return counted.where(f"NOT ({good})").select(*keys)


def outbox_statements(events: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of a trigger outbox: events joined with their values, by statement in change order.

    The values of an event must be dense in ordinal; text, unicode and binary columns are one value.
    """
    merged = values.select(
        "change_id", "ordinal", F.when(F.col("is_null"), F.lit(None)).otherwise(F.coalesce("value_unicode", "value_text", F.concat(F.lit("0x"), F.hex("value_binary")))).alias("value")
    )
    per = merged.groupBy("change_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("value").alias("s")))), lambda x: x["s"]["value"]).alias("row_values"),
        F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("top"),
    )
    checked = per.withColumn("row_values", F.when(F.col("n") == F.col("top"), F.col("row_values")).otherwise(F.raise_error(F.lit("outbox values are not dense"))))
    first = events.groupBy("statement_id").agg(F.min("change_id").alias("first_change"), F.max("change_id").alias("last_change"))
    return events.join(checked.select("change_id", "row_values"), "change_id").join(first, "statement_id")


# ---- binary logs whose statements open and close transactions ---------------------------------


def statement_transactions(frames: DataFrame, *, source: str = "source_id", order: str = "seq", action: str = "action") -> DataFrame:
    """Rows of the transactions of a log of BEGIN, row events (R), XID, ROLLBACK and other statements (DDL).

    Adds tx (number of the span in its source), ordinal and ``boundary``, the order of the XID that closes it. A BEGIN opens, an
    XID closes; a ROLLBACK or a DDL statement is a checkpoint between transactions, see ``statement_errors``. Spans that nothing has
    closed yet are left out.
    """
    w = Window.partitionBy(source).orderBy(order)
    ends = F.when(F.col(action).isin("XID", "ROLLBACK", "DDL"), 1).otherwise(0)
    spans = frames.withColumn("tx", F.sum(ends).over(w) - ends)  # an end belongs to the span that it closes
    closed = spans.where(F.col(action) == "XID").select(source, "tx", F.col(order).alias("boundary"))
    rows = spans.where(F.col(action) == "R").join(closed, [source, "tx"])
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(source, "tx").orderBy(order)).cast("long"))


def statement_errors(frames: DataFrame, *, source: str = "source_id", order: str = "seq", action: str = "action") -> DataFrame:
    """ROLLBACK and DDL frames that come after row events of a transaction which is not closed: such rows can't be taken back."""
    w = Window.partitionBy(source).orderBy(order)
    ends = F.when(F.col(action).isin("XID", "ROLLBACK", "DDL"), 1).otherwise(0)
    spans = frames.withColumn("_tx", F.sum(ends).over(w) - ends)
    per = spans.groupBy(source, "_tx").agg(F.sum((F.col(action) == "R").cast("int")).alias("_rows"), F.max_by(action, order).alias("_end"), F.max(order).alias("_at"))
    bad = per.where(F.col("_end").isin("ROLLBACK", "DDL") & (F.col("_rows") > 0)).select(source, F.col("_at").alias(order))
    return frames.join(bad, [source, order], "left_semi")


# ---- checks ------------------------------------------------------------------------------------


def pending(events: DataFrame, owner: str, waits: Column) -> DataFrame:
    """For each owner: events that wait, and all."""
    return events.groupBy(owner).agg(F.count(F.when(waits, F.lit(1))).alias("pending"), F.count(F.lit(1)).alias("owned"))


def applicable(messages: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """Marks (``applied``) the messages whose kind is wanted; the others stay, to be checked and acknowledged."""
    return messages.withColumn("applied", F.coalesce(F.col(kind).isin(kinds), F.lit(False)))


def exists(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Marks (``there``) the wanted keys that are found."""
    return wanted.join(found.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left").withColumn("there", F.coalesce("_there", F.lit(False))).drop("_there")
