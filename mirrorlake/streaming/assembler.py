"""Transactions out of an unbounded frame stream: rows are held in state until their commit comes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mirrorlake.model import ReplicationError

OUT = "source_id string, xid long, ordinal long, seq long, action string, body string"
_HELD = T.StructType([T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()), T.StructField("body", T.StringType())])


class TransactionProcessor(StatefulProcessor):
    """Keyed by source, the order of whose log is the order of its transactions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", _HELD)
        self.open = handle.getValueState("open", T.StructType([T.StructField("xid", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.seq):
            xid = self.open.get()[0] if self.open.exists() else None
            if r.action == "B":
                if xid is not None:
                    raise ReplicationError(f"transaction {r.xid} begins inside {xid}")
                self.open.update((r.xid,))
            elif xid != r.xid:
                raise ReplicationError(f"{r.action} of {r.xid} while {xid} is open")
            elif r.action == "C":
                for i, held in enumerate(sorted(self.rows.get(), key=lambda h: h[0]), 1):
                    yield Row(source_id=key[0], xid=xid, ordinal=i, seq=held[0], action=held[1], body=held[2])
                self.rows.clear()
                self.open.clear()
            else:
                self.rows.appendValue((r.seq, r.action, r.body))

    def close(self) -> None:
        pass


def assemble(frames: DataFrame) -> DataFrame:
    """Committed rows of a streaming frame table (source_id, seq, xid, action, body)."""
    return frames.groupBy("source_id").transformWithState(TransactionProcessor(), OUT, "Append", "None")
