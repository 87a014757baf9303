"""Order of messages: contiguity, idempotent receipt, and the acceptance rules as a state machine.

Envelopes (a few fields of each message) decide; rows stay distributed. The window checks run on
envelopes of one source and generation, which are ordered by nature.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorlake.model import TERMINAL, SequenceError

STREAM_GROUP = ["source_id", "generation"]


def gaps(envelopes: DataFrame, group: list[str] = STREAM_GROUP) -> DataFrame:
    """Messages whose number isn't the one before plus 1 (the first: 1)."""
    w = Window.partitionBy(*group).orderBy("seq")
    before = envelopes.select(*group, "seq").distinct().withColumn("expected", F.coalesce(F.lag("seq").over(w), F.lit(0)) + 1)
    return before.where("seq <> expected")


def conflicts(envelopes: DataFrame, group: list[str] = STREAM_GROUP) -> DataFrame:
    """Numbers that came with different payloads."""
    return envelopes.groupBy(*group, "seq").agg(F.count_distinct("payload_hash").alias("payloads")).where("payloads > 1")


def receive(envelopes: DataFrame, seen: DataFrame, group: list[str] = STREAM_GROUP) -> DataFrame:
    """New messages once each: those received before, with the same payload, are left out; see ``conflicts`` for others."""
    return envelopes.join(seen.select(*group, "seq").distinct(), [*group, "seq"], "left_anti").dropDuplicates([*group, "seq"])


def applied_watermark(envelopes: DataFrame, group: list[str] = STREAM_GROUP) -> DataFrame:
    """Highest received number and highest one up to which all is applied."""
    return envelopes.groupBy(*group).agg(F.max("seq").alias("received_seq"), F.max(F.when(F.col("kind").isin(*TERMINAL), F.col("seq"))).alias("applied_seq"))


@dataclass(frozen=True)
class Progress:
    """Where the target stands in a source's stream."""

    generation: str = ""
    received: int = 0
    applied: int = 0
    phase: str = ""
    open_transaction: str = ""
    schema_version: str = ""
    pending_schema_version: str = ""


@dataclass(frozen=True)
class Envelope:
    generation: str
    seq: int
    kind: str
    transaction: str = ""
    schema_version: str = ""
    payload_hash: str = ""


@dataclass
class Sequencer:
    """Takes envelopes one by one; ``accept`` says whether the message is new. A refused one changes nothing."""

    progress: Progress = field(default_factory=Progress)
    hashes: dict[tuple[str, int], str] = field(default_factory=dict)
    strict: bool = False

    def accept(self, e: Envelope) -> bool:
        p = self.progress
        if not 0 < e.seq < 2**63:
            raise SequenceError(f"seq {e.seq} is out of range")
        if e.generation != p.generation:
            if e.seq != 1 or e.kind != "snapshot_begin":
                raise SequenceError("a generation starts with snapshot_begin at seq 1")
            p = Progress(generation=e.generation, schema_version=e.schema_version)
        elif e.seq <= p.received:
            known = self.hashes.get((e.generation, e.seq))
            if known is not None and known != e.payload_hash:
                raise SequenceError(f"seq {e.seq} came before with another payload")
            return False
        if e.seq != p.received + 1:
            raise SequenceError(f"seq {e.seq} follows {p.received}")
        p = self._transaction(self._schema(p, e), e)
        p = replace(p, received=e.seq, applied=e.seq if e.kind in TERMINAL else p.applied)
        if p.generation != self.progress.generation:
            self.hashes = {}
        self.hashes[e.generation, e.seq] = e.payload_hash
        self.progress = p
        return True

    def _schema(self, p: Progress, e: Envelope) -> Progress:
        if e.kind == "schema" and p.phase == "stream":
            if not e.schema_version or p.pending_schema_version not in ("", e.schema_version):
                raise SequenceError("schema message without a version, or of another one than pending")
            return replace(p, pending_schema_version=e.schema_version)
        if e.kind == "schema_end":
            if p.phase != "stream" or not e.schema_version or e.schema_version != p.pending_schema_version:
                raise SequenceError("schema_end of a version that isn't pending")
            return replace(p, schema_version=e.schema_version, pending_schema_version="")
        if p.pending_schema_version:
            raise SequenceError("the schema change must end before rows come")
        if e.schema_version != p.schema_version:
            raise SequenceError(f"schema version {e.schema_version!r} isn't active")
        return p

    def _transaction(self, p: Progress, e: Envelope) -> Progress:
        opens, closes = ("transaction_rows", "file_begin", "file_chunk"), ("transaction_end", "file_end")
        want = "stream" if e.kind in (*opens, *closes, "file_delete", "schema_end") else "snapshot" if e.kind in ("snapshot_rows", "snapshot_end") else None
        if want and p.phase != want:
            raise SequenceError(f"{e.kind} in phase {p.phase!r}")
        if e.kind in opens:
            if not e.transaction or p.open_transaction not in ("", e.transaction):
                raise SequenceError(f"{e.kind} of {e.transaction!r} while {p.open_transaction!r} is open")
            return replace(p, open_transaction=e.transaction)
        if e.kind in closes:
            empty = e.kind == "transaction_end" and not p.open_transaction and not self.strict  # a transaction without rows
            if e.transaction != p.open_transaction and not empty:
                raise SequenceError(f"{e.kind} of {e.transaction!r} while {p.open_transaction!r} is open")
            return replace(p, open_transaction="")
        if e.kind in ("file_delete", "schema") and p.open_transaction:
            raise SequenceError(f"{e.kind} while {p.open_transaction!r} is open")
        if e.kind == "snapshot_begin":
            return replace(p, phase="snapshot")
        if e.kind == "snapshot_end":
            return replace(p, phase="stream")
        return p

    def accept_prefix(self, envelopes: Iterable[Envelope]) -> tuple[list[int], Exception | None]:
        """Numbers of the new messages of the valid prefix, and what stopped it."""
        taken = []
        for e in envelopes:
            try:
                if self.accept(e):
                    taken.append(e.seq)
            except SequenceError as error:
                return taken, error
        return taken, None
