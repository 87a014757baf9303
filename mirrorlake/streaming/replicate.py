"""Apply a stream of row changes to versioned tables, effectively once.

A table version is a Parquet folder; one manifest names the versions of all tables and how far the
stream is applied. A micro-batch is folded per key, joined once with the current version and written
to a new folder; only the manifest makes it current. A batch that was applied before is left out by its
sequence numbers, so a replayed batch changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.model import MatchError, SequenceError
from mirrorlake.operators import sequence
from mirrorlake.operators.evolve import add_columns
from mirrorlake.operators.fold import apply_fold, fold, unmatched
from mirrorlake.operators.multiset import apply_signed, overdrawn
from mirrorlake.sources.log import Manifests


class Target:
    """Versioned tables below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(self.root)

    def state(self) -> dict:
        return self.manifests.latest() or {"number": 0, "tables": {}, "applied": 0, "generation": "", "audit": []}

    def _commit(self, state: dict, **changes) -> dict:
        state = {**state, **changes, "number": state["number"] + 1}
        self.manifests.commit(state["number"], state)
        return state

    def _write(self, df: DataFrame) -> dict:
        folder = f"{self.root}/versions/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return {"folder": folder, "schema": df.schema.json()}

    def table(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType
        import json

        version = self.state()["tables"][name]
        return self.spark.read.schema(StructType.fromJson(json.loads(version["schema"]))).parquet(version["folder"])

    def replace(self, tables: dict[str, DataFrame], *, generation: str, seq: int = 0) -> dict:
        """A snapshot: the named tables are replaced together, the others stay."""
        state = self.state()
        written = {name: self._write(df) for name, df in tables.items()}
        return self._commit(state, tables={**state["tables"], **written}, generation=generation, applied=seq)

    def evolve(self, name: str, columns: dict[str, str]) -> dict:
        state = self.state()
        return self._commit(state, tables={**state["tables"], name: self._write(add_columns(self.table(name), columns))})

    def apply(self, name: str, changes: DataFrame, keys: list[str], columns: list[str], *, strict: bool = True) -> dict:
        """Apply the changes (``seq`` ordered) that come after what is applied; all or nothing."""
        state = self.state()
        fresh = changes.where(F.col("seq") > state["applied"]).persist()
        try:
            n, first, last = fresh.select("seq").distinct().agg(F.count(F.lit(1)), F.min("seq"), F.max("seq")).first()
            if not n:
                return state
            if first != state["applied"] + 1 or last - first + 1 != n:
                raise SequenceError(f"changes {first} to {last} are not contiguous after {state['applied']}")
            base = self.table(name)
            if keys:
                if strict and (bad := unmatched(base, fresh, keys).first()):
                    raise MatchError(f"change {bad['seq']} ({bad['op']}) doesn't hit exactly one row")
                next_ = apply_fold(base, fold(fresh, keys, columns), keys, columns)
            else:
                if strict and (bad := overdrawn(base, fresh, columns, "seq").first()):
                    raise MatchError(f"change {bad['seq']} finds no row")
                next_ = apply_signed(base, fresh, columns)
            return self._commit(state, tables={**state["tables"], name: self._write(next_)}, applied=last)
        finally:
            fresh.unpersist()


    def apply_transactions(self, tables: dict[str, tuple[DataFrame, list[str], list[str]]], ends: DataFrame, *, strict: bool = True) -> dict:
        """Apply the changes of several tables (name: changes, keys, columns), transaction by transaction, in one commit.

        ``ends`` has a row (seq, tx) for each transaction_end. The envelopes of all tables and the ends are one sequence; what follows
        the last end stays for the next call, and rows of a transaction without an end are not applied.
        """
        state = self.state()
        upto = ends.where(F.col("seq") > state["applied"]).agg(F.max("seq")).first()[0]
        if upto is None:
            return state
        seqs = ends.select("seq")
        for changes, _, _ in tables.values():
            seqs = seqs.unionByName(changes.select("seq"))
        n, first = seqs.where(F.col("seq").between(state["applied"] + 1, upto)).distinct().agg(F.count(F.lit(1)), F.min("seq")).first()
        if first != state["applied"] + 1 or n != upto - state["applied"]:
            raise SequenceError(f"messages after {state['applied']} up to {upto} are not contiguous")
        written = {}
        for name, (changes, keys, columns) in tables.items():
            fresh = changes.where(F.col("seq").between(state["applied"] + 1, upto)).join(ends.select("tx").distinct(), "tx", "left_semi")
            if fresh.isEmpty():
                continue
            base = self.table(name)
            if strict and (bad := (unmatched(base, fresh, keys) if keys else overdrawn(base, fresh, columns, "seq")).first()):
                raise MatchError(f"change {bad['seq']} of {name} doesn't hit exactly one row")
            written[name] = self._write(apply_fold(base, fold(fresh, keys, columns), keys, columns) if keys else apply_signed(base, fresh, columns))
        return self._commit(state, tables={**state["tables"], **written}, applied=upto)


def replicate(changes: DataFrame, target: Target, name: str, keys: list[str], columns: list[str], checkpoint: str, *, strict: bool = False, available_now: bool = True):
    """Start the streaming query; a batch's rows are applied in ``seq`` order."""

    def batch(df: DataFrame, _: int) -> None:
        target.apply(name, df, keys, columns, strict=strict)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def envelopes_ok(envelopes: DataFrame) -> bool:
    """No gap and no conflicting repetition."""
    return sequence.gaps(envelopes).isEmpty() and sequence.conflicts(envelopes).isEmpty()
