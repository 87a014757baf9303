"""The durable log: append-only Parquet folders and an atomic manifest.

Writers put data folders in place first; only the exclusive creation of the next manifest file makes
them visible. What no manifest names does not exist, so recovery is nothing but ignoring it. Invariant:
delivered <= ready <= next.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.model import MESSAGE, ReplicationError, SequenceError, TransientError


@dataclass(frozen=True)
class State:
    number: int = 0
    generation: str = ""
    fingerprint: str = ""
    schema_hash: str = ""
    phase: str = "new"
    durable: str = ""
    next_seq: int = 0
    ready_seq: int = 0
    delivered_seq: int = 0
    earliest_seq: int = 1
    cleanup_token: str = ""
    folders: tuple = ()  # (folder, first seq, last seq, bytes)
    extra: dict = field(default_factory=dict)


class Manifests:
    """Numbered JSON files; creating one that is there already fails, which also keeps a second writer out."""

    def __init__(self, root: str):
        uri = root if "://" in root else "file://" + root.removeprefix("file:")
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.root = root
        self.fs.create_dir(f"{self.path}/manifests", recursive=True)

    def latest(self) -> dict | None:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/manifests"))
        names = sorted(i.base_name for i in found if i.base_name.endswith(".json"))
        if not names:
            return None
        with self.fs.open_input_stream(f"{self.path}/manifests/{names[-1]}") as f:
            return json.loads(f.read())

    def written(self, folder: str) -> float:
        """When a data folder was put in place, in seconds."""
        path = folder.split("://", 1)[-1].removeprefix("file:")
        return self.fs.get_file_info(path).mtime.timestamp()

    def commit(self, number: int, content: dict) -> None:
        name = f"{self.path}/manifests/{number:012d}.json"
        if self.fs.get_file_info(name).type != pafs.FileType.NotFound:
            raise TransientError(f"manifest {number} was committed by another writer")
        draft = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(content, default=str).encode())
        if isinstance(self.fs, pafs.LocalFileSystem):
            try:
                os.link(draft, name)  # fails where the name is taken, whoever comes at the same time
            except FileExistsError:
                raise TransientError(f"manifest {number} was committed by another writer") from None
            finally:
                os.unlink(draft)
        elif isinstance(self.fs, pafs.HadoopFileSystem):
            try:
                self.fs.move(draft, name)  # a rename there doesn't replace
            except OSError:
                raise TransientError(f"manifest {number} was committed by another writer") from None
        else:
            raise ReplicationError(f"{self.fs.type_name} can't create a manifest exclusively")


class Log:
    """One source's message log."""

    def __init__(self, spark: SparkSession, root: str, *, max_bytes: int = 10 << 30):
        self.spark, self.root, self.max_bytes = spark, root.rstrip("/"), max_bytes
        self.manifests = Manifests(self.root)
        self._staged: list[tuple[str, int, int, int]] = []
        self._next = self.state().next_seq

    def state(self) -> State:
        found = self.manifests.latest()
        if not found:
            return State()
        return State(**{**found, "folders": tuple(tuple(x) for x in found["folders"])})

    def _commit(self, state: State) -> State:
        if not state.delivered_seq <= state.ready_seq <= state.next_seq:
            raise ReplicationError("delivered <= ready <= next is broken")
        state = replace(state, number=state.number + 1)
        self.manifests.commit(state.number, asdict(state))
        return state

    def initialise(self, generation: str, fingerprint: str) -> State:
        """Start, or start a new generation; the old one must be delivered wholly."""
        s = self.state()
        if s.fingerprint and s.fingerprint != fingerprint:
            raise ReplicationError("the log belongs to another capture")
        if s.delivered_seq != s.ready_seq or self._staged:
            raise ReplicationError("the log isn't drained")
        self._next = 0
        return self._commit(State(number=s.number, generation=generation, fingerprint=fingerprint, phase="snapshot"))

    def append(self, messages: DataFrame) -> int:
        """Stage messages (without seq, ordered by ``_order``); invisible until ``publish``."""
        s = self.state()
        used = sum(f[3] for f in s.folders) + sum(f[3] for f in self._staged)
        if used > self.max_bytes:
            raise TransientError("the log is full") if s.delivered_seq < s.ready_seq else ReplicationError("the log is full and nothing is left to deliver")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # one batch of envelopes: numbering it needs its order
        numbered = messages.selectExpr("*", f"row_number() OVER (ORDER BY _order) + {self._next} AS seq").drop("_order")
        full = numbered.withColumns(
            {"generation": F.lit(s.generation), "message_id": F.concat_ws("/", "source_id", F.lit(s.generation), "seq"), "version": F.coalesce("version", F.lit("1")) if "version" in numbered.columns else F.lit("1")}
        )
        full = full.select(*[(F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE.fields])
        full.write.parquet(folder)
        back = self.spark.read.schema(MESSAGE).parquet(folder).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
        n = back[0]
        if n:
            self._staged.append((folder, self._next + 1, self._next + n, int(back[1] or 0)))
            self._next += n
        return n

    def publish(self, durable: str = "", *, phase: str | None = None, cleanup_token: str = "") -> State:
        """Make everything staged visible and move the durable position, in one step."""
        s = self.state()
        s = self._commit(
            replace(s, folders=s.folders + tuple(self._staged), next_seq=self._next, ready_seq=self._next, durable=durable or s.durable, phase=phase or s.phase, cleanup_token=cleanup_token)
        )
        self._staged = []
        return s

    def recover(self) -> State:
        """Forget what was staged and not published."""
        self._staged = []
        self._next = self.state().next_seq
        return self.state()

    def acknowledge(self, seq: int, message_id: str) -> State:
        s = self.state()
        row = self.read(seq, seq).select("message_id").first()
        if seq != s.delivered_seq + 1 or seq > s.ready_seq or row is None or row[0] != message_id:
            raise SequenceError(f"acknowledgement of {seq} after {s.delivered_seq}")
        return self._commit(replace(s, delivered_seq=seq))

    def acknowledge_through(self, seq: int) -> State:
        s = self.state()
        if not s.delivered_seq <= seq <= s.ready_seq:
            raise SequenceError(f"acknowledgement through {seq} after {s.delivered_seq} of {s.ready_seq}")
        return self._commit(replace(s, delivered_seq=seq))

    def backfill_lsn(self, lsn: str) -> int:
        """Give a snapshot's staged messages the position of its boundary; published ones are not touched. How many folders."""
        staged = []
        for folder, first, last, size in self._staged:
            moved = f"{self.root}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(MESSAGE).parquet(folder).withColumn("lsn", F.lit(lsn)).write.parquet(moved)
            staged.append((moved, first, last, size))
        self._staged = staged
        return len(staged)

    def publish_schema(self, durable: str, schema_hash: str) -> State:
        """Publish what is staged with the durable position and the schema's hash, in one step."""
        if not schema_hash:
            raise ReplicationError("a schema has a hash")
        s = self.state()
        s = self._commit(replace(s, folders=s.folders + tuple(self._staged), next_seq=self._next, ready_seq=self._next, durable=durable, schema_hash=schema_hash))
        self._staged = []
        return s

    def clear_cleanup(self, token: str) -> State:
        """Forget the source clean-up that is done; another token than the one kept is refused."""
        s = self.state()
        if s.cleanup_token != token:
            raise ReplicationError("another clean-up is pending")
        return self._commit(replace(s, cleanup_token=""))

    def authorize_repair(self) -> State:
        """Allow one repair of the target."""
        return self._commit(replace(self.state(), extra={**self.state().extra, "repair_authorized": True}))

    def consume_repair_authorization(self) -> bool:
        """If a repair was allowed; the permission is gone then. Of two that ask at once, one gets it, as manifests are exclusive."""
        s = self.state()
        if not s.extra.get("repair_authorized"):
            return False
        self._commit(replace(s, extra={k: v for k, v in s.extra.items() if k != "repair_authorized"}))
        return True

    def evict(self, *, max_archive_bytes: int, max_age_seconds: float | None = None, now: float | None = None) -> State:
        """Drop the oldest wholly delivered folders while the archive is too large or they are too old."""
        s = self.state()
        folders = list(s.folders)
        done = sum(f[3] for f in folders if f[2] <= s.delivered_seq)
        oldest = None if max_age_seconds is None else (time.time() if now is None else now) - max_age_seconds

        def old(folder: str) -> bool:
            if oldest is None:
                return False
            return self.manifests.written(folder) < oldest

        while folders and folders[0][2] <= s.delivered_seq and (done > max_archive_bytes or old(folders[0][0])):
            done -= folders.pop(0)[3]
        return self._commit(replace(s, folders=tuple(folders), earliest_seq=folders[0][1] if folders else s.next_seq + 1))

    def read(self, first: int = 1, last: int | None = None) -> DataFrame:
        """Published messages; folders out of range are not opened."""
        s = self.state()
        last = s.ready_seq if last is None else min(last, s.ready_seq)
        if first < s.earliest_seq and first <= last and s.earliest_seq > 1:
            raise SequenceError(f"seq {first} is not kept any longer, {s.earliest_seq} is the first")
        names = [f[0] for f in s.folders if f[2] >= first and f[1] <= last]
        if not names:
            return self.spark.createDataFrame([], MESSAGE)
        return self.spark.read.schema(MESSAGE).parquet(*names).where(F.col("seq").between(first, last))
