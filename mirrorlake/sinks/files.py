"""File changes into a folder or an object store, written by the executors.

The last change of every path decides, so a batch may come whole again and a repeated task
attempt writes the same file once more. All paths are checked before anything is written. In a
folder a file gets a draft name first, is synced, given its mode and time and renamed, so no
reader sees part of it; an object store shows an object only when it is whole.

Defined results: an empty batch writes nothing; deleting a path that isn't there is no error;
null content is an empty file; a file whose bytes don't match a given sha256 fails the job.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.model import ReplicationError
from mirrorlake.operators.files import safe_path

DRAFTS = ".incoming"
_COLUMNS = ("path", "operation", "content", "sha256", "mode", "mod_time_unix_nano")


def object_name(prefix: str, path: str) -> str:
    return "/".join(x for x in (prefix.strip("/"), path) if x)


def _sync(folder: str) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


class Folder:
    """A folder that every executor mounts."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def _place(self, name: str) -> str:
        place = os.path.join(self.root, name)
        if os.path.commonpath([self.root, os.path.realpath(os.path.dirname(place))]) != self.root:
            raise ReplicationError("a link leads out of the folder")
        return place

    def put(self, name: str, content: bytes, mode: int | None, mod_time: int | None) -> None:
        place = self._place(name)
        drafts = os.path.join(self.root, DRAFTS)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        os.makedirs(drafts, mode=0o700, exist_ok=True)
        draft = os.path.join(drafts, uuid.uuid4().hex)
        try:
            with open(draft, "xb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            if mode is not None:
                os.chmod(draft, mode & 0o777)
            if mod_time is not None:
                os.utime(draft, ns=(mod_time, mod_time))
            os.replace(draft, place)
            _sync(os.path.dirname(place))
        finally:
            if os.path.exists(draft):
                os.unlink(draft)

    def delete(self, name: str) -> None:
        place = self._place(name)
        if os.path.lexists(place):
            os.unlink(place)
            _sync(os.path.dirname(place))


class Objects:
    """A bucket of an object store, or any other file system that pyarrow knows."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def put(self, name: str, content: bytes, mode: int | None, mod_time: int | None) -> None:
        facts = {"mode": mode, "mod-time-unix-nano": mod_time}
        with self.fs.open_output_stream(f"{self.root}/{name}", compression=None, metadata={k: str(v) for k, v in facts.items() if v is not None}) as f:
            f.write(content)

    def delete(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File:
            self.fs.delete_file(f"{self.root}/{name}")


def store(target: str) -> Folder | Objects:
    if target.startswith("file:"):
        return Folder(unquote(urlsplit(target).path))
    return Objects(target) if "://" in target else Folder(target)


def latest_changes(changes: DataFrame, order: str) -> DataFrame:
    """The last change of each path; contents take part in a join at most, in no aggregate."""
    last = changes.groupBy("path").agg(F.max(order).alias(order))
    return changes.join(last, ["path", order], "left_semi")


def write_files(changes: DataFrame, target: str, *, prefix: str = "", order: str | None = None) -> dict[str, int]:
    """Apply file changes (path, operation, content; sha256, mode and mod_time_unix_nano if there) to ``target``.

    Returns the number of files put and deleted. ``order`` is needed where a path may change more than once.
    """
    ok = F.coalesce(safe_path(F.col("path")), F.lit(False)) & ~F.col("path").rlike(rf"^(\./)*{DRAFTS.replace('.', '[.]')}(/|$)")
    if not changes.where(~F.coalesce(ok, F.lit(False))).isEmpty():
        raise ReplicationError("a file path is empty, unsafe or reserved")
    kept = latest_changes(changes, order) if order else changes
    absent = {c: kind for c, kind in (("sha256", "string"), ("mode", "int"), ("mod_time_unix_nano", "long")) if c not in changes.columns}
    rows = kept.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items()}).select(*_COLUMNS)

    def run(batches):
        place = store(target)
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                path, operation, content, digest, mode, mod_time = (batch.column(c)[i].as_py() for c in _COLUMNS)
                name = object_name(prefix, path)
                if operation == "delete":
                    place.delete(name)
                else:
                    content = content or b""
                    if digest is not None and hashlib.sha256(content).hexdigest() != digest:
                        raise ReplicationError("a file doesn't match its hash")
                    place.put(name, content, mode, mod_time)
                done.append("delete" if operation == "delete" else "put")
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["done"])

    counts = rows.mapInArrow(run, "done string").groupBy("done").count().collect()  # two rows at most
    return {"put": 0, "delete": 0} | {r["done"]: r["count"] for r in counts}
