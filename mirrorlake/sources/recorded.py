"""Streaming source of recorded frames: JSON lines in a folder, read by position.

It stands for a database's log behind the same interface: an offset is a position, a batch is the frames
between two, and a position that the source no longer has is an error, never a silent skip.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mirrorlake.model import ReplicationError

SCHEMA = "source_id string, seq long, xid long, action string, body string"
BATCH = 10_000


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class RecordedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("batch", BATCH))

    def _frames(self):
        uri = self.path if "://" in self.path else "file://" + self.path
        fs, root = pafs.FileSystem.from_uri(uri)
        for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
            if info.path.endswith(".jsonl"):
                with fs.open_input_stream(info.path) as f:
                    for line in f.read().splitlines():
                        yield json.loads(line)

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        return {"position": max((f["seq"] for f in self._frames()), default=0)}

    def partitions(self, start: dict, end: dict):
        first = min((f["seq"] for f in self._frames()), default=1)
        if start["position"] + 1 < first:
            raise ReplicationError(f"position {start['position']} is pruned, {first} is the first")
        a, b = start["position"] + 1, end["position"]
        return [_Range(i, min(b, i + self.batch - 1)) for i in range(a, b + 1, self.batch)]

    def read(self, partition):
        for f in self._frames():
            if partition.first <= f["seq"] <= partition.last:
                yield f["source_id"], f["seq"], f["xid"], f["action"], json.dumps(f.get("body"))

    def commit(self, end: dict) -> None:
        """Nothing is freed: what may go is decided by the published log position."""


class RecordedFrames(DataSource):
    @classmethod
    def name(cls):
        return "recorded_frames"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return RecordedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedFrames)
