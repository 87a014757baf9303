"""The change protocol: column values, row changes, file changes and messages.

Values travel as text. A column that is absent from a change keeps its old value; a column
whose value is null becomes null.
"""

from __future__ import annotations

from pyspark.sql import types as T

COLUMN = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "value", "encoding", "source_value")])
ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("identity", "schema", "table", "operation")]
    + [T.StructField("ordinal", T.LongType())]
    + [T.StructField(n, T.ArrayType(COLUMN)) for n in ("key", "old_key", "columns")]
)
TABLE = T.StructType([T.StructField("schema", T.StringType()), T.StructField("name", T.StringType())])
FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time_unix_nano", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("chunks", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("generation", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("transaction", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("lsn", T.StringType()),
        T.StructField("tables", T.ArrayType(TABLE)),
        T.StructField("schema", T.StringType()),
        T.StructField("rows", T.ArrayType(ROW)),
        T.StructField("file", FILE),
        T.StructField("created_at", T.StringType()),
    ]
)

# Message kinds and row operations of the protocol; fixed values.
KINDS = (
    "snapshot_begin", "schema", "schema_end", "snapshot_rows", "snapshot_end",
    "transaction_rows", "transaction_end", "file_begin", "file_chunk", "file_end", "file_delete",
)
OPERATIONS = ("read", "insert", "update", "delete")
#: Kinds after which everything received so far is applied.
TERMINAL = ("snapshot_end", "transaction_end", "schema_end", "file_end", "file_delete")


class ReplicationError(Exception):
    """A defect of the stream or the target that a retry can't mend."""


class SequenceError(ReplicationError):
    """A gap, a conflicting repetition or a message out of its place."""


class MatchError(ReplicationError):
    """A change that doesn't hit exactly one row."""


class SchemaError(ReplicationError):
    """A schema that the target can't take."""


class TransientError(Exception):
    """A failure that a later attempt may not meet."""
