"""Schema versions: hash, completeness, and the additions a target takes by itself."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.functions.typemap import spark_type, target_type
from mirrorlake.model import SchemaError


def schema_hash(tables: list[dict]) -> str:
    """SHA-256 of the tables, ordered by schema and name, as canonical JSON."""
    ordered = sorted(tables, key=lambda t: (t.get("schema", ""), t["name"]))
    return hashlib.sha256(json.dumps(ordered, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def added_columns(old: dict, new: dict, *, engine: str, allow: bool = True) -> dict[str, str]:
    """Columns that ``new`` has beyond ``old``, with target types; anything but added nullable non-key columns is an error."""
    before = {c["name"]: c for c in old["columns"]}
    after = {c["name"]: c for c in new["columns"]}
    if len(after) != len(new["columns"]):
        raise SchemaError("a column name repeats")
    gone = [c for c in before if c not in after]
    changed = [c for c in before if c in after and (before[c]["type"], bool(before[c].get("primary_key"))) != (after[c]["type"], bool(after[c].get("primary_key")))]
    if gone or changed:
        raise SchemaError(f"columns removed: {gone}, changed: {changed}")
    out = {}
    for name, c in after.items():
        if name in before:
            continue
        if not allow:
            raise SchemaError(f"column {name!r} is new and additions are off")
        if c.get("primary_key") or c.get("not_null"):
            raise SchemaError(f"column {name!r} is new and part of the key or not nullable")
        out[name] = target_type(engine, c["type"])
    return out


def add_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with new columns, null in the rows there."""
    return table.select("*", *[F.lit(None).cast(spark_type(t)).alias(n) for n, t in columns.items()])


def check_complete(configured: set[tuple[str, str]], sent: set[tuple[str, str]]) -> None:
    if configured != sent:
        raise SchemaError(f"schema set lacks {sorted(configured - sent)}, has besides {sorted(sent - configured)}")


def incomplete(configured: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Tables that were sent but not configured (``extra``), or configured but not sent (``missing``)."""
    a, b = configured.select(*keys).distinct(), sent.select(*keys).distinct()
    extra = b.join(a, keys, "left_anti").select(*keys, F.lit(True).alias("extra"), F.lit(False).alias("missing"))
    return extra.unionByName(a.join(b, keys, "left_anti").select(*keys, F.lit(False).alias("extra"), F.lit(True).alias("missing")))
