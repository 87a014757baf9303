"""Source records to row changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A decoder frame's column and record; fixed names.
COLUMN = "struct<name: string, type: string, typeoid: bigint, value: string>"
FRAME = f"struct<action: string, xid: bigint, lsn: string, nextlsn: string, schema: string, table: string, columns: array<{COLUMN}>, identity: array<{COLUMN}>>"
# Type numbers of boolean and bytea; fixed values.
BOOLEAN, BYTEA = 16, 17


def parse_frames(lines: DataFrame, column: str = "value", *, max_bytes: int = 32 << 20) -> DataFrame:
    """Decoder frames, one JSON object a row; a broken or oversized one fails the job. Values are text (quoted)."""
    limit = F.when(F.octet_length(column) > max_bytes, F.raise_error(F.lit("frame is too large"))).otherwise(F.col(column))
    parsed = F.from_json(limit, FRAME, {"mode": "FAILFAST"})
    return lines.select(*[c for c in lines.columns if c != column], parsed.alias("f")).select(*[c for c in lines.columns if c != column], "f.*")


def split_frames(texts: DataFrame, column: str = "value") -> DataFrame:
    """Several JSON objects in one text, with numbers kept as they are written: Arrow-batched, one object a row.

    No built-in splits a stream of JSON objects or keeps a number's digits.
    """
    import json

    import pyarrow as pa

    def run(batches):
        decoder = json.JSONDecoder(parse_float=str, parse_int=str)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                at = 0
                while text is not None and at < len(text):
                    if text[at].isspace():
                        at += 1
                        continue
                    found, at = decoder.raw_decode(text, at)
                    out.append(json.dumps(found))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], [column])

    return texts.select(column).mapInArrow(run, f"{column} string")


def pg_value(c: Column) -> Column:
    """Value text: booleans spelled out, byte strings with their prefix."""
    v = c["value"]
    plain = F.when((c["typeoid"] == BOOLEAN) & v.isin("t", "f"), F.when(v == "t", "true").otherwise("false"))
    return F.when(c["typeoid"].isin(BOOLEAN), F.coalesce(plain, v)).when((c["typeoid"] == BYTEA) & ~v.startswith("\\x"), F.concat(F.lit("\\x"), v)).otherwise(v)


def pg_rows(frames: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Row changes of insert, update and delete frames; ``keys`` names the key columns of ``schema.table`` (none: full row).

    op, key and old_key (maps of text), columns (map of text: absent stays, null is null), identity.
    """
    table = F.concat_ws(".", "schema", "table")
    names = F.lit(None).cast("array<string>")
    for t, k in keys.items():
        names = F.when(table == t, F.array(*[F.lit(x) for x in k]) if k else F.array().cast("array<string>")).otherwise(names)
    as_map = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(f"array<{COLUMN}>")), lambda x: F.struct(x["name"], pg_value(x))))
    known = F.when(names.isNull(), F.raise_error(F.concat(F.lit("unknown table "), table))).otherwise(names)
    rows = frames.where(F.col("action").isin("I", "U", "D")).select(
        *[c for c in frames.columns if c not in ("columns", "identity")], known.alias("_keys"), as_map(F.col("columns")).alias("_new"), as_map(F.col("identity")).alias("_old")
    )
    full = F.size("_keys") == 0
    op = F.when(F.col("action") == "I", "insert").when(F.col("action") == "U", "update").otherwise("delete")
    only = lambda m: F.map_filter(m, lambda k, _: F.array_contains("_keys", k))
    completed = F.when(full & (op == "update"), F.map_concat(F.map_filter("_old", lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))).otherwise(F.col("_new"))
    image = F.when(op == "delete", F.col("_old")).otherwise(completed)
    key = F.when(full, image).otherwise(F.when((op == "update") & (F.size(only(F.col("_new"))) == 0), only(F.col("_old"))).otherwise(only(image)))
    old = F.when(op == "update", F.when(full, F.col("_old")).otherwise(F.when(F.size(only(F.col("_old"))) > 0, only(F.col("_old")))))
    out = rows.select(
        *[c for c in rows.columns if not c.startswith("_")], op.alias("op"), F.when(full, "full_row").alias("identity"),
        key.alias("key"), old.alias("old_key"), F.when(op != "delete", F.col("_new")).alias("columns"),
    )
    bad = F.exists(F.map_values("key"), lambda v: v.isNull()) & F.col("identity").isNull()
    return out.withColumn("key", F.when(bad, F.raise_error(F.lit("a key value is null"))).otherwise(F.col("key")))


def image_rows(images: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Row events with before and after arrays in table order to op, old_key, key and columns."""
    as_map = lambda c, which: F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in columns]), c), lambda k, _: k.isin(which))
    arity = lambda c: F.when(F.col(c).isNotNull() & (F.size(c) != len(columns)), F.raise_error(F.lit("row image has another number of columns"))).otherwise(F.col(c))
    which = keys or columns
    return images.select(
        *[c for c in images.columns if c not in ("before", "after")],
        F.when(F.col("before").isNotNull(), as_map(arity("before"), which)).alias("old_key"),
        as_map(F.coalesce(arity("after"), F.col("before")), which).alias("key"),
        F.when(F.col("after").isNotNull(), as_map(F.col("after"), columns)).alias("columns"),
    )
