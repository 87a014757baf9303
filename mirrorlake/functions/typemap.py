"""Source column types to target and Spark types; the list of what may be added to a table."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from mirrorlake.model import SchemaError

# Target types without parameters and their Spark types; fixed values.
_PLAIN = {
    "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(), "real": T.FloatType(), "double precision": T.DoubleType(),
    "boolean": T.BooleanType(), "text": T.StringType(), "bytea": T.BinaryType(), "date": T.DateType(), "uuid": T.StringType(),
    "json": T.StringType(), "jsonb": T.StringType(), "timestamp": T.TimestampNTZType(), "time": T.StringType(),
}
# MySQL base types; fixed values.
_MYSQL = {
    "tinyint": "smallint", "smallint": "smallint", "mediumint": "integer", "int": "integer", "integer": "integer", "bigint": "bigint",
    "float": "real", "double": "double precision", "tinytext": "text", "text": "text", "mediumtext": "text", "longtext": "text",
    "tinyblob": "bytea", "blob": "bytea", "mediumblob": "bytea", "longblob": "bytea", "binary": "bytea", "varbinary": "bytea",
    "date": "date", "datetime": "timestamp without time zone", "timestamp": "timestamp without time zone", "time": "time without time zone", "json": "jsonb",
}
# SQL Server base types; fixed values.
_MSSQL = {
    "tinyint": "smallint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "bit": "boolean", "real": "real", "float": "double precision",
    "char": "text", "nchar": "text", "varchar": "text", "nvarchar": "text", "text": "text", "ntext": "text",
    "binary": "bytea", "varbinary": "bytea", "image": "bytea", "timestamp": "bytea", "rowversion": "bytea",
    "money": "numeric(19,4)", "smallmoney": "numeric(10,4)", "uniqueidentifier": "uuid",
    "date": "date", "datetime": "timestamp without time zone", "datetime2": "timestamp without time zone", "smalldatetime": "timestamp without time zone",
    "time": "time without time zone",
}
_ARGS = re.compile(r"^([a-z0-9 ]+?)\s*(?:\(([^)]*)\))?( unsigned)?$")
_ZONED = re.compile(r"^(timestamp|time)(?:\([0-6]\))? (with|without) time zone$")


def target_type(engine: str, type_name: str) -> str:
    """The target type of a source type; SchemaError for one that may not be added by itself."""
    name = type_name.strip().lower()
    if engine == "postgres" and (m := _ZONED.match(name)):
        return name
    m = _ARGS.match(name)
    if not m:
        raise SchemaError(f"type {type_name!r} of {engine} has no safe target type")
    base, args, unsigned = m[1], m[2], bool(m[3])
    if base in ("decimal", "numeric"):
        if args is None:
            return "numeric"
        p, _, s = args.partition(",")
        if not (p.strip().isdigit() and (not s or s.strip().isdigit()) and 1 <= int(p) <= 1000 and int(s or 0) <= int(p)):
            raise SchemaError(f"type {type_name!r} is out of range")
        return f"numeric({int(p)},{int(s or 0)})"
    if engine == "mysql" and base in ("char", "varchar") or engine == "postgres" and base in ("character", "character varying"):
        long = {"char": "character", "varchar": "character varying"}.get(base, base)
        if not args or not args.isdigit() or int(args) < 1:
            raise SchemaError(f"type {type_name!r} needs a length")
        return f"{long}({int(args)})"
    if engine == "mysql" and unsigned and base in ("int", "integer", "bigint"):
        return "numeric(20,0)"  # signed types don't hold them all
    found = {"mysql": _MYSQL, "sqlserver": _MSSQL, "postgres": {k: k for k in _PLAIN if k not in ("timestamp", "time")}}.get(engine, {}).get(base)
    if found is None:
        raise SchemaError(f"type {type_name!r} of {engine} has no safe target type")
    return found


def spark_type(target: str) -> T.DataType:
    """The Spark type of a target type; decimals beyond 38 digits stay text."""
    name = target.lower()
    if name.startswith("numeric"):
        m = re.match(r"numeric\((\d+),(\d+)\)", name)
        return T.DecimalType(int(m[1]), int(m[2])) if m and int(m[1]) <= 38 else T.StringType()
    if name.startswith("character"):
        return T.StringType()
    if m := _ZONED.match(name):
        return T.StringType() if m[1] == "time" else T.TimestampType() if m[2] == "with" else T.TimestampNTZType()
    if name not in _PLAIN:
        raise SchemaError(f"unknown target type {target!r}")
    return _PLAIN[name]
