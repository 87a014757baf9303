"""Column texts of source scans and names of source types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorlake.functions.values import quote_identifier
from mirrorlake.model import SchemaError

# The source's base types by the way they are written.
_HEX = ("binary", "varbinary", "image", "timestamp", "float", "real")
_MONEY = ("money", "smallmoney")
_TIMES = ("datetime", "smalldatetime", "datetime2", "date", "time", "datetimeoffset")
_SIZED = ("varchar", "nvarchar", "char", "nchar", "binary", "varbinary")
_TWO_BYTES = ("nvarchar", "nchar")
_DECIMALS = ("decimal", "numeric")
_SCALED = ("datetime2", "datetimeoffset", "time")
_PLAIN = (
    "bigint", "int", "smallint", "tinyint", "bit", "money", "smallmoney", "float", "real", "date", "datetime", "smalldatetime",
    "uniqueidentifier", "timestamp", "text", "ntext", "image", "xml",
)


def sqlserver_projection(name: str, base: str) -> str:
    """SQL that reads a column as text without loss: bytes and floating numbers as hex, money with four digits, times as ISO 8601."""
    column, style = quote_identifier("sqlserver", name), None
    if base in _HEX:
        column, style = f"CONVERT(varbinary(max),{column})", 2
    elif base in _MONEY:
        style = 2
    elif base in _TIMES:
        style = 126
    return f"CONVERT(nvarchar(max),{column}" + (")" if style is None else f",{style})")


def mysql_projection(name: str, *, binary: bool) -> str:
    """SQL that reads a column as text; bytes as 0x and hex digits, null as null."""
    column = quote_identifier("mysql", name)
    if binary:
        return f"IF({column} IS NULL,NULL,CONCAT('0x',HEX({column})))"
    return f"CAST({column} AS CHAR CHARACTER SET utf8mb4)"


def scan_query(engine: str, schema: str, table: str, columns: dict[str, str], key: list[str], *, after: bool = False) -> str:
    """The text of a snapshot scan in key order, for Spark's JDBC reader or a cursor; ``columns`` are names with base types.

    With ``after``, only rows past the key that is bound to the parameters.
    """
    if missing := [k for k in key if k not in columns]:
        raise SchemaError(f"key columns {missing} are no columns")
    if engine == "sqlserver":
        shown = [sqlserver_projection(c, t) for c, t in columns.items()]
    elif engine == "mysql":
        shown = [mysql_projection(c, binary="binary" in t or "blob" in t) for c, t in columns.items()]
    else:
        shown = [f"{quote_identifier(engine, c)}::text" for c in columns]
    text = f"SELECT {','.join(shown)} FROM {quote_identifier(engine, schema)}.{quote_identifier(engine, table)}"
    keys = [quote_identifier(engine, k) for k in key]
    if after and key:
        steps = [" AND ".join([*(f"{k}=?" for k in keys[:i]), f"{keys[i]}>?"]) for i in range(len(keys))]
        text += " WHERE " + " OR ".join(f"({s})" for s in steps)
    return text + (f" ORDER BY {','.join(keys)}" if key else "")


def type_name(base: Column, length: Column, precision: Column, scale: Column) -> Column:
    """The full name of a catalog's type; length is in bytes, -1 for max. Other types fail."""
    shown = lambda *parts: F.concat(base, F.lit("("), F.concat_ws(",", *[p.cast("string") for p in parts]), F.lit(")"))
    letters = F.when(base.isin(*_TWO_BYTES), F.floor(length / 2)).otherwise(length)
    return (
        F.when(base.isin(*_SIZED) & (length == -1), F.concat(base, F.lit("(max)")))
        .when(base.isin(*_SIZED), shown(letters))
        .when(base.isin(*_DECIMALS), shown(precision, scale))
        .when(base.isin(*_SCALED), shown(scale))
        .when(base.isin(*_PLAIN), base)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported type "), F.coalesce(base, F.lit("null")))).cast("string"))
    )
