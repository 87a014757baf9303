"""Values of sources as text, text as typed values, names as identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.functions.typemap import spark_type
from mirrorlake.model import SchemaError

_QUOTES = {"postgres": '""', "mysql": "``", "sqlserver": "[]"}


def payload_hash(raw: Column) -> Column:
    """SHA-256 (hex) of a message as it came."""
    return F.sha2(raw.cast("binary"), 256)


def quote_identifier(engine: str, name: str) -> str:
    """A name as the engine's quoted identifier; the closing sign inside is doubled."""
    first, last = _QUOTES[engine]
    if not name or "\x00" in name:
        raise SchemaError(f"{name!r} is no identifier")
    return first + name.replace(last, last * 2) + last


def mysql_text(value: Column, kind: T.DataType, *, binary: bool = False) -> Column:
    """A column value as text: binary as 0x and hex digits, times in UTC, whole floating numbers without a point."""
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("0x"), F.lower(F.hex(value))) if binary else value.cast("string")
    if isinstance(kind, T.TimestampType):
        return F.regexp_replace(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def unsigned(value: Column) -> Column:
    """A 64-bit number read as unsigned, exactly."""
    exact = value.cast("decimal(20,0)")
    return F.when(value < 0, exact + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(exact).cast("decimal(20,0)")


def typed(rows: DataFrame, types: dict[str, str], *, file_columns: tuple[str, ...] = ()) -> DataFrame:
    """Text columns cast to the target's types; a value that doesn't fit fails the job.

    0x and hex digits become bytes. A column that the target lacks, or file content for a column that isn't bytea, is refused at once.
    """
    out = []
    for name in rows.columns:
        if name not in types:
            raise SchemaError(f"the target has no column {name!r}")
        if name in file_columns:
            if types[name] != "bytea":
                raise SchemaError(f"file content column {name!r} must be bytea")
            out.append(F.col(name).cast("binary").alias(name))
        elif types[name] == "bytea":
            digits = F.substr(F.col(name), F.lit(3))
            good = digits.rlike("^([0-9a-fA-F]{2})*$")
            data = F.when(good, F.unhex(digits)).otherwise(F.raise_error(F.lit(f"invalid binary value for {name}")).cast("binary"))
            out.append(F.when(F.col(name).startswith("0x"), data).otherwise(F.col(name).cast("binary")).alias(name))
        else:
            out.append(F.col(name).cast(spark_type(types[name])).alias(name))
    return rows.select(*out)


def lsn_after(lsn: Column, other: Column) -> Column:
    """Whether a binary position comes after another: bytes are compared as unsigned, from the first."""
    return lsn.cast("binary") > other.cast("binary")


def nonnegative(value: Column) -> Column:
    """Health figures: no number or a negative one counts as 0."""
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (value < 0), F.lit(0).cast("double")).otherwise(value.cast("double"))
