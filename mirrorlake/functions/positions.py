"""Log positions as text that sorts, and update masks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pg_position(text: Column) -> Column:
    """``X/Y`` in hex as one exact number."""
    part = lambda k: F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast("decimal(20,0)")
    return (part(1) * F.lit(4294967296).cast("decimal(20,0)") + part(2)).cast("decimal(38,0)")


def mysql_position(file: Column, offset: Column) -> Column:
    return F.concat(F.lit("mysql:v1:"), F.translate(F.rtrim(F.base64(file.cast("binary"))), "+/=", "-_"), F.lit(":"), F.lpad(offset.cast("string"), 20, "0"))


def parse_mysql_position(text: Column) -> tuple[Column, Column]:
    """File name and offset."""
    coded = F.translate(F.split_part(text, F.lit(":"), F.lit(3)), "-_", "+/")
    padded = F.rpad(coded, F.ceil(F.length(coded) / 4).cast("int") * 4, "=")
    return F.unbase64(padded).cast("string"), F.split_part(text, F.lit(":"), F.lit(4)).cast("decimal(20,0)")


def counter_position(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.lpad(number.cast("string"), 20, "0"))


def mssql_position(data: Column) -> Column:
    """Ten bytes as ``0x`` and upper-case hex."""
    return F.concat(F.lit("0x"), F.hex(data))


def mask_changed(mask_hex: Column, ordinal: Column) -> Column:
    """Is the bit of a 1-based column ordinal set in an update mask, its last byte first? False out of range."""
    size = (F.length(mask_hex) / 2).cast("int")
    byte = F.floor((ordinal - 1) / 8).cast("int")
    text = F.substring(mask_hex, 2 * (size - byte) - 1, F.lit(2))
    value = F.conv(text, 16, 10).cast("int")
    inside = (ordinal >= 1) & (byte < size)
    return F.when(inside, F.coalesce(F.shiftright(value, 0).bitwiseAND(F.pow(F.lit(2), F.pmod(ordinal - 1, F.lit(8))).cast("int")) != 0, F.lit(False))).otherwise(False)


def ieee_text(hex_text: Column) -> Column:
    """Shortest decimal text of IEEE bytes in hex, 4 or 8 of them. Arrow-batched: no built-in reads IEEE bytes."""
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        import struct

        import numpy as np

        def one(x):
            if x is None:
                return None
            data = bytes.fromhex(x)
            if len(data) == 4:
                return str(np.float32(struct.unpack(">f", data)[0]))
            return repr(struct.unpack(">d", data)[0])

        return values.map(one)

    return decode(hex_text)
