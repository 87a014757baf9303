"""Canonical text and bytes of values: the base of digests and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(type_name: str, value: Column) -> Column:
    """Text that is equal for equal values, whichever database wrote it."""
    kind = type_name.strip().lower()
    if "binary" in kind or "blob" in kind or kind in ("bytea", "image", "rowversion"):
        digits = F.regexp_replace(value, r"^(\\x|0[xX])", "")
        return F.when(digits.rlike("^([0-9a-fA-F]{2})*$"), F.concat(F.lit("hex:"), F.lower(digits))).otherwise(value)
    if kind in ("boolean", "bool", "bit"):
        low = F.lower(value)
        return F.when(low.isin("1", "t", "true"), "true").when(low.isin("0", "f", "false"), "false").otherwise(value)
    if kind.startswith(("decimal", "numeric")):
        plain = value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
        powered = value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]{1,3}$")
        return F.when(plain, plain_decimal(value)).when(powered, plain_decimal(without_exponent(value))).otherwise(value)
    if kind in ("json", "jsonb"):
        return canonical_json(value)
    if "datetime" in kind or kind.startswith("timestamp"):
        return F.regexp_replace(value, "^([^T]*)T", "$1 ")
    if kind.startswith("character(") or kind.startswith("char("):
        return F.rtrim(value)  # blank padding carries no meaning
    return value


def without_exponent(value: Column) -> Column:
    """Decimal text with an exponent as text without one; exact."""
    sign = F.when(value.startswith("-"), "-").otherwise("")
    whole, part, power = (F.regexp_extract(value, r"^[+-]?([0-9]*)\.?([0-9]*)[eE]([+-]?[0-9]+)$", i) for i in (1, 2, 3))
    digits, point = F.concat(whole, part), F.length(whole) + power.cast("int")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits, F.repeat(F.lit("0"), F.greatest(point - F.length(digits), F.lit(0))))
    at = F.greatest(point, F.lit(0))
    return F.concat(sign, F.lit("0"), F.substr(padded, F.lit(1), at), F.lit("."), F.substr(padded, at + 1))


def canonical_json(value: Column) -> Column:
    """JSON with ordered names and without blanks; what is no JSON, or has a number that no double holds, stays as it is.

    The parser takes what follows a value for nothing, so the value is read as the one member of a list and of an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    alone = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))).isNotNull()
    text = F.to_json(F.try_variant_get(listed, "$[0]", "variant"))
    overflow = F.lit('"-?Infinity"')
    return F.when(alone & (F.regexp_count(text, overflow) <= F.regexp_count(value, overflow)), text).otherwise(value)


def plain_decimal(value: Column) -> Column:
    """Decimal text without sign of zero, plus sign, leading and trailing zeros; exact at any length."""
    body = F.regexp_replace(value, r"^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(body, r"\.([0-9]*)$", 1), "0+$", "")
    text = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(value.startswith("-") & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def part(value: Column) -> Column:
    """Bytes of text behind their length as 8 big-endian bytes."""
    data = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data)


def cell(value: Column) -> Column:
    """A value's part behind a mark, or eight FF bytes for null."""
    some = F.concat(part(F.lit("\x01")), part(value))
    return F.when(value.isNull(), F.unhex(F.lit("FF" * 8))).otherwise(some)


def encode_columns(types: dict[str, str], columns: dict[str, Column]) -> Column:
    """Names and canonical values, ordered by name."""
    pieces = [x for name in sorted(types) for x in (part(F.lit(name)), cell(canonical(types[name], columns[name])))]
    return F.concat(*pieces)


def row_hash(schema: str, table: str, types: dict[str, str], columns: dict[str, Column]) -> Column:
    """SHA-256 (hex) of schema, table and all columns."""
    return F.sha2(F.concat(part(F.lit(schema)), part(F.lit(table)), encode_columns(types, columns)), 256)


def identity_hash(types: dict[str, str], columns: dict[str, Column]) -> Column:
    """SHA-256 (hex) of the identity columns."""
    return F.sha2(encode_columns(types, columns), 256)
