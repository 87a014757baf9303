"""Order-independent, duplicate-sensitive bucket digests of tables, and their comparison.

A row hash is eight 32-bit limbs. A bucket keeps the count, the XOR of the limbs and their sums;
all three combine before the shuffle. Sums of limbs are exact up to 2^31 rows a bucket; carries are
propagated once, at the end. Buckets come from the identity hash, so rows spread evenly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorlake.functions.canonical import identity_hash, row_hash

LIMBS = 8


def bucket_of(hash_hex, buckets: int):
    """First 8 bytes, big-endian, modulo the number of buckets."""
    return (F.conv(F.substring(hash_hex, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(buckets).cast("decimal(20,0)")).cast("int")


def hashed(df: DataFrame, schema: str, table: str, types: dict[str, str], key: list[str], buckets: int) -> DataFrame:
    """(bucket, h): the row hash in hex. An empty key means the whole row."""
    columns = {c: F.col(c).cast("string") for c in types}
    identity = {c: types[c] for c in (key or types)}
    return df.select(bucket_of(identity_hash(identity, columns), buckets).alias("bucket"), row_hash(schema, table, types, columns).alias("h"))


def bucket_state(rows: DataFrame) -> DataFrame:
    """bucket, rows, x0..x7 (XOR) and s0..s7 (sums) of the limbs."""
    limb = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), *[F.bit_xor(limb(i)).alias(f"x{i}") for i in range(LIMBS)], *[F.sum(limb(i)).alias(f"s{i}") for i in range(LIMBS)]
    )


def finish(state: DataFrame) -> DataFrame:
    """bucket, rows, digest: SHA-256 of count, XOR and sum modulo 2^256."""
    word = lambda c, n: F.lpad(F.hex(c), n, "0")
    carry, limbs = F.lit(0).cast("long"), []
    for i in reversed(range(LIMBS)):
        total = F.col(f"s{i}") + carry
        limbs.append(F.pmod(total, F.lit(4294967296)))
        carry = F.floor(total / F.lit(4294967296).cast("decimal(20,0)")).cast("long")
    text = F.concat(word(F.col("rows"), 16), *[word(F.col(f"x{i}"), 8) for i in range(LIMBS)], *[word(x, 8) for x in reversed(limbs)])
    return state.select("bucket", "rows", F.sha2(F.unhex(text), 256).alias("digest"))


def digest(df: DataFrame, schema: str, table: str, types: dict[str, str], key: list[str], buckets: int) -> DataFrame:
    """A row for each of the buckets, the empty ones too."""
    state = bucket_state(hashed(df, schema, table, types, key, buckets))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(state, "bucket", "left").fillna(0, [c for c in state.columns if c != "bucket"])
    return finish(filled)


def compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """Buckets whose digests differ or that one side lacks."""
    s = source.select("bucket", F.col("rows").alias("source_rows"), F.col("digest").alias("source_digest"))
    t = target.select("bucket", F.col("rows").alias("target_rows"), F.col("digest").alias("target_digest"))
    return s.join(t, "bucket", "full_outer").where(~F.col("source_digest").eqNullSafe(F.col("target_digest")))


def mismatches(source: DataFrame, target: DataFrame) -> int:
    return compare(source, target).count()


def verdict(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: matches, and how many buckets differ, compared place by place; of lists of different length, the longer one's buckets.

    A list has one row for each bucket, so the window's single task holds no more than their number.
    """
    place = F.row_number().over(Window.orderBy("bucket")).alias("place")
    s, t = (df.select(place, F.struct("bucket", "rows", "digest").alias(side)) for df, side in ((source, "s"), (target, "t")))
    counted = s.join(t, "place", "full_outer").agg(F.count("s").alias("n"), F.count("t").alias("m"), F.count_if(~F.col("s").eqNullSafe(F.col("t"))).alias("differ"))
    found = F.when(F.col("n") != F.col("m"), F.greatest("n", "m")).otherwise(F.col("differ"))
    return counted.select((found == 0).alias("matches"), found.alias("mismatches"))


def drifted_rows(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side only, as multisets; meant for the mismatched buckets."""
    signed = reduce(DataFrame.unionByName, [df.select(*columns, F.lit(n).alias("_n")) for df, n in ((source, 1), (target, -1))])
    return signed.groupBy(*columns).agg(F.sum("_n").alias("excess")).where("excess <> 0")
