"""A deterministic change log derived from the events table, and the tables it applies to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.deploy import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, tx, key, op, acctbal and segment with set flags: signup inserts, error deletes, others update."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.floor(F.col("event_id") / 10).alias("tx"),
        F.col("user_id").alias("key"),
        op.alias("op"),
        F.when(F.col("event_id") % 7 != 0, F.col("value").cast("decimal(18,2)")).alias("acctbal"),
        (F.col("event_id") % 3 != 0).alias("acctbal__set"),
        F.col("props").alias("segment"),
        (F.col("event_id") % 3 != 1).alias("segment__set"),
    )


#: The same log in SQL.
CHANGE_LOG_SQL = """(SELECT event_id + 1 AS seq, event_id // 10 AS tx, user_id AS key,
 CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
 CASE WHEN event_id % 7 <> 0 THEN value::DECIMAL(18,2) END AS acctbal, event_id % 3 <> 0 AS acctbal__set,
 props AS segment, event_id % 3 <> 1 AS segment__set FROM events)"""


def base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("decimal(18,2)").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))


BASE_SQL = "(SELECT c_custkey AS key, c_acctbal::DECIMAL(18,2) AS acctbal, c_mktsegment AS segment, c_name AS name FROM customer)"
