"""Registered queries of polled sources, type names and digest verdicts; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.functions.projections import type_name
from mirrorlake.operators import digest, polling
from mirrorlake.plans.catalog import query
from mirrorlake.plans.changelog import read


@query("""WITH m AS (SELECT max(o_orderkey) // 2 AS after, max(o_orderkey) * 3 // 4 AS high FROM orders),
u AS (SELECT o_orderkey AS lsn, 1 AS table_number, o_custkey AS a, NULL::BIGINT AS b FROM orders UNION ALL SELECT l_orderkey, 2, l_partkey, l_suppkey FROM lineitem)
SELECT lsn, table_number, a, b FROM u WHERE lsn = (SELECT min(lsn) FROM u, m WHERE lsn > after AND lsn <= high)""")
def cdc_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("a"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lsn"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    tables = {1: o, 2: li}
    last = o.agg(F.max("lsn")).first()[0]
    low = {r.table_number: r.lsn for r in polling.minima(tables).collect()}  # a row a table
    return polling.poll(tables, last // 2, minimum=low, upper=last * 3 // 4).select("lsn", "table_number", "a", "b")


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("statement_id"))


@query("""WITH e AS (SELECT o_orderkey AS change_id, o_custkey AS statement_id FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 10 FROM orders))
SELECT change_id, statement_id FROM e WHERE statement_id = (SELECT arg_min(statement_id, change_id) FROM e)""")
def outbox_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement to publish next, once what the snapshot holds is discarded."""
    e = _outbox(spark, sf_dir)
    boundary = e.agg(F.max("change_id")).first()[0] // 10
    return polling.oldest_statement(polling.discard_through(e, F.lit(boundary))).select("change_id", "statement_id")


@query("""SELECT l_orderkey AS change_id, l_linenumber AS ordinal FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""")
def outbox_after_publishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stay once the published statements are deleted."""
    published = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("statement_id"))
    values = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("ordinal"))
    return polling.without_owner(values, polling.without_published(_outbox(spark, sf_dir), published)).select("change_id", "ordinal")


_BASES = ("nvarchar", "varchar", "decimal", "datetime2", "int", "varbinary", "char", "xml")


@query(f"""WITH t AS (SELECT p_partkey, {list(_BASES)}[p_partkey % 8 + 1] AS base, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_partkey % 4000 + 2 END AS length, p_partkey % 38 + 1 AS precision, p_partkey % 7 AS scale FROM part)
SELECT p_partkey, CASE WHEN base IN ('int', 'xml') THEN base WHEN base = 'decimal' THEN 'decimal(' || precision || ',' || scale || ')' WHEN base = 'datetime2' THEN 'datetime2(' || scale || ')'
 WHEN length = -1 THEN base || '(max)' ELSE base || '(' || (CASE WHEN base = 'nvarchar' THEN length // 2 ELSE length END) || ')' END AS type_name FROM t""")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    base = F.get(F.array(*map(F.lit, _BASES)), (k % 8).cast("int"))
    length = F.when(k % 5 == 0, -1).otherwise(k % 4000 + 2)
    return read(spark, sf_dir, "part").select("p_partkey", type_name(base, length, k % 38 + 1, k % 7).alias("type_name"))


def _digests(n: int, where: str = "true") -> str:
    return f"SELECT o_orderkey % {n} AS bucket, count(*) AS rows, sum(o_orderkey)::VARCHAR AS digest FROM orders WHERE {where} GROUP BY 1"


@query(f"""WITH s AS ({_digests(16)}), d AS ({_digests(16, "o_orderkey % 1000 <> 7")}), w AS ({_digests(20)})
SELECT 'same' AS name, count(*) = 0 AS matches, count(*) AS mismatches FROM s JOIN s z USING (bucket) WHERE s.digest <> z.digest
UNION ALL SELECT 'drift', count(*) = 0, count(*) FROM s JOIN d USING (bucket) WHERE s.digest <> d.digest OR s.rows <> d.rows
UNION ALL SELECT 'longer', false, greatest((SELECT count(*) FROM s), (SELECT count(*) FROM w))""")
def digest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey")

    def digests(df, n):
        return df.groupBy((F.col("o_orderkey") % n).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").cast("string").alias("digest"))

    s = digests(o, 16)
    cases = {"same": s, "drift": digests(o.where("o_orderkey % 1000 <> 7"), 16), "longer": digests(o, 20)}
    return reduce(DataFrame.unionByName, [digest.verdict(s, t).select(F.lit(name).alias("name"), "matches", "mismatches") for name, t in cases.items()])
