"""More registered queries: orders, batches, transactions over tables, values; each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.functions import canonical, values
from mirrorlake.functions.typemap import target_type
from mirrorlake.operators import assemble, evolve, files, ordering
from mirrorlake.plans.catalog import query
from mirrorlake.plans.changelog import base_table, read
from mirrorlake.streaming.replicate import Target

# ---- order, ordinals, pages, batches ---------------------------------------------------------


@query("SELECT event_id, user_id % 7 AS t, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS ordinal FROM events")
def snapshot_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("t"))
    return ordering.snapshot_ordinals(rows, "t", ["event_id"])


@query("SELECT event_id, user_id % 7 AS t, row_number() OVER (ORDER BY user_id % 7, event_id) AS ordinal FROM events")
def snapshot_ordinals_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("t"))
    return ordering.snapshot_ordinals(rows, "t", ["event_id"], per_table=False)


@query("""SELECT event_id, event_id // 50 AS lsn, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id % 3, event_id % 5, user_id % 4, event_id) AS ordinal FROM events""")
def change_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        "event_id", F.floor(F.col("event_id") / 50).alias("lsn"), (F.col("event_id") % 3).alias("command_id"), (F.col("event_id") % 5).alias("seqval"), (F.col("user_id") % 4).alias("table_number"), F.col("event_id").alias("operation")
    )
    return ordering.change_order(e, "lsn").select("event_id", "lsn", "ordinal")


@query("""WITH d AS (SELECT event_type, max(event_id) * 9 // 10 AS durable FROM events GROUP BY 1)
SELECT event_id, greatest(max(event_id * 7919 % 100003) OVER (PARTITION BY event_type ORDER BY event_id), durable) AS reached FROM events JOIN d USING (event_type)""")
def running_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("position", F.col("event_id") * 7919 % 100003)
    durable = e.groupBy("event_type").agg(F.floor(F.max("event_id") * 9 / 10).alias("durable"))
    return ordering.running_position(e.join(durable, "event_type"), "event_type", "event_id", "position", F.col("durable")).select("event_id", "reached")


@query("""WITH m AS (SELECT max(o_orderkey) // 2 AS k FROM orders) SELECT o_orderkey, o_custkey FROM orders, m WHERE o_orderkey > k OR (o_orderkey = k AND o_custkey > 10) ORDER BY o_orderkey, o_custkey LIMIT 512""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    middle = o.agg(F.floor(F.max("o_orderkey") / 2)).first()[0]
    return ordering.next_page(o, ["o_orderkey", "o_custkey"], (middle, 10))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordering.latest(e, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("""SELECT n_nationkey, 'delete' AS action, (SELECT max(n_nationkey) FROM nation) - n_nationkey AS step FROM nation UNION ALL SELECT n_nationkey, 'insert', (SELECT max(n_nationkey) FROM nation) + n_nationkey FROM nation""")
def scope_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.scope_order(read(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@query("""WITH RECURSIVE r AS (SELECT doc_id, coalesce(source, '') AS g, strlen(text)::BIGINT AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, g, i, s AS total, 1 AS n, 0::BIGINT AS chunk FROM r WHERE i = 1
 UNION ALL SELECT r.doc_id, r.g, r.i, CASE WHEN full_ THEN r.s ELSE total + r.s END, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN chunk + 1 ELSE chunk END
 FROM (SELECT w.*, x.s AS next_s, n >= 50 OR total >= 65536 OR total + x.s > 65536 AS full_ FROM w JOIN r x ON x.g = w.g AND x.i = w.i + 1) v JOIN r ON r.g = v.g AND r.i = v.i + 1)
SELECT doc_id, chunk FROM w""")
def message_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("g"), F.octet_length("text").alias("size"))
    return ordering.batches(d, "g", "doc_id", "size", most_rows=50, most_bytes=65536).select("doc_id", "chunk")


# ---- transactions ------------------------------------------------------------------------------

_FRAMES_SQL = """(SELECT event_id AS seq, user_id % 5 AS source_id, CASE WHEN event_id % 211 = 3 THEN 'DDL' WHEN event_id % 97 = 5 THEN 'ROLLBACK' WHEN event_id % 13 = 0 THEN 'XID' WHEN event_id % 13 = 1 THEN 'BEGIN' ELSE 'R' END AS action FROM events)"""
_SPANS_SQL = f"""(SELECT *, sum((action IN ('XID', 'ROLLBACK', 'DDL'))::INT) OVER (PARTITION BY source_id ORDER BY seq) - (action IN ('XID', 'ROLLBACK', 'DDL'))::INT AS tx FROM {_FRAMES_SQL})"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    action = F.when(i % 211 == 3, "DDL").when(i % 97 == 5, "ROLLBACK").when(i % 13 == 0, "XID").when(i % 13 == 1, "BEGIN").otherwise("R")
    return read(spark, sf_dir, "events").select(i.alias("seq"), (F.col("user_id") % 5).alias("source_id"), action.alias("action"))


@query(f"""WITH s AS {_SPANS_SQL} SELECT s.seq, s.source_id, c.seq AS boundary, row_number() OVER (PARTITION BY s.source_id, s.tx ORDER BY s.seq) AS ordinal
FROM s JOIN s c ON c.source_id = s.source_id AND c.tx = s.tx AND c.action = 'XID' WHERE s.action = 'R'""")
def statement_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.statement_transactions(_frames(spark, sf_dir)).select("seq", "source_id", "boundary", "ordinal")


@query(f"""WITH s AS {_SPANS_SQL} SELECT seq, source_id, action FROM s WHERE action IN ('ROLLBACK', 'DDL') AND EXISTS (SELECT 1 FROM s r WHERE r.source_id = s.source_id AND r.tx = s.tx AND r.action = 'R')""")
def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.statement_errors(_frames(spark, sf_dir)).select("seq", "source_id", "action")


_STEPS_SQL = """(SELECT event_id + 1 AS seq, event_id // 10 AS tx, user_id AS key, event_id % 10 = 9 AS is_end, event_id % 2 = 0 AS first_table, value::DECIMAL(18,2) AS acctbal FROM events)"""


@query(f"""WITH l AS {_STEPS_SQL}, top AS (SELECT max(seq) AS upto FROM l WHERE is_end),
f AS (SELECT first_table, key, arg_max(acctbal, seq) AS acctbal FROM l, top WHERE NOT is_end AND seq <= upto GROUP BY 1, 2)
SELECT 'users' AS name, c_custkey AS key, CASE WHEN f.key IS NULL THEN c_acctbal::DECIMAL(18,2) ELSE f.acctbal END AS acctbal FROM customer LEFT JOIN f ON first_table AND f.key = c_custkey
UNION ALL SELECT 'shadow', c_custkey, CASE WHEN f.key IS NULL THEN c_acctbal::DECIMAL(18,2) ELSE f.acctbal END FROM customer LEFT JOIN f ON NOT first_table AND f.key = c_custkey""")
def multi_table_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables' interleaved updates in transactions, applied at the ends in two steps, each one commit."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mirrorlake-")
    target = Target(spark, f"{shared.rstrip('/')}/multi-{uuid.uuid4().hex}")
    base = base_table(spark, sf_dir).select("key", "acctbal")
    target.replace({"users": base, "shadow": base}, generation="g1")
    e = read(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.floor(F.col("event_id") / 10).alias("tx"), F.col("user_id").alias("key"), F.lit("update").alias("op"),
        F.col("value").cast("decimal(18,2)").alias("acctbal"), F.lit(True).alias("acctbal__set"), (F.col("event_id") % 10 == 9).alias("is_end"), (F.col("event_id") % 2 == 0).alias("first_table"),
    )
    ends, top = e.where("is_end").select("seq", "tx"), e.agg(F.max("seq")).first()[0]
    rows = {name: e.where(f"NOT is_end AND {test}").drop("is_end", "first_table") for name, test in (("users", "first_table"), ("shadow", "NOT first_table"))}
    for upto in (top // 2, top):
        part = {name: (df.where(F.col("seq") <= upto), ["key"], ["acctbal"]) for name, df in rows.items()}
        target.apply_transactions(part, ends.where(F.col("seq") <= upto), strict=False)
    return target.table("users").select(F.lit("users").alias("name"), "key", "acctbal").unionByName(target.table("shadow").select(F.lit("shadow").alias("name"), "key", "acctbal"))


# ---- values -----------------------------------------------------------------------------------


@query("SELECT event_id, sha256(props) AS payload_hash FROM events WHERE props IS NOT NULL")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", values.payload_hash(F.col("props")).alias("payload_hash"))


@query("""SELECT l_orderkey, l_linenumber, (18446744073709551616::HUGEINT - l_orderkey::HUGEINT - 1)::VARCHAR AS big, '0x' || lower(hex(l_returnflag)) AS raw, l_returnflag AS plain,
 l_quantity::BIGINT::VARCHAR AS quantity, strftime(l_shipdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS shipped FROM lineitem""")
def mysql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    raw = F.col("l_returnflag").cast("binary")
    return li.select(
        "l_orderkey", "l_linenumber", values.mysql_text(values.unsigned(-F.col("l_orderkey").cast("long") - 1), T.DecimalType(20, 0)).alias("big"), values.mysql_text(raw, T.BinaryType(), binary=True).alias("raw"),
        values.mysql_text(raw, T.BinaryType()).alias("plain"), values.mysql_text(F.floor("l_quantity").cast("double"), T.DoubleType()).alias("quantity"), values.mysql_text(F.col("l_shipdate").cast("timestamp"), T.TimestampType()).alias("shipped"),
    )


@query("""SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS price, o_orderdate::DATE::VARCHAR AS day, o_orderkey % 2 = 0 AS even, 'ff' || printf('%08X', o_orderkey) AS raw FROM orders""")
def typed_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of changes cast to the target's types."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.when(F.col("o_orderkey") % 2 == 0, "t").otherwise("f").alias("even"), F.concat(F.lit("0xff"), F.lpad(F.hex("o_orderkey"), 8, "0")).alias("raw"),
    )
    out = values.typed(o, {"o_orderkey": "bigint", "price": "numeric(18,2)", "day": "date", "even": "boolean", "raw": "bytea"})
    return out.withColumn("day", F.col("day").cast("string")).withColumn("raw", F.concat(F.lower(F.hex(F.substr("raw", F.lit(1), F.lit(1)))), F.hex(F.substr("raw", F.lit(2), F.lit(9)))))


@query("SELECT p_partkey, hex(p_partkey * 7919 % 65536) AS lsn, (p_partkey * 7919 % 65536) > 32767 AS later FROM part")
def lsn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("n", F.col("p_partkey") * 7919 % 65536)
    return p.select("p_partkey", F.hex("n").alias("lsn"), values.lsn_after(F.unhex(F.lpad(F.hex("n"), 20, "0")), F.unhex(F.lit("7FFF".rjust(20, "0")))).alias("later"))


@query("""SELECT event_id, '{"a":' || event_id || ',"b":{"x":"' || event_type || '","y":[1,2]}}' AS sorted_names, '{"a": ' || event_id || '} x' AS with_tail, '[1E400,' || event_id || ']' AS beyond, (event_id::BIGINT * 1000)::VARCHAR AS powered FROM events""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and decimals with exponents of the table's own values."""
    i, json = F.col("event_id").cast("string"), lambda c: canonical.canonical("jsonb", c)
    return read(spark, sf_dir, "events").select(
        "event_id", json(F.concat(F.lit('{ "b" : {"y":[1, 2],"x":"'), "event_type", F.lit('"}, "a":'), i, F.lit("}"))).alias("sorted_names"), json(F.concat(F.lit('{"a": '), i, F.lit("} x"))).alias("with_tail"),
        json(F.concat(F.lit("[1E400,"), i, F.lit("]"))).alias("beyond"), canonical.canonical("numeric", F.concat(i, F.lit(".0e+3"))).alias("powered"),
    )


_ENGINE_TYPES = [("mysql", "int(11)"), ("mysql", "datetime"), ("mysql", "time"), ("sqlserver", "datetime2(7)"), ("sqlserver", "money"), ("sqlserver", "nvarchar(max)")]
_TARGETS = ["integer", "timestamp without time zone", "time without time zone", "timestamp without time zone", "numeric(19,4)", "text"]


@query("SELECT p_partkey, list_extract(" + str(_TARGETS) + ", (p_partkey % 6 + 1)::INT) AS target FROM part")
def column_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target type for each catalog row."""
    p = read(spark, sf_dir, "part")
    found = F.array(*[F.lit(target_type(e, t)) for e, t in _ENGINE_TYPES])
    return p.select("p_partkey", F.get(found, (F.col("p_partkey") % 6).cast("int")).alias("target"))


# ---- files, schemas, counts -----------------------------------------------------------------------

_PATHS_SQL = "CASE event_id % 6 WHEN 0 THEN 'a/b' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a/../../b' WHEN 3 THEN '' WHEN 4 THEN 'a..b/c' ELSE '..' END || CASE WHEN event_id % 6 IN (0, 4) THEN event_id::VARCHAR ELSE '' END"


def _path() -> F.Column:
    i = F.col("event_id")
    head = F.get(F.array(*map(F.lit, ("a/b", "/etc/x", "a/../../b", "", "a..b/c", ".."))), (i % 6).cast("int"))
    return F.concat(head, F.when((i % 6).isin(0, 4), i.cast("string")).otherwise(""))


@query(f"SELECT event_id, {_PATHS_SQL} AS path, event_id % 6 IN (0, 4) AS safe FROM events")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", _path().alias("path"), files.safe_path(_path()).alias("safe"))


@query(f"""SELECT event_id, CASE WHEN NOT (event_id % 6 IN (0, 4)) THEN 'path' WHEN event_id % 4 = 3 AND event_id % 5 <> 0 THEN 'operation' WHEN event_id % 4 = 3 THEN NULL
 WHEN event_id % 5 = 0 THEN 'operation' WHEN event_id % 9 = 0 THEN 'limits' WHEN event_id % 8 = 0 THEN 'digest' WHEN event_id % 4 <> 1 AND event_id % 10 = 4 THEN 'content' END AS error FROM events""")
def file_message_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("file_begin", "file_chunk", "file_end", "file_delete"))), (i % 4).cast("int"))
    m = read(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), _path().alias("path"), F.when(i % 5 == 0, "delete").otherwise("update").alias("operation"), F.when(i % 4 == 3, "").otherwise("t").alias("transaction"),
        F.when(i % 9 == 0, 2000).otherwise(10).cast("long").alias("size"), F.lit(3).alias("chunks"), F.when(i % 8 == 0, "zz").otherwise(F.sha2(i.cast("string").cast("binary"), 256)).alias("sha256"),
        F.when((i % 10 == 4) & (i % 4 != 3), "x").otherwise("").alias("data"),
    )
    return files.message_errors(m, max_bytes=1000).select("event_id", "error")


@query("SELECT event_type, count(*) AS files, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.totals(read(spark, sf_dir, "events").select("event_type", F.octet_length("props").alias("size")), ["event_type"])


@query("SELECT event_id % 5 AS owner, count(*) FILTER (event_id > (SELECT max(event_id) * 9 // 10 FROM events)) AS pending, count(*) AS owned FROM events GROUP BY 1")
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("owner", F.col("event_id") % 5)
    done = e.agg(F.floor(F.max("event_id") * 9 / 10)).first()[0]
    return assemble.pending(e, "owner", F.col("event_id") > done)


@query("""SELECT coalesce(c.k, s.k) AS k, c.k IS NULL AS extra, s.k IS NULL AS missing FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 <> 1) c FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 7 <> 2) s ON c.k = s.k WHERE c.k IS NULL OR s.k IS NULL""")
def schema_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return evolve.incomplete(n.where("k % 5 <> 1"), n.where("k % 7 <> 2"), ["k"])


@query("SELECT event_id, event_type IN ('click', 'view') AS applied FROM events")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All envelopes go on, so that sequences stay whole; only some kinds are applied."""
    return assemble.applicable(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["click", "view"]).select("event_id", "applied")


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50) AS there FROM supplier")
def exists_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "supplier").select("s_suppkey")
    found = read(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return assemble.exists(wanted, found, ["s_suppkey"])
