"""The engine's registered queries and, for each, SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake import metrics
from mirrorlake.functions import canonical, positions
from mirrorlake.functions.typemap import target_type
from mirrorlake.operators import assemble, decode, digest, files, multiset, retention, sequence
from mirrorlake.operators.evolve import add_columns
from mirrorlake.operators.fold import apply_fold, fold, lineage, unmatched
from mirrorlake.plans.changelog import BASE_SQL, CHANGE_LOG_SQL, base_table, change_log, read
from mirrorlake.streaming.replicate import Target, replicate

QUERIES, ORACLE_SQL = {}, {}
COLUMNS = ["acctbal", "segment"]
BUCKETS = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- fold and apply -----------------------------------------------------------------------

_FOLD = f"""
WITH l AS (SELECT *, sum(CASE WHEN op = 'update' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq) AS epoch FROM {CHANGE_LOG_SQL}),
e AS (SELECT l.* FROM l JOIN (SELECT key, max(epoch) AS epoch FROM l GROUP BY key) m USING (key, epoch)),
f AS (SELECT key, arg_min(op, seq) = 'delete' AS deleted, arg_min(op, seq) = 'insert' AS fresh, max(seq) AS last_order,
  arg_max({{'v': acctbal}}, seq) FILTER (acctbal__set AND op <> 'delete') AS a, arg_max({{'v': segment}}, seq) FILTER (segment__set AND op <> 'delete') AS s FROM e GROUP BY key)"""


def _state_sql(body: str) -> str:
    return f"""{_FOLD},
n AS (SELECT coalesce(b.key, f.key) AS key, b.key IS NOT NULL AS old, f.key IS NOT NULL AS known, deleted, fresh,
  CASE WHEN f.key IS NULL THEN b.acctbal WHEN fresh OR a IS NOT NULL THEN a.v ELSE b.acctbal END AS acctbal,
  CASE WHEN f.key IS NULL THEN b.segment WHEN fresh OR s IS NOT NULL THEN s.v ELSE b.segment END AS segment,
  CASE WHEN coalesce(fresh, false) THEN NULL ELSE b.name END AS name
  FROM {BASE_SQL} b FULL JOIN f ON b.key = f.key),
t AS (SELECT key, acctbal, segment, name FROM n WHERE NOT known OR (NOT deleted AND (fresh OR old)))
{body}"""


@query(f"{_FOLD} SELECT key, deleted, fresh, last_order, a.v AS acctbal, a IS NOT NULL AS acctbal__set, s.v AS segment, s IS NOT NULL AS segment__set FROM f")
def cdc_patch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(change_log(spark, sf_dir), ["key"], COLUMNS)


@query(_state_sql("SELECT * FROM t"))
def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_fold(base_table(spark, sf_dir), fold(change_log(spark, sf_dir), ["key"], COLUMNS), ["key"], COLUMNS).select("key", *COLUMNS, "name")


@query(f"""WITH l AS (SELECT key, seq, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM {CHANGE_LOG_SQL})
SELECT l.key, seq, op FROM l LEFT JOIN (SELECT DISTINCT key, true AS there FROM {BASE_SQL}) b USING (key)
WHERE CASE WHEN before IS NULL THEN coalesce(there, false) ELSE before <> 'delete' END = (op = 'insert')""")
def must_match_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched(base_table(spark, sf_dir), change_log(spark, sf_dir), ["key"])


@query(f"""WITH l AS (SELECT * FROM {CHANGE_LOG_SQL} WHERE acctbal__set AND op <> 'delete')
SELECT key, seq, acctbal FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l) WHERE r = 1""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change_log(spark, sf_dir).where("acctbal__set AND op <> 'delete'")
    return rows.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("acctbal"), "seq")["acctbal"].alias("acctbal"))


@query("SELECT o_orderkey + 1 AS seq, o_orderkey % 200 * 1000000 + o_orderkey // 1000 * 10 AS root FROM orders")
def key_change_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that updates rename: five orders insert a key, rename it three times and delete it; all meet the first key."""
    step, base = F.floor(F.col("o_orderkey") % 1000 / 200), F.col("o_orderkey") % 200 * 1000000 + F.floor(F.col("o_orderkey") / 1000) * 10
    log = read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("seq"), F.when(step == 0, "insert").when(step == 4, "delete").otherwise("update").alias("op"),
        F.when(step.between(1, 3), base + step - 1).alias("old_key"), (base + F.least(step, F.lit(3))).alias("key"),
    )
    return lineage(log).select("seq", "root")


# ---- assembly ------------------------------------------------------------------------------


@query("SELECT event_id AS seq, event_id // 10 AS tx, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) AS ordinal FROM events")
def tx_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("tx"))
    return assemble.with_ordinals(rows, "tx", "seq")


@query("""SELECT o_orderkey AS seq, o_custkey AS tx, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS chunk FROM orders""")
def tx_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("tx"))
    return assemble.with_chunks(rows, "tx", "seq", 4)


_FRAMES_SQL = """(SELECT user_id % 8 AS source_id, event_id AS seq, (event_id // 40) AS xid,
 CASE row_number() OVER (PARTITION BY user_id % 8, event_id // 40 ORDER BY event_id) WHEN 1 THEN 'B'
 ELSE CASE WHEN row_number() OVER (PARTITION BY user_id % 8, event_id // 40 ORDER BY event_id DESC) = 1 AND (event_id // 40) % 9 <> 0 THEN 'C' ELSE 'I' END END AS action FROM events)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("source_id"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 40).alias("xid"))
    w = Window.partitionBy("source_id", "xid")
    first, last = F.min("seq").over(w) == F.col("seq"), F.max("seq").over(w) == F.col("seq")
    return e.withColumn("action", F.when(first, "B").when(last & (F.col("xid") % 9 != 0), "C").otherwise("I"))


@query(f"""WITH f AS {_FRAMES_SQL}, w AS (SELECT source_id, xid FROM f GROUP BY source_id, xid HAVING count(*) FILTER (action = 'C') = 1)
SELECT source_id, xid, seq, row_number() OVER (PARTITION BY source_id, xid ORDER BY seq) AS ordinal FROM f JOIN w USING (source_id, xid) WHERE action = 'I'""")
def tx_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.transactions(_frames(spark, sf_dir)).select("source_id", "xid", "seq", "ordinal")


@query(f"""WITH f AS (SELECT *, lag(action) OVER (PARTITION BY source_id ORDER BY seq) AS before FROM {_FRAMES_SQL})
SELECT source_id, seq, xid, action FROM f WHERE action = 'B' AND before IN ('B', 'I') OR action <> 'B' AND coalesce(before, 'C') = 'C'""")
def tx_grammar_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.grammar_errors(_frames(spark, sf_dir)).select("source_id", "seq", "xid", "action")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <= 9000)""")
def commit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    commits = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return assemble.gate(rows, commits, "l_orderkey", durable=F.col("l_orderkey") <= 9000)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey * 10 <= (SELECT max(o_orderkey) FROM orders) * 9)""")
def commit_gate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durable up to nine tenths of the order ids, whatever their number."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = read(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))  # one row
    commits = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")).join(F.broadcast(last))
    return assemble.gate(rows, commits, "l_orderkey", durable=F.col("l_orderkey") * 10 <= F.col("last") * 9)


_IMAGES_SQL = """(SELECT o_custkey % 50 AS lsn, o_orderkey AS seqval, 4 AS operation, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 4 < 2
 UNION ALL SELECT o_custkey % 50, o_orderkey, 3, o_orderpriority, NULL FROM orders WHERE o_orderkey % 4 < 2
 UNION ALL SELECT o_custkey % 50, o_orderkey, o_orderkey % 4 - 1, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 >= 2)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    at = [(F.col("o_custkey") % 50).alias("lsn"), F.col("o_orderkey").alias("seqval")]
    after = o.where("o_orderkey % 4 < 2").select(*at, F.lit(4).cast("long").alias("operation"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    before = o.where("o_orderkey % 4 < 2").select(*at, F.lit(3).cast("long").alias("operation"), F.col("o_orderpriority").alias("s"), F.lit(None).cast("double").alias("p"))
    one = o.where("o_orderkey % 4 >= 2").select(*at, (F.col("o_orderkey") % 4 - 1).alias("operation"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    return after.unionByName(before).unionByName(one)


@query(f"""WITH i AS {_IMAGES_SQL}
SELECT a.lsn, a.seqval, 'update' AS op, b.s AS old_s, b.p AS old_p, a.s AS new_s, a.p AS new_p FROM i a JOIN i b ON a.lsn = b.lsn AND a.seqval = b.seqval AND a.operation = 4 AND b.operation = 3
UNION ALL SELECT lsn, seqval, 'delete', s, p, NULL, NULL FROM i WHERE operation = 1 UNION ALL SELECT lsn, seqval, 'insert', NULL, NULL, s, p FROM i WHERE operation = 2""")
def image_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.pair_images(_images(spark, sf_dir), ["lsn", "seqval"], ["s", "p"])


@query(f"""WITH i AS (SELECT * FROM {_IMAGES_SQL} WHERE NOT (operation = 4 AND seqval % 8 = 0) AND NOT (operation = 3 AND seqval % 20 = 1))
SELECT lsn, seqval FROM i GROUP BY lsn, seqval HAVING NOT (list_sort(list(operation)) IN ([1], [2], [3, 4]))""")
def image_pairing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _images(spark, sf_dir).where("NOT (operation = 4 AND seqval % 8 = 0) AND NOT (operation = 3 AND seqval % 20 = 1)")
    return assemble.pairing_errors(i, ["lsn", "seqval"])


@query("""WITH u AS (SELECT o_orderkey AS lsn, 1 AS table_number, o_custkey AS a, NULL::BIGINT AS b FROM orders WHERE o_orderkey > 5000
 UNION ALL BY NAME SELECT l_orderkey AS lsn, 2 AS table_number, l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_orderkey > 5000)
SELECT lsn, table_number, a, b FROM u WHERE lsn = (SELECT min(lsn) FROM u)""")
def next_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("a"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lsn"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return assemble.next_transaction({1: o, 2: li}, F.lit(5000)).select("lsn", "table_number", "a", "b")


@query("""SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, NULL::DOUBLE AS bal FROM nation UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def padded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return n.unionByName(s, allowMissingColumns=True)


@query("""WITH s AS (SELECT o_custkey AS statement_id, min(o_orderkey) AS first_change, max(o_orderkey) AS last_change FROM orders GROUP BY 1)
SELECT o_orderkey AS change_id, o_custkey AS statement_id, first_change, last_change, o_orderstatus || '|0x' || hex(o_orderpriority) || '|-' AS row_text
FROM orders JOIN s ON o_custkey = statement_id""")
def outbox_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    events = o.select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("statement_id"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("binary")
    value = lambda i, null, t, u, b: F.struct(F.lit(i).alias("ordinal"), F.lit(null).alias("is_null"), t.alias("value_text"), u.alias("value_unicode"), b.alias("value_binary"))
    values = o.select(
        F.col("o_orderkey").alias("change_id"),
        F.inline(F.array(value(2, False, none, none, F.col("o_orderpriority").cast("binary")), value(1, False, F.col("o_orderstatus"), none, no), value(3, True, none, none, no))),
    )
    out = assemble.outbox_statements(events, values)
    text = F.array_join("row_values", "|", "-")
    return out.select("change_id", "statement_id", "first_change", "last_change", text.alias("row_text"))


# ---- decoding ------------------------------------------------------------------------------


@query("""SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, c_custkey::VARCHAR AS key_id,
 CASE WHEN c_custkey % 3 = 1 THEN (c_custkey + 1)::VARCHAR END AS old_id, CASE WHEN c_custkey % 3 <> 2 THEN c_name END AS name,
 CASE WHEN c_custkey % 3 <> 2 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END END AS flag, c_custkey % 3 <> 2 AND c_custkey % 5 <> 0 AS name_there FROM (SELECT * REPLACE (CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name) FROM customer)""")
def decode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON frames of inserts, key-changing updates with an absent column, and deletes."""
    c = read(spark, sf_dir, "customer")
    col = lambda name, oid, v: F.struct(F.lit(name).alias("name"), F.lit("t").alias("type"), F.lit(oid).alias("typeoid"), v.alias("value"))
    kind = F.col("c_custkey") % 3
    ident = col("id", 20, F.when(kind == 1, F.col("c_custkey") + 1).otherwise(F.col("c_custkey")).cast("string"))
    every = F.array(col("id", 20, F.col("c_custkey").cast("string")), col("flag", 16, F.when(F.col("c_nationkey") % 2 == 0, "t").otherwise("f")), col("name", 25, F.col("c_name")))
    columns = F.filter(every, lambda x: (x["name"] != "name") | (F.col("c_custkey") % 5 != 0))
    frame = F.struct(
        F.when(kind == 0, "I").when(kind == 1, "U").otherwise("D").alias("action"), F.lit("public").alias("schema"), F.lit("c").alias("table"),
        F.when(kind != 2, columns).alias("columns"), F.when(kind != 0, F.array(ident)).alias("identity"),
    )
    lines = c.select(F.col("c_custkey").alias("seq"), F.to_json(frame).alias("value"))
    rows = decode.pg_rows(decode.parse_frames(lines), {"public.c": ["id"]})
    there = F.coalesce(F.map_contains_key("columns", F.lit("name")), F.lit(False))
    return rows.select("seq", "op", F.col("key")["id"].alias("key_id"), F.col("old_key")["id"].alias("old_id"), F.try_element_at("columns", F.lit("name")).alias("name"), F.try_element_at("columns", F.lit("flag")).alias("flag"), there.alias("name_there"))


@query("""SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey::VARCHAR END AS old_id, CASE WHEN p_partkey % 3 = 1 THEN (p_partkey + 1)::VARCHAR ELSE p_partkey::VARCHAR END AS key_id,
 CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END AS name FROM part""")
def decode_row_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind, image = F.col("p_partkey") % 3, lambda k: F.array(k.cast("string"), F.col("p_name"))
    images = p.select(
        F.col("p_partkey").alias("seq"), F.when(kind == 0, "insert").when(kind == 1, "update").otherwise("delete").alias("op"),
        F.when(kind != 0, image(F.col("p_partkey"))).alias("before"), F.when(kind == 0, image(F.col("p_partkey"))).when(kind == 1, image(F.col("p_partkey") + 1)).alias("after"),
    )
    rows = decode.image_rows(images, ["id", "name"], ["id"])
    return rows.select("seq", "op", F.col("old_key")["id"].alias("old_id"), F.col("key")["id"].alias("key_id"), F.try_element_at("columns", F.lit("name")).alias("name"))


# ---- sequencing ----------------------------------------------------------------------------


@query("""WITH m AS (SELECT user_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events),
k AS (SELECT source_id, n AS seq FROM m WHERE event_id % 11 <> 0)
SELECT source_id, 'g' AS generation, seq, expected FROM (SELECT *, coalesce(lag(seq) OVER (PARTITION BY source_id ORDER BY seq), 0) + 1 AS expected FROM k) WHERE seq <> expected""")
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return sequence.gaps(e.where("event_id % 11 <> 0").select(F.col("user_id").alias("source_id"), F.lit("g").alias("generation"), "seq"))


@query("""SELECT user_id % 5 AS source_id, 'g' AS generation, event_id // 3 AS seq, count(DISTINCT event_type) AS payloads FROM events GROUP BY 1, 3 HAVING count(DISTINCT event_type) > 1""")
def dup_payload_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return sequence.conflicts(e.select((F.col("user_id") % 5).alias("source_id"), F.lit("g").alias("generation"), F.floor(F.col("event_id") / 3).alias("seq"), F.col("event_type").alias("payload_hash")))


@query("""SELECT DISTINCT user_id AS source_id, 'g' AS generation, event_id // 2 AS seq FROM events WHERE (user_id, event_id // 2) NOT IN (SELECT (user_id, event_id // 2) FROM events WHERE event_id < 3000)""")
def idempotent_receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.lit("g").alias("generation"), F.floor(F.col("event_id") / 2).alias("seq"), "event_id")
    return sequence.receive(e, e.where("event_id < 3000")).select("source_id", "generation", "seq")


@query("""SELECT user_id % 10 AS source_id, 'g' AS generation, max(event_id) AS received_seq, max(event_id) FILTER (event_type = 'purchase') AS applied_seq FROM events GROUP BY 1""")
def applied_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "transaction_end").otherwise("transaction_rows")
    return sequence.applied_watermark(e.select((F.col("user_id") % 10).alias("source_id"), F.lit("g").alias("generation"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("""WITH d AS (SELECT 's' AS source_id, event_id AS seq, strlen(props) + 100 AS bytes, ts FROM events WHERE event_id <= 8000),
r AS (SELECT *, sum(bytes) OVER (ORDER BY seq DESC) AS b, max(CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 1 ELSE 0 END) OVER (ORDER BY seq DESC) AS o FROM d)
SELECT source_id, seq FROM r WHERE b > 600000 OR o = 1""")
def retention_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.lit("s").alias("source_id"), F.col("event_id").alias("seq"), (F.octet_length("props") + 100).alias("bytes"), F.col("ts").alias("created_at"))
    return retention.evictable(e, delivered=8000, max_bytes=600000, oldest=F.lit("2024-01-08").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT 's' || (user_id % 10) AS source_id, event_id AS seq, strlen(props) + 100 AS bytes, ts FROM events),
d AS (SELECT *, sum(bytes) OVER (PARTITION BY source_id) AS total FROM e WHERE seq * 10 <= (SELECT max(seq) FROM e) * 9),
r AS (SELECT *, sum(bytes) OVER (PARTITION BY source_id ORDER BY seq DESC) AS b, max(CASE WHEN ts < TIMESTAMP '2024-01-01 12:00:00' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY seq DESC) AS o FROM d)
SELECT source_id, seq FROM r WHERE b * 2 > total OR o = 1""")
def retention_eviction_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered up to nine tenths of the event ids; each of ten sources keeps half of its delivered bytes."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source_id"), F.col("event_id").alias("seq"), (F.octet_length("props") + 100).alias("bytes"), F.col("ts").alias("created_at"))
    last = e.agg(F.max("seq").alias("last"))  # one row
    at = F.floor(F.col("last") * 9 / 10)
    total = e.join(F.broadcast(last)).where(F.col("seq") <= at).groupBy("source_id").agg((F.sum("bytes") / 2).alias("half"))
    e = e.join(F.broadcast(last)).join(F.broadcast(total), "source_id")  # a row a source
    return retention.evictable(e, delivered=at, max_bytes=F.col("half"), oldest=F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))


# ---- multisets, snapshots, joins -------------------------------------------------------------

_BAG = "SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS n FROM lineitem"


def _bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", "l_linestatus", "l_quantity", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("n"), "l_orderkey")


@query(f"{_BAG} EXCEPT ALL ({_BAG} WHERE l_orderkey % 3 = 0)")
def keyless_delete_one_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = _bag(spark, sf_dir)
    return multiset.delete_one_each(bag, bag.where("l_orderkey % 3 = 0"), ["l_returnflag", "l_linestatus", "l_quantity", "n"])


@query(f"({_BAG} EXCEPT ALL ({_BAG} WHERE l_orderkey % 3 = 0)) UNION ALL SELECT l_returnflag, l_linestatus, l_quantity + 1, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END FROM lineitem WHERE l_orderkey % 3 = 0")
def keyless_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "n"]
    bag, hit = _bag(spark, sf_dir), _bag(spark, sf_dir).where("l_orderkey % 3 = 0")
    changes = hit.withColumn("sign", F.lit(-1)).unionByName(hit.withColumn("l_quantity", F.col("l_quantity") + 1).withColumn("sign", F.lit(1)))
    return multiset.apply_signed(bag, changes, columns)


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders""")
def one_of_n_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.numbered(read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("""SELECT a.o_orderkey, b.o_orderkey AS other FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS k FROM orders WHERE o_orderkey < 300) a
JOIN (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS k FROM orders WHERE o_orderkey BETWEEN 300 AND 500) b ON a.k IS NOT DISTINCT FROM b.k AND a.o_orderstatus = b.o_orderstatus""")
def null_safe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("k"))
    a, b = o.where("o_orderkey < 300"), o.where("o_orderkey BETWEEN 300 AND 500").withColumnsRenamed({"o_orderkey": "other", "o_orderstatus": "s2", "k": "k2"})
    return a.join(b, a.k.eqNullSafe(b.k2) & (a.o_orderstatus == b.s2)).select("o_orderkey", "other")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS k FROM orders)
SELECT o_orderkey, matches, least, greatest FROM o JOIN (SELECT k AS k2, o_orderstatus AS s2, count(*) AS matches, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM o GROUP BY 1, 2) b
ON o.k IS NOT DISTINCT FROM b.k2 AND o.o_orderstatus IS NOT DISTINCT FROM b.s2""")
def null_safe_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against all orders: the matches of each, counted."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("k"))
    return multiset.matched(o, o, ["k", "o_orderstatus"], "o_orderkey").select("o_orderkey", "matches", "least", "greatest")


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey >= 10 UNION ALL SELECT c_custkey + 1000000, c_nationkey, 'NEW' FROM customer WHERE c_nationkey < 10 AND c_custkey % 2 = 0""")
def snapshot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the snapshot's scope are replaced by it, the others stay."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    scope = c.select("c_nationkey").distinct().where("c_nationkey < 10")
    snapshot = c.where("c_nationkey < 10 AND c_custkey % 2 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_nationkey", F.lit("NEW").alias("c_mktsegment"))
    return c.join(scope, "c_nationkey", "left_anti").select(*c.columns).unionByName(snapshot)


@query("SELECT s_suppkey, s_name, NULL::DECIMAL(20,0) AS credit, NULL::VARCHAR AS note FROM supplier")
def schema_add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return add_columns(s, {"credit": target_type("mysql", "bigint unsigned"), "note": target_type("sqlserver", "nvarchar(40)")})


# ---- files ---------------------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
SELECT 'd/' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.h IS NULL THEN 'create' WHEN n.h IS NULL THEN 'delete' ELSE 'update' END AS operation FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    old = d.where("doc_id % 10 <> 3").select(path, F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 10 <> 4").select(path, F.sha2(text.cast("binary"), 256).alias("sha256"))
    return files.manifest_diff(old, new)


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))


@query("""WITH d AS (SELECT 'd/' || doc_id AS path, text, strlen(text) AS size, greatest(1, (strlen(text) + 2047) // 2048)::INTEGER AS chunks FROM documents)
SELECT path, sha256(text) AS sha256, size::INTEGER AS size, chunk::INTEGER AS chunk, chunks, CASE WHEN chunk + 1 < chunks THEN 2048 ELSE size - chunk * 2048 END::INTEGER AS bytes FROM (SELECT *, unnest(range(0, chunks)) AS chunk FROM d)""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.to_chunks(_document_files(spark, sf_dir), 2048).select("path", "sha256", "size", "chunk", "chunks", F.octet_length("data").alias("bytes"))


@query("SELECT 'd/' || doc_id AS path, sha256(text) AS sha256, doc_id % 10 <> 0 OR strlen(text) <= 2048 AS ok FROM documents WHERE doc_id % 10 <> 0 OR strlen(text) <= 2048")
def file_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth file lacks its second chunk; such files are told apart and left out."""
    chunks = files.to_chunks(_document_files(spark, sf_dir), 2048)
    sent = chunks.where(~(F.substring("path", 3, 20).cast("long") % 10 == 0) | (F.col("chunk") != 1))
    return files.reassemble(sent).where("ok").select("path", F.sha2("content", 256).alias("sha256"), "ok")


@query(r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*/en/[^/]*$') AND NOT regexp_matches(url, '^https://m\.[^/]*/[^/]*/[^/]*$')""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(files.included(F.col("url"), ["https://*/en/*"], ["https://m.*/*/*"]))


@query("SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN to_base64(encode(text)) END AS f, CASE WHEN doc_id % 9 <> 0 THEN 'd/' || doc_id END AS f__source, CASE WHEN doc_id % 9 <> 0 THEN 'base64' END AS f__encoding FROM documents")
def embed_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("d/"), F.col("doc_id").cast("string"))).alias("f"))
    return files.embed(rows, "f", _document_files(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'd/' || doc_id END AS f, CASE WHEN doc_id % 9 <> 0 THEN sha256(text) END AS content_sha256 FROM documents")
def embed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_embedded(embed_base64(spark, sf_dir), "f", "content").select("doc_id", "f", F.sha2("content", 256).alias("content_sha256"))


# ---- digests -------------------------------------------------------------------------------

_TYPES = {"key": "bigint", "acctbal": "numeric(18,2)", "segment": "text", "name": "text"}
_PART = "(unhex(printf('%016x', strlen({0}))) || encode({0}))"
_CELL = f"(CASE WHEN {{0}} IS NULL THEN unhex(repeat('FF', 8)) ELSE unhex('000000000000000101') || {_PART} END)"


def _dec(c: str) -> str:
    return f"(CASE WHEN {c} = trunc({c}) THEN ({c}::DECIMAL(18,0))::VARCHAR ELSE rtrim({c}::VARCHAR, '0') END)"


def _hash_sql(source: str) -> str:
    values = {"acctbal": _dec("acctbal"), "key": "key::VARCHAR", "name": "name", "segment": "segment"}
    body = " || ".join(f"{_PART.format(repr(c))} || {_CELL.format(v)}" for c, v in sorted(values.items()))
    ident = f"{_PART.format(repr('key'))} || {_CELL.format('key::VARCHAR')}"
    return f"""(SELECT sha256({_PART.format("'public'")} || {_PART.format("'users'")} || {body}) AS h,
 (('0x' || left(sha256({ident}), 16))::UBIGINT % {BUCKETS})::INTEGER AS bucket, key FROM {source})"""


def _limbs_sql(source: str) -> str:
    limb = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    xs = ", ".join(f"bit_xor({limb(i)}) AS x{i}" for i in range(8))
    ss = ", ".join(f"sum({limb(i)})::BIGINT AS s{i}" for i in range(8))
    return f"(SELECT bucket, count(*) AS rows, {xs}, {ss} FROM {_hash_sql(source)} GROUP BY bucket)"


def _digest_sql(source: str) -> str:
    carry = ["0"]
    for i in reversed(range(8)):
        carry.append(f"((s{i} + {carry[-1]}) // 4294967296)")
    low = [f"printf('%08x', ((s{i} + {carry[7 - i]}) % 4294967296)::BIGINT)" for i in range(8)]
    xor = [f"printf('%08x', x{i})" for i in range(8)]
    zero = ", ".join(f"coalesce({c}{i}, 0) AS {c}{i}" for c in "xs" for i in range(8))
    return f"""(SELECT bucket, rows, sha256(unhex(printf('%016x', rows) || {" || ".join(xor + low)})) AS digest
 FROM (SELECT b.bucket, coalesce(rows, 0) AS rows, {zero} FROM (SELECT unnest(range({BUCKETS}))::INTEGER AS bucket) b LEFT JOIN {_limbs_sql(source)} l ON b.bucket = l.bucket))"""


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_table(spark, sf_dir)


@query(f"SELECT key, bucket, h FROM {_hash_sql(BASE_SQL)}")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    cols = {c: F.col(c).cast("string") for c in _TYPES}
    return users.select("key", digest.bucket_of(canonical.identity_hash({"key": "bigint"}, cols), BUCKETS).alias("bucket"), canonical.row_hash("public", "users", _TYPES, cols).alias("h"))


@query(f"SELECT * FROM {_limbs_sql(BASE_SQL)}")
def bucket_digest_limbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.bucket_state(digest.hashed(_users(spark, sf_dir), "public", "users", _TYPES, ["key"], BUCKETS))


@query(f"SELECT * FROM {_digest_sql(BASE_SQL)}")
def bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest(_users(spark, sf_dir), "public", "users", _TYPES, ["key"], BUCKETS)


@query(_state_sql(f"SELECT * FROM {_digest_sql('t')}"))
def replay_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest(cdc_latest_state(spark, sf_dir), "public", "users", _TYPES, ["key"], BUCKETS)


_DRIFT = BASE_SQL.replace("c_mktsegment AS segment", "CASE WHEN c_custkey % 400 = 7 THEN 'X' ELSE c_mktsegment END AS segment")


@query(f"""SELECT s.bucket, s.rows AS source_rows, s.digest AS source_digest, t.rows AS target_rows, t.digest AS target_digest FROM {_digest_sql(BASE_SQL)} s JOIN {_digest_sql(_DRIFT)} t ON s.bucket = t.bucket WHERE s.digest <> t.digest""")
def digest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    drift = users.withColumn("segment", F.when(F.col("key") % 400 == 7, "X").otherwise(F.col("segment")))
    one = lambda df: digest.digest(df, "public", "users", _TYPES, ["key"], BUCKETS)
    return digest.compare(one(users), one(drift))


@query(f"""SELECT key, segment, 1 AS excess FROM {BASE_SQL} WHERE key % 400 = 7 AND segment <> 'X' UNION ALL SELECT key, 'X', -1 FROM {BASE_SQL} WHERE key % 400 = 7""")
def drift_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    drift = users.withColumn("segment", F.when(F.col("key") % 400 == 7, "X").otherwise(F.col("segment")))
    return digest.drifted_rows(users, drift, ["key", "segment"])


_VALUES = [
    ("bytea", "\\x00FF"), ("varbinary", "0x00ff"), ("blob", "zz"), ("bool", "T"), ("bit", "0"), ("boolean", "maybe"), ("numeric(9,3)", "001.500"), ("decimal", "-0.00"),
    ("numeric", "NaN"), ("numeric", "12345678901234567890123456789012345678901234567890.10"), ("datetime2", "2024-01-02T03:04:05"), ("timestamp", "2024-01-02 03:04:05"), ("text", "T"), ("text", None),
]
_EXPECTED = ["hex:00ff", "hex:00ff", "zz", "true", "false", "maybe", "1.5", "0", "NaN", "12345678901234567890123456789012345678901234567890.1", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "T", None]


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(t)}, {_quoted(v)}, {_quoted(w)})" for i, ((t, v), w) in enumerate(zip(_VALUES, _EXPECTED, strict=True))) + ") t(i, kind, value, canonical)")
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(_VALUES)], "i int, kind string, value string")
    out = F.lit(None).cast("string")
    for t in {t for t, _ in _VALUES}:
        out = F.when(F.col("kind") == t, canonical.canonical(t, F.col("value"))).otherwise(out)
    return df.withColumn("canonical", out)


# ---- positions, masks, types, health ---------------------------------------------------------


@query("""SELECT l_orderkey AS k, l_linenumber AS n, (l_orderkey::HUGEINT * 4294967296 + l_partkey)::VARCHAR AS pg, 'legacy:' || lpad(l_orderkey::VARCHAR, 20, '0') AS legacy,
 'mysql:v1:' || translate(to_base64(encode('binlog.' || lpad(l_linenumber::VARCHAR, 6, '0'))), '+/=', '-_') || ':' || lpad(l_partkey::VARCHAR, 20, '0') AS mysql,
 'binlog.' || lpad(l_linenumber::VARCHAR, 6, '0') AS file, l_partkey::VARCHAR AS offset_text, '0x' || printf('%020X', l_orderkey) AS mssql FROM lineitem""")
def position_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    file = F.concat(F.lit("binlog."), F.lpad(F.col("l_linenumber").cast("string"), 6, "0"))
    coded = li.withColumn("mysql", positions.mysql_position(file, F.col("l_partkey")))
    back = positions.parse_mysql_position(F.col("mysql"))
    return coded.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), positions.pg_position(F.concat(F.hex("l_orderkey"), F.lit("/"), F.hex("l_partkey"))).cast("string").alias("pg"),
        positions.counter_position("legacy", F.col("l_orderkey")).alias("legacy"), "mysql", back[0].alias("file"), back[1].cast("string").alias("offset_text"),
        positions.mssql_position(F.unhex(F.lpad(F.hex("l_orderkey"), 20, "0"))).alias("mssql"),
    )


@query("""SELECT p_partkey, o AS ordinal, o <= 24 AND o >= 1 AND ((p_partkey * 7919 % 16777216) >> (o - 1)::BIGINT) & 1 = 1 AS changed FROM part, (SELECT unnest([1, 2, 8, 9, 17, 24, 25]) AS o)""")
def update_mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0").alias("mask"), F.explode(F.array(*[F.lit(x) for x in (1, 2, 8, 9, 17, 24, 25)])).alias("ordinal"))
    return p.select("p_partkey", "ordinal", positions.mask_changed(F.col("mask"), F.col("ordinal")).alias("changed"))


_TYPE_CASES = [
    ("mysql", "tinyint(4)", "smallint"), ("mysql", "int unsigned", "numeric(20,0)"), ("mysql", "varchar(40)", "character varying(40)"), ("mysql", "decimal(10,2)", "numeric(10,2)"),
    ("mysql", "longblob", "bytea"), ("mysql", "datetime(6)", "timestamp without time zone"), ("sqlserver", "money", "numeric(19,4)"), ("sqlserver", "nvarchar(max)", "text"), ("sqlserver", "bit", "boolean"),
    ("sqlserver", "rowversion", "bytea"), ("sqlserver", "uniqueidentifier", "uuid"), ("postgres", "double precision", "double precision"), ("postgres", "timestamp(3) with time zone", "timestamp(3) with time zone"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({_quoted(e)}, {_quoted(s)}, {_quoted(t)})" for e, s, t in _TYPE_CASES) + ") t(engine, source_type, target_type)")
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e, s, target_type(e, s)) for e, s, _ in _TYPE_CASES], "engine string, source_type string, target_type string")


@query("""SELECT event_type, count(*) AS total, count(CASE WHEN event_id % 4 <> 0 OR event_type = 'view' THEN event_id END) AS known,
 CASE WHEN count(*) = count(CASE WHEN event_id % 4 <> 0 OR event_type = 'view' THEN event_id END) THEN max(event_id) END AS position FROM events GROUP BY 1""")
def health_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest position, but only where all are known."""
    e = read(spark, sf_dir, "events").withColumn("p", F.when((F.col("event_id") % 4 != 0) | (F.col("event_type") == "view"), F.col("event_id")))
    out = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count("p").alias("known"), F.max("p").alias("position"))
    return out.withColumn("position", F.when(F.col("total") == F.col("known"), F.col("position")))


@query("WITH v AS (SELECT value / 100 AS x FROM events) " + " UNION ALL ".join(f"SELECT '{float(b)}' AS le, count(*) FILTER (x <= {b}) AS count FROM v" for b in metrics.BOUNDS) + " UNION ALL SELECT '+Inf', count(x) FROM v")
def delivery_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(read(spark, sf_dir, "events"), F.col("value") / 100)


# ---- streaming ------------------------------------------------------------------------------


@query(_state_sql("SELECT * FROM t"))
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a file stream in four ordered parts, applied micro-batch by micro-batch; equals the batch fold."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mirrorlake-")
    root = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = Target(spark, f"{root}/target")
    target.replace({"users": base_table(spark, sf_dir)}, generation="g1")
    log = change_log(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in log.schema.fields])
    for k in range(4):
        a, b = top * k // 4, top * (k + 1) // 4
        log.where((F.col("seq") > a) & (F.col("seq") <= b)).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(schema).parquet(f"{root}/log")
        replicate(stream, target, "users", ["key"], COLUMNS, f"{root}/checkpoint").awaitTermination()
    return target.table("users").select("key", *COLUMNS, "name")
