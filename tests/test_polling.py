"""Polled sources, scan texts, digest verdicts, repair permission and overlaps."""

import pytest
from pyspark.sql import functions as F

from mirrorlake.config import Storage, storage_overlaps, target_overlaps
from mirrorlake.functions import projections
from mirrorlake.model import SchemaError, SequenceError
from mirrorlake.operators import digest, polling
from mirrorlake.sources.log import Log


def test_poll_stays_between_the_watermarks(spark):
    a = spark.createDataFrame([(3, "a3"), (5, "a5"), (9, "a9")], "lsn long, v string")
    b = spark.createDataFrame([(5, "b5", 1), (6, "b6", 2)], "lsn long, v string, w int")
    got = lambda after, upper: sorted((r.lsn, r.table_number, r.v, r.w) for r in polling.poll({1: a, 2: b}, after, minimum={1: 1, 2: 2}, upper=upper).collect())
    assert got(3, 8) == [(5, 1, "a5", None), (5, 2, "b5", 1)]
    assert got(5, 8) == [(6, 2, "b6", 2)] and got(6, 8) == [] and got(6, 9) == [(9, 1, "a9", None)]


def test_poll_refuses_a_gap(spark):
    t = spark.createDataFrame([], "lsn long")
    with pytest.raises(polling.RetentionGap):
        polling.poll({1: t, 2: t}, 4, minimum={1: 1, 2: 5}, upper=9)
    with pytest.raises(SequenceError):
        polling.poll({1: t, 2: t}, 4, minimum={1: 1}, upper=9)
    assert {r.table_number: r.lsn for r in polling.minima({1: t, 2: spark.range(3, 5).toDF("lsn")}).collect()} == {1: None, 2: 3}


def test_outbox_steps(spark):
    e = spark.createDataFrame([(1, "s1"), (4, "s3"), (2, "s2"), (3, "s1"), (5, "s2")], "change_id long, statement_id string")
    left = polling.discard_through(e, F.lit(1))
    first = polling.oldest_statement(left)
    assert sorted(r.change_id for r in first.collect()) == [2, 5]
    rest = polling.without_published(left, first)
    assert sorted(r.change_id for r in rest.collect()) == [3, 4] == sorted(r.change_id for r in polling.without_published(rest, first).collect())
    values = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "change_id long, ordinal int")
    assert sorted((r.change_id, r.ordinal) for r in polling.without_owner(values, rest).collect()) == [(3, 1), (3, 2)]
    assert polling.oldest_statement(e.limit(0)).count() == 0


def test_scan_texts():
    q = projections.scan_query
    assert q("sqlserver", "dbo", "t]", {"id": "int", "f": "float", "m": "money", "d": "date"}, ["id"]) == (
        "SELECT CONVERT(nvarchar(max),[id]),CONVERT(nvarchar(max),CONVERT(varbinary(max),[f]),2),CONVERT(nvarchar(max),[m],2),CONVERT(nvarchar(max),[d],126) FROM [dbo].[t]]] ORDER BY [id]"
    )
    assert q("mysql", "s", "t", {"a": "int", "b": "varbinary"}, ["a", "b"], after=True) == (
        "SELECT CAST(`a` AS CHAR CHARACTER SET utf8mb4),IF(`b` IS NULL,NULL,CONCAT('0x',HEX(`b`))) FROM `s`.`t` WHERE (`a`>?) OR (`a`=? AND `b`>?) ORDER BY `a`,`b`"
    )
    assert q("postgres", "s", "bag", {"n": "integer"}, []) == 'SELECT "n"::text FROM "s"."bag"'
    with pytest.raises(SchemaError):
        q("mysql", "s", "t", {"a": "int"}, ["b"])


def test_type_names_fail_on_others(spark):
    df = spark.createDataFrame([("nvarchar", 20, 0, 0), ("char", -1, 0, 0), ("numeric", 9, 18, 4), ("time", 5, 0, 7), ("bit", 1, 1, 0)], "b string, l int, p int, s int")
    name = projections.type_name(*map(F.col, "blps"))
    assert [r[0] for r in df.select(name).collect()] == ["nvarchar(10)", "char(max)", "numeric(18,4)", "time(7)", "bit"]
    with pytest.raises(Exception, match="unsupported type geography"):
        spark.createDataFrame([("geography", 1, 1, 1)], df.schema).select(name).collect()


def test_verdict(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "bucket int, rows long, digest string")
    s = make((0, 1, "a"), (1, 2, "b"))
    ask = lambda t: tuple(digest.verdict(s, t).first())
    assert ask(s) == (True, 0) and ask(make((0, 1, "a"), (1, 3, "b"))) == (False, 1) and ask(make((0, 1, "a"), (2, 2, "b"))) == (False, 1)
    assert ask(make((0, 1, "a"))) == (False, 2) == ask(s.limit(0))


def test_one_repair_for_one_permission(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.initialise("g", "f")
    assert not log.consume_repair_authorization()
    log.authorize_repair()
    assert Log(spark, str(tmp_path)).consume_repair_authorization() and not log.consume_repair_authorization()


def test_overlaps():
    kept = {"a": Storage("directory", "/x", "y"), "b": Storage("directory", "/x/y/../y/z"), "c": Storage("directory", "/x/yz"), "d": Storage("object", "k", "/p/", "H"), "e": Storage("object", "k", "p/q", "h"), "f": Storage("object", "k", "pq", "h")}
    assert storage_overlaps(kept) == [("a", "b"), ("d", "e")]
    assert target_overlaps({"b": ("i", "s", ["t", "u"]), "a": ("i", "s", ["t"]), "c": ("j", "s", ["t"])}) == [("s.t", "a", "b")]
