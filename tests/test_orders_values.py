"""Values, identifiers, log operations, concurrent manifests and transactions over tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.functions import canonical, values
from mirrorlake.functions.typemap import target_type
from mirrorlake.model import MatchError, ReplicationError, SchemaError, SequenceError, TransientError
from mirrorlake.sources.log import Log, Manifests
from mirrorlake.streaming.replicate import Target


def test_one_of_many_writers_commits(tmp_path):
    found = [Manifests(str(tmp_path)) for _ in range(8)]

    def commit(i):
        try:
            found[i].commit(1, {"writer": i})
            return i
        except TransientError:
            return None

    for _ in range(20):
        with ThreadPoolExecutor(8) as pool:
            won = [i for i in pool.map(commit, range(8)) if i is not None]
        assert len(won) == 1 and found[0].latest() == {"writer": won[0]}
        (tmp_path / "manifests" / f"{1:012d}.json").unlink()
    assert not [p for p in (tmp_path / "manifests").iterdir()]  # no drafts stay


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("numeric", "1e2", "100"), ("decimal(9,2)", "-1.50E+1", "-15"), ("numeric", "12e-3", "0.012"), ("numeric", "0e5", "0"), ("numeric", ".5e1", "5"), ("numeric", "1e9999", "1e9999"), ("numeric", "e5", "e5"),
        ("json", '{"a":1.0} x', '{"a":1.0} x'), ("json", "1E400", "1E400"), ("json", '{"b":1, "a":"Infinity"}', '{"a":"Infinity","b":1}'), ("json", "1,2", "1,2"), ("jsonb", "[ ]", "[]"), ("json", "", ""), ("json", None, None), ("json", "null", "null"), ("json", "{}] [", "{}] ["),
    ],
)
def test_canonical_values(spark, kind, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(canonical.canonical(kind, F.col("v"))).first()[0] == want


def test_values_of_sources(spark):
    df = spark.createDataFrame([(b"\x00\xff", -1, 2.0, 0.5, None)], "b binary, n long, w double, d double, x string")
    got = df.select(
        values.mysql_text(F.col("b"), T.BinaryType(), binary=True), values.unsigned(F.col("n")).cast("string"), values.mysql_text(F.col("w"), T.DoubleType()), values.mysql_text(F.col("d"), T.DoubleType()), values.mysql_text(F.col("x"), T.StringType()),
        values.nonnegative(F.lit(-3)), values.lsn_after(F.unhex(F.lit("80")), F.unhex(F.lit("7F00"))),
    ).first()
    assert tuple(got) == ("0x00ff", "18446744073709551615", "2", "0.5", None, 0.0, True)
    assert values.quote_identifier("mysql", "a`b") == "`a``b`" and values.quote_identifier("sqlserver", "x]") == "[x]]]" and values.quote_identifier("postgres", 'q"') == '"q"""'
    with pytest.raises(SchemaError):
        values.quote_identifier("mysql", "")
    assert target_type("sqlserver", "datetime2(7)") == target_type("mysql", "timestamp(6)") == "timestamp without time zone"


def test_typed_text(spark):
    df = spark.createDataFrame([("1", "0x00ff"), (None, None)], "n string, b string")
    assert [tuple(r) for r in values.typed(df, {"n": "bigint", "b": "bytea"}).collect()] == [(1, b"\x00\xff"), (None, None)]
    with pytest.raises(SchemaError):
        values.typed(df, {"n": "bigint"})
    with pytest.raises(SchemaError):
        values.typed(df, {"n": "bigint", "b": "text"}, file_columns=("b",))
    for bad in ("x", "0xzz"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|invalid binary"):
            values.typed(spark.createDataFrame([(bad, bad)], "n string, b string"), {"n": "bigint", "b": "bytea"} if bad == "x" else {"n": "text", "b": "bytea"}).collect()


def test_log_operations(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.initialise("g", "f")
    rows = spark.createDataFrame([(i, "s", "snapshot_rows") for i in range(3)], "_order long, source_id string, kind string")
    log.append(rows)
    assert log.backfill_lsn("0/16") == 1 and log.backfill_lsn("0/17") == 1
    with pytest.raises(ReplicationError):
        log.publish_schema("p", "")
    state = log.publish_schema("p1", "h1")
    assert (state.durable, state.schema_hash, state.ready_seq) == ("p1", "h1", 3) and {r.lsn for r in log.read().collect()} == {"0/17"}
    assert log.backfill_lsn("0/18") == 0
    log.append(rows)
    log.publish("p2", cleanup_token="t")
    with pytest.raises(ReplicationError):
        log.clear_cleanup("other")
    assert log.clear_cleanup("t").cleanup_token == "" and log.state().schema_hash == "h1"
    log.acknowledge_through(3)
    assert log.evict(max_archive_bytes=1 << 40, max_age_seconds=1e6).earliest_seq == 1
    assert log.evict(max_archive_bytes=1 << 40, max_age_seconds=-1e6).earliest_seq == 4  # not what isn't delivered


def test_transactions_over_tables(spark, tmp_path):
    target = Target(spark, str(tmp_path))
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    target.replace({"x": base, "y": base}, generation="g")
    step = lambda rows: spark.createDataFrame([(s, t, o, k, v, True) for s, t, o, k, v in rows], "seq long, tx string, op string, k long, v string, v__set boolean")
    x = step([(1, "t1", "update", 1, "A"), (4, "t2", "insert", 3, "C"), (6, "t3", "delete", 2, None)])
    y = step([(2, "t1", "delete", 2, None)])
    ends = lambda rows: spark.createDataFrame(rows, "seq long, tx string")
    plan = {"x": (x, ["k"], ["v"]), "y": (y, ["k"], ["v"])}
    values_of = lambda n: sorted(map(tuple, target.table(n).collect()))
    assert target.apply_transactions(plan, ends([]))["applied"] == 0
    number = target.state()["number"]
    assert target.apply_transactions(plan, ends([(3, "t1"), (5, "t2")]))["applied"] == 5 and target.state()["number"] == number + 1  # one commit
    assert values_of("x") == [(1, "A"), (2, "b"), (3, "C")] and values_of("y") == [(1, "a")]  # t3 has not ended
    assert target.apply_transactions(plan, ends([(3, "t1"), (5, "t2")]))["applied"] == 5  # again: nothing
    with pytest.raises(SequenceError):
        target.apply_transactions(plan, ends([(8, "t3")]))
    bad = {**plan, "y": (step([(7, "t3", "delete", 9, None)]), ["k"], ["v"])}
    with pytest.raises(MatchError):
        target.apply_transactions(bad, ends([(8, "t3")]))
    assert values_of("x") == [(1, "A"), (2, "b"), (3, "C")] and target.state()["applied"] == 5  # neither table moved
    assert target.apply_transactions(plan, ends([(7, "t3")]))["applied"] == 7 and values_of("x") == [(1, "A"), (3, "C")]
