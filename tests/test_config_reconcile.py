import json
from datetime import datetime, time, timedelta, timezone

import pytest

from mirrorlake import metrics
from mirrorlake.config import Config, ConfigError, Limits, load
from mirrorlake.functions.typemap import spark_type, target_type
from mirrorlake.model import SchemaError
from mirrorlake.operators import evolve, files
from mirrorlake.operators.reconcile import Reconciler, TableSpec, due

GOOD = {"capture": {"engine": "postgres", "source_id": "s", "tables": ["public.a", "public.b"], "slot": "x"}}


def test_fingerprint_names_the_capture_only():
    a = load(json.dumps(GOOD))
    b = load(json.dumps({**GOOD, "limits": {"batch_rows": 9}, "capture": {**GOOD["capture"], "tables": ["public.b", "public.a"]}}))
    assert a.fingerprint() == b.fingerprint()
    assert a.fingerprint() != Config(a.capture.__class__(**{**a.capture.__dict__, "slot": "y"}), Limits()).fingerprint()


@pytest.mark.parametrize(
    "change",
    [
        {"extra": 1}, {"capture": {**GOOD["capture"], "engine": "oracle"}}, {"capture": {**GOOD["capture"], "tables": ["a"]}}, {"capture": {**GOOD["capture"], "tables": ["p.a", "p.a"]}},
        {"limits": {"batch_rows": 0}}, {"limits": {"batch_rows": 1, "rows": 2}}, {"capture": {"engine": "postgres"}}, {"capture": {"engine": "files", "source_id": "s"}},
    ],
)
def test_bad_settings_are_refused(change):
    with pytest.raises(ConfigError):
        load(json.dumps({**GOOD, **change}))
    with pytest.raises(ConfigError):
        load(json.dumps(GOOD) + "{}")


def test_types():
    assert target_type("mysql", "bigint(20) unsigned") == "numeric(20,0)" and str(spark_type("numeric(20,0)")) == "DecimalType(20,0)"
    assert str(spark_type("numeric(1000,2)")) == "StringType()"
    for engine, name in (("mysql", "enum('a')"), ("mysql", "year"), ("sqlserver", "sql_variant"), ("sqlserver", "xml"), ("postgres", "interval"), ("mysql", "decimal(2,3)")):
        with pytest.raises(SchemaError):
            target_type(engine, name)


def test_schema_additions():
    old = {"name": "t", "columns": [{"name": "id", "type": "bigint", "primary_key": True}]}
    new = lambda **c: {"name": "t", "columns": [*old["columns"], {"name": "x", "type": "int", **c}]}
    assert evolve.added_columns(old, new(), engine="mysql") == {"x": "integer"}
    for bad in (new(not_null=True), new(primary_key=True), {"name": "t", "columns": []}, {"name": "t", "columns": [{"name": "id", "type": "int", "primary_key": True}]}):
        with pytest.raises(SchemaError):
            evolve.added_columns(old, bad, engine="mysql")
    assert evolve.schema_hash([{"name": "b"}, {"name": "a"}]) == evolve.schema_hash([{"name": "a"}, {"name": "b"}])


def test_reconcile_repairs_once(spark):
    a = spark.createDataFrame([(1, "1.00"), (2, None)], "id long, v string")
    b = spark.createDataFrame([(2, None), (1, "1")], "id long, v string")
    spec, repairs = TableSpec("s", "t", {"id": "bigint", "v": "numeric"}, ["id"]), []
    make = lambda x, y: Reconciler(lambda _: x, lambda _: y, [spec], buckets=4, auto_repair=True, repair=lambda: repairs.append(1))
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert make(a, b).run(now) == "match"
    drifted = make(a, b.unionByName(b.where("id = 1")))
    assert [drifted.run(now), drifted.run(now + timedelta(hours=1)), drifted.run(now + timedelta(hours=30))] == ["repair", "mismatch", "repair"]
    assert len(repairs) == 2


def test_schedule():
    at = lambda h, m=0: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    assert not due(at(1), time(3), "UTC", None) and due(at(4), time(3), "UTC", None)
    assert not due(at(5), time(3), "UTC", at(4)) and due(at(4, 6), time(3), "UTC", at(4), last_failed=True)
    assert due(at(2), time(3), "Europe/Berlin", None)


def test_directory_scan_and_paths(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"")
    (tmp_path / "sub" / "b.txt").write_bytes(b"\x00\x01\xff" * 100)
    (tmp_path / "c.tmp").write_bytes(b"x")
    found = files.scan_directory(spark, str(tmp_path), include=["*.txt", "sub/*"], exclude=["*.tmp"])
    assert sorted(r.path for r in found.select("path").collect()) == ["a.txt", "sub/b.txt"]
    back = files.reassemble(files.to_chunks(found, 64))
    assert {r.path: (len(r.content), r.ok) for r in back.collect()} == {"a.txt": (0, True), "sub/b.txt": (300, True)}
    paths = spark.createDataFrame([("a/b",), ("/a",), ("../a",), ("a/../b",), ("",), (None,), ("a\x00",)], "p string")
    assert [r[0] for r in paths.select(files.safe_path(paths.p)).collect()] == [True] + [False] * 6


def test_exposition():
    assert metrics.exposition({"b": 2, "a": 1.5}, {"source": 'x"y'}) == 'mirrorlake_a{source="x\\"y"} 1.5\nmirrorlake_b{source="x\\"y"} 2\n'
