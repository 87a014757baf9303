"""The fold against a replica that applies changes one by one."""

import random

import pytest

from mirrorlake.model import MatchError, SequenceError
from mirrorlake.operators import multiset
from mirrorlake.operators.fold import apply_fold, fold, lineage
from mirrorlake.streaming.replicate import Target

SCHEMA = "seq long, k long, op string, a string, a__set boolean, b string, b__set boolean"


def replica(base, changes):
    rows = {k: [a, b] for k, a, b in base}
    for _, k, op, a, a_set, b, b_set in sorted(changes):
        if op == "insert":
            rows[k] = [a if a_set else None, b if b_set else None]
        elif op == "delete":
            rows.pop(k, None)
        elif k in rows:
            rows[k] = [a if a_set else rows[k][0], b if b_set else rows[k][1]]
    return sorted((k, a, b) for k, (a, b) in rows.items())


def changes_of(seed, n=120):
    r = random.Random(seed)
    value = lambda: r.choice([None, "x", "y", "z"])
    return [(i, r.randrange(8), r.choice(["insert", "update", "update", "delete"]), value(), r.random() < 0.6, value(), r.random() < 0.6) for i in range(1, n + 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_replica(spark, seed):
    base = [(k, f"a{k}", None) for k in range(5)]
    log = changes_of(seed)
    folded = fold(spark.createDataFrame(log, SCHEMA), ["k"], ["a", "b"])
    out = apply_fold(spark.createDataFrame(base, "k long, a string, b string"), folded, ["k"], ["a", "b"])
    assert sorted(map(tuple, out.select("k", "a", "b").collect())) == replica(base, log)


def test_fold_of_an_empty_log(spark):
    base = spark.createDataFrame([(1, "a", "b")], "k long, a string, b string")
    out = apply_fold(base, fold(spark.createDataFrame([], SCHEMA), ["k"], ["a", "b"]), ["k"], ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(1, "a", "b")]


def test_target_applies_once_and_in_order(spark, tmp_path):
    target = Target(spark, str(tmp_path))
    target.replace({"t": spark.createDataFrame([(1, "a", "b")], "k long, a string, b string")}, generation="g")
    log = [(1, 1, "update", "x", True, None, False), (2, 2, "insert", "n", True, None, True), (3, 1, "delete", None, False, None, False)]
    df = spark.createDataFrame(log, SCHEMA)
    target.apply("t", df.where("seq <= 2"), ["k"], ["a", "b"])
    target.apply("t", df, ["k"], ["a", "b"])  # the first two come again
    assert [tuple(r) for r in target.table("t").collect()] == [(2, "n", None)]
    with pytest.raises(SequenceError):
        target.apply("t", spark.createDataFrame([(9, 2, "delete", None, False, None, False)], SCHEMA), ["k"], ["a", "b"])
    with pytest.raises(MatchError):
        target.apply("t", spark.createDataFrame([(4, 77, "delete", None, False, None, False)], SCHEMA), ["k"], ["a", "b"])
    assert target.state()["applied"] == 3 and target.table("t").count() == 1
    target.evolve("t", {"c": "integer"})
    assert target.table("t").columns == ["k", "a", "b", "c"]


def test_keyless_tables_are_multisets(spark):
    base = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n int, s string")
    changes = spark.createDataFrame([(1, 1, None, -1), (2, 2, "x", -1), (3, 2, "y", 1)], "seq long, n int, s string, sign int")
    out = multiset.apply_signed(base, changes, ["n", "s"])
    assert sorted(map(str, map(tuple, out.collect()))) == ["(1, None)", "(2, 'y')"]
    assert multiset.overdrawn(base, changes, ["n", "s"], "seq").count() == 0
    early = spark.createDataFrame([(1, 5, "q", -1), (2, 5, "q", 1)], "seq long, n int, s string, sign int")
    assert [r.seq for r in multiset.overdrawn(base, early, ["n", "s"], "seq").collect()] == [1]


def test_lineage_follows_renamed_and_reused_keys(spark):
    log = [(1, "update", 1, 2), (2, "update", 2, 3), (3, "insert", None, 1), (4, "update", 1, 1), (5, "delete", None, 3), (6, "insert", None, 9)]
    df = spark.createDataFrame(log, "seq long, op string, old_key long, key long")
    assert {r.seq: r.root for r in lineage(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 9}
