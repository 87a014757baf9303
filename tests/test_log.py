"""The durable log, the acceptance rules and the frame stream."""

import json

import pytest
from pyspark.sql import functions as F

from mirrorlake.model import ReplicationError, SequenceError, TransientError
from mirrorlake.operators.sequence import Envelope, Sequencer
from mirrorlake.sources import recorded
from mirrorlake.sources.log import Log
from mirrorlake.streaming.assembler import assemble


def messages(spark, kinds):
    return spark.createDataFrame([(i, k, "s") for i, k in enumerate(kinds)], "_order int, kind string, source_id string")


def test_staged_messages_show_only_when_published(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.initialise("g1", "f")
    assert log.append(messages(spark, ["snapshot_begin", "snapshot_end"])) == 2
    assert log.read().count() == 0
    assert Log(spark, str(tmp_path)).recover().ready_seq == 0  # a crash before publish
    log.publish("0/1", phase="stream")
    assert [(r.seq, r.kind, r.message_id) for r in log.read().orderBy("seq").collect()] == [(1, "snapshot_begin", "s/g1/1"), (2, "snapshot_end", "s/g1/2")]
    again = Log(spark, str(tmp_path))
    again.append(messages(spark, ["transaction_rows"]))
    again.recover()
    again.append(messages(spark, ["transaction_end"]))
    assert again.publish("0/2").ready_seq == 3
    assert again.read(3).first().kind == "transaction_end"


def test_acknowledgements_are_exact(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.initialise("g1", "f")
    log.append(messages(spark, ["snapshot_begin", "snapshot_end"]))
    log.publish()
    for seq, name in ((2, "s/g1/2"), (1, "s/g1/2")):
        with pytest.raises(SequenceError):
            log.acknowledge(seq, name)
    log.acknowledge(1, "s/g1/1")
    with pytest.raises(ReplicationError):
        log.initialise("g2", "f")  # not drained
    log.acknowledge(2, "s/g1/2")
    log.evict(max_archive_bytes=0)
    with pytest.raises(SequenceError):
        log.append(messages(spark, ["x"])) and log.publish() and log.read(1)
    with pytest.raises(ReplicationError):
        log.initialise("g2", "another")


def test_two_writers_do_not_both_commit(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    state = log.state()
    log._commit(state)
    with pytest.raises(TransientError):
        log._commit(state)


def envelopes(*kinds):
    return [Envelope("g", i, k, t, v, f"h{i}") for i, (k, t, v) in enumerate(kinds, 1)]


def test_sequencer_accepts_a_whole_life():
    s = Sequencer()
    es = envelopes(
        ("snapshot_begin", "", "1"), ("snapshot_rows", "", "1"), ("snapshot_end", "", "1"), ("transaction_rows", "t", "1"), ("transaction_end", "t", "1"),
        ("schema", "", "2"), ("schema_end", "", "2"), ("file_begin", "f", "2"), ("file_end", "f", "2"), ("file_delete", "", "2"), ("transaction_end", "u", "2"),
    )
    assert s.accept_prefix(es) == (list(range(1, 12)), None)
    assert (s.progress.applied, s.progress.phase, s.progress.schema_version) == (11, "stream", "2")
    assert not s.accept(es[4])  # again, the same
    with pytest.raises(SequenceError):
        s.accept(Envelope("g", 5, "transaction_end", "t", "1", "other"))
    with pytest.raises(SequenceError):
        s.accept(Envelope("g", 13, "file_delete", "", "2"))
    with pytest.raises(SequenceError):
        s.accept(Envelope("g2", 2, "snapshot_begin"))
    assert s.accept(Envelope("g2", 1, "snapshot_begin", "", "7")) and s.progress.received == 1


@pytest.mark.parametrize(
    "bad",
    [
        ("transaction_end", "u", "1"), ("file_delete", "", "1"), ("schema", "", "2"), ("transaction_rows", "u", "1"), ("transaction_rows", "t", "9"),
        ("snapshot_rows", "", "1"), ("schema_end", "", "2"), ("transaction_rows", "", "1"),
    ],
)
def test_sequencer_refuses_and_stays(bad):
    s = Sequencer(strict=True)
    taken, error = s.accept_prefix(envelopes(("snapshot_begin", "", "1"), ("snapshot_end", "", "1"), ("transaction_rows", "t", "1"), bad))
    assert taken == [1, 2, 3] and isinstance(error, SequenceError) and s.progress.received == 3


def test_frames_are_held_until_their_commit(spark, tmp_path):
    frames, root = tmp_path / "frames", str(tmp_path)
    frames.mkdir()
    recorded.register(spark)
    put = lambda name, rows: (frames / name).write_text("".join(json.dumps({"source_id": "s", "seq": q, "xid": x, "action": a, "body": q}) + "\n" for q, x, a in rows))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []

    def run():
        stream = spark.readStream.format("recorded_frames").load(str(frames))
        query = assemble(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.orderBy("ordinal").collect()))).option("checkpointLocation", f"{root}/c")
        query = query.trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    put("1.jsonl", [(1, 7, "B"), (2, 7, "I"), (3, 7, "U")])
    run()
    assert got == []
    put("2.jsonl", [(4, 7, "D"), (5, 7, "C")])
    run()
    assert [(g[2], g[3], g[4]) for g in got] == [(1, 2, "I"), (2, 3, "U"), (3, 4, "D")]


def test_splitting_keeps_digits(spark):
    from mirrorlake.operators.decode import split_frames

    df = spark.createDataFrame([('{"a": 12345678901234567890.123450} {"b": null}',), (None,)], "value string")
    assert [r.value for r in split_frames(df).collect()] == ['{"a": "12345678901234567890.123450"}', '{"b": null}']


def test_ieee_bytes(spark):
    from mirrorlake.functions.positions import ieee_text

    df = spark.createDataFrame([("3FB999999999999A",), ("3DCCCCCD",), (None,)], "h string")
    assert [r[0] for r in df.select(ieee_text(F.col("h"))).collect()] == ["0.1", "0.1", None]
