"""File sink, HTTP delivery and the status file."""

import hashlib
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from mirrorlake.model import ReplicationError, TransientError
from mirrorlake.sinks.files import object_name, write_files
from mirrorlake.sinks.http import Sender, delays, push_metrics
from mirrorlake.sinks.status import status, write_status
from mirrorlake.sources.log import Log

FILES = "path string, operation string, content binary, sha256 string, mode int, mod_time_unix_nano long, seq long"


def changes(spark, rows):
    return spark.createDataFrame(rows, FILES)


def put(path, content, seq=1, digest=None):
    return (path, "create", content, digest, 0o640, 1_700_000_000_000_000_000, seq)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_files_are_put_and_deleted(spark, tmp_path):
    rows = [put("a/b.txt", b"one"), put("a/b.txt", b"two", 2), put("c", b""), put("d", None), put("gone", b"x"), ("gone", "delete", None, None, None, None, 2)]
    assert write_files(changes(spark, rows), str(tmp_path), prefix="/p/", order="seq") == {"put": 3, "delete": 1}
    assert tree(tmp_path) == {"p/a/b.txt": b"two", "p/c": b"", "p/d": b""}
    found = os.stat(tmp_path / "p/a/b.txt")
    assert (found.st_mode & 0o777, found.st_mtime_ns) == (0o640, 1_700_000_000_000_000_000)
    assert write_files(changes(spark, rows), f"file://{tmp_path}", prefix="p", order="seq")["put"] == 3  # again
    assert tree(tmp_path) == {"p/a/b.txt": b"two", "p/c": b"", "p/d": b""}
    assert write_files(changes(spark, rows).limit(0), str(tmp_path)) == {"put": 0, "delete": 0}


@pytest.mark.parametrize("path", ["", None, "/etc/x", "../x", "a/../../x", "a\x00b", ".incoming/x", "./.incoming/x"])
def test_unsafe_paths_write_nothing(spark, tmp_path, path):
    with pytest.raises(ReplicationError):
        write_files(changes(spark, [put("fine", b"1"), put(path, b"2")]), str(tmp_path))
    assert tree(tmp_path) == {}


def test_links_and_wrong_hashes_are_refused(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    root.mkdir(), other.mkdir()
    (root / "out").symlink_to(other)
    with pytest.raises(Exception, match="leads out"):
        write_files(changes(spark, [put("out/x", b"1")]), str(root))
    with pytest.raises(Exception, match="match its hash"):
        write_files(changes(spark, [put("x", b"1", digest="00")]), str(root))
    write_files(changes(spark, [put("x", b"1", digest=hashlib.sha256(b"1").hexdigest())]), str(root))
    assert tree(other) == {} and (root / "x").read_bytes() == b"1"


def test_object_names():
    assert [object_name(p, "a/b") for p in ("", "/", "x/", "/x/y/")] == ["a/b", "a/b", "x/a/b", "x/y/a/b"]


@pytest.fixture
def receiver():
    """A receiver whose answers are scripted; ``None`` acknowledges."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            server.got.append((self.headers["Idempotency-Key"], body))
            code, answer = server.script.pop(0) if server.script else (200, None)
            if answer is None and code == 200:
                m = json.loads(body)
                answer = json.dumps({"message_id": m["message_id"], "ack_seq": m["seq"]}).encode()
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/elsewhere")
            self.end_headers()
            self.wfile.write(answer or b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.got, server.script = [], []
    server.url = f"http://127.0.0.1:{server.server_port}/"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def filled(spark, path, n=5):
    log = Log(spark, str(path))
    log.initialise("g1", "f")
    log.append(spark.createDataFrame([(i, "snapshot_begin", "s", f"2024-01-0{i + 1}") for i in range(n)], "_order int, kind string, source_id string, created_at string"))
    log.publish()
    return log


def test_messages_arrive_in_order_and_are_acknowledged(spark, tmp_path, receiver):
    log, waits = filled(spark, tmp_path), []
    receiver.script = [(200, None), (503, None), (429, None), (200, None)]
    sender = Sender(receiver.url, wait=waits.append)
    assert sender.drain(log, window=2) == 5
    assert [k for k, _ in receiver.got] == [f"s/g1/{i}" for i in (1, 2, 2, 2, 3, 4, 5)]
    assert receiver.got[1] == receiver.got[3] and sender.retries == 2 and len(waits) == 2
    assert log.state().delivered_seq == 5 and sender.drain(log) == 0


@pytest.mark.parametrize("answer", [(400, None), (302, None), (200, b"no json"), (200, b"[]"), (200, b'{"message_id": "s/g1/2", "ack_seq": 9}'), (200, b" " * 70_000)])
def test_a_fatal_answer_keeps_what_got_through(spark, tmp_path, receiver, answer):
    log = filled(spark, tmp_path)
    receiver.script = [(200, None), answer]
    with pytest.raises(ReplicationError):
        Sender(receiver.url).drain(log)
    assert log.state().delivered_seq == 1 and len(receiver.got) == 2


def test_an_unreachable_receiver_is_tried_again(spark, tmp_path):
    waits = []
    with pytest.raises(TransientError):
        Sender("http://127.0.0.1:9/", attempts=3, wait=waits.append).send(1, "m", b"{}")
    assert len(waits) == 2 and not push_metrics("http://127.0.0.1:9/", "x 1\n", timeout=1)


def test_delays_double_up_to_the_limit():
    found = delays(1, 5, jitter=lambda: 1.0)
    assert [next(found) for _ in range(5)] == [1, 2, 4, 5, 5]
    assert next(delays(4, 5, jitter=lambda: 0.0)) == 2


def test_status_file(spark, tmp_path):
    log = filled(spark, tmp_path / "log")
    log.acknowledge_through(2)
    write_status(str(tmp_path / "status.json"), status(log))
    found = json.loads((tmp_path / "status.json").read_text())
    assert (found["pending"], found["delivered_seq"], found["oldest_pending_at"], found["nearly_full"]) == (3, 2, "2024-01-03", False)
    log.acknowledge_through(5)
    assert status(log)["oldest_pending_at"] is None
    assert [p.name for p in tmp_path.glob("*.draft")] == []
