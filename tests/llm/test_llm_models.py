"""Models against plain versions, foreign archives, stages on odd tables, and sessions whose workers don't have the package."""

import gzip
import hashlib
import random
import subprocess
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorlake.llm import langid, quality, topk, warc
from mirrorlake.llm.common import per_task_vector

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = Path(__file__).resolve().parents[2]


def plain_prediction(net, text):
    """The network on one text, a window after the other, without tables."""
    data = (text or "").encode()
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    n = max(1, -(-(len(data) + 3) // langid.STEP))
    padded = data.ljust(n * langid.STEP + 3, b" ")
    total, weights = 0.0, 0
    for i in range(n):
        emb = net.p["E"][np.frombuffer(padded[i * langid.STEP : i * langid.STEP + langid.WINDOW], np.uint8)].astype(np.float64)
        pooled = [np.max([emb[t : t + w].ravel() @ net.p[f"W{w}"] for t in range(langid.STEP)], axis=0) + net.p[f"b{w}"] for w in langid.WIDTHS]
        z = np.maximum(np.concatenate(pooled), 0) @ net.p["D"] + net.p["c"]
        weight = langid.STEP if i < n - 1 else max(1, len(data) - i * langid.STEP)
        total, weights = total + weight * (z - np.log(np.exp(z).sum())), weights + weight
    p = np.exp(total / weights)
    return net.languages[int(p.argmax())], float((p / p.sum()).max())


def test_predictions_equal_the_plain_network(spark):
    rng = random.Random(2)
    words = {"en": "the cat sat on here with some".split(), "fr": "le chat était là avec une été".split(), "xx": "ök zü äh öl üb zö".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.choice([1, 5, 60, 300]))), x, "s", 1) for i in range(90) for x in [rng.choice(sorted(words))]]
    docs = spark.createDataFrame([*rows, (900, "½ ² Ⅷ ①", None, None, None), (901, "1ª", "en", "s", 1), (902, None, "en", "s", 1), (903, "漢字", None, "s", 1)], DOCS)
    net = langid.train(docs, where=F.col("doc_id") < 900)
    got = {r.doc_id: (r.text, r.lang_pred, r.score) for r in langid.predict(docs, net).collect()}
    assert got[900][1:] == ("und", 0.0) and got[901][1] != "und" and got[902][1] == "und" and got[903][1] != "und"
    for text, lang, score in got.values():
        want, p = plain_prediction(net, text)
        assert lang == want and abs(score - p) < 1e-4




def test_quality_equals_normal_equations_and_a_plain_isotonic_fit(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc de. !x9\n") for _ in range(rng.randint(0, 400))) for _ in range(400)]
    y = [int(t.count("a") + rng.randint(0, 12) > 22) for t in texts]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, "", None, texts[0]])], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, quality int")
    stats = quality.document_statistics(docs, keep=["doc_id"])
    model = quality.fit(stats, labels, train_rows=F.col("doc_id") % 4 != 2, calibrate=F.col("doc_id") % 4 == 3)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(stats, model).collect()}
    x = np.array([quality.statistics(t.encode()) for t in texts])
    used = np.array([i for i in range(400) if i % 4 != 2])
    mean, scale = x[used].mean(0), x[used].std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = lambda rows: np.concatenate([np.sqrt(2 / quality.COMPONENTS) * np.cos(np.clip((rows - mean) / scale, -6, 6) @ model.omega + model.phase), np.ones((len(rows), 1))], 1)
    fit = np.array([i for i in used if i % 4 != 3])
    ridge = np.diag([quality.RIDGE] * quality.COMPONENTS + [1e-6])
    w = np.linalg.solve(z(x[fit]).T @ z(x[fit]) + ridge, z(x[fit]).T @ np.array(y)[fit])
    assert np.allclose(model.weights, w, rtol=1e-5, atol=1e-7)
    # isotonic by the formula max over starts, min over ends, of means of the calibration rows' bins
    held = np.array([i for i in used if i % 4 == 3])
    bins = np.clip(((z(x[held]) @ w + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    order = sorted(set(bins.tolist()))
    n, s = [int((bins == b).sum()) for b in order], [float(np.array(y)[held][bins == b].sum()) for b in order]
    value = [max(min(sum(s[i : j + 1]) / sum(n[i : j + 1]) for j in range(k, len(order))) for i in range(k + 1)) for k in range(len(order))]
    every = np.interp(z(x) @ w, (np.array(order) + 0.5) / quality.BINS * 2 - 0.5, value)
    assert np.allclose([got[i][0] for i in range(400)], every, atol=1e-6) and got[402][0] == got[0][0]
    assert got[400] == got[401] and all(p == int(v >= 0.7) for v, p in got.values())


def test_without_labels_all_documents_stay(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 1), (2, None, None, None, None)], DOCS)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    for labels in (none, none.limit(0)):
        assert quality.keep_good(docs, labels, train_rows=F.lit(True), calibrate=F.lit(False)).count() == 2
    assert quality.keep_good(docs.limit(0), none, train_rows=F.lit(True), calibrate=F.lit(False)).count() == 0


def test_repeated_ids_keep_their_queries_apart_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(50 * (i % 9), [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [sorted(map(tuple, topk.top_k(df, queries=F.col("vec_id") % 50 == 0, k=5, query_block=b).collect())) for b in (8192, 7)]
    assert found[0] == found[1] and len(found[0]) == 300


def test_foreign_archives(spark, tmp_path):
    """Digests of another kind, records of other types, blocks without a blank line."""
    record = lambda kind, i, block, digest, content="application/http; msgtype=response": (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n{f'WARC-Payload-Digest: {digest}' + chr(13) + chr(10) if digest else ''}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    )
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    made = [
        record("warcinfo", 0, b"software: x\r\n", None, "application/warc-fields"),
        record("response", 1, http + b"page one", "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"),
        record("response", 2, b"HTTP/1.1 200 OK and then nothing", None),
        record("response", 3, http + b"three", "sha256:" + hashlib.sha256(b"three").hexdigest()),
        record("request", 4, b"GET / HTTP/1.1\r\n\r\n", None, "application/http; msgtype=request"),
        record("response", 5, http, "md5:abc"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    warc.register(spark)
    for mode in ("full", "digest", "none"):
        rows = spark.read.format("warc").option("payload", mode).load(str(tmp_path))
        assert rows.count() == 12
        by = {r.record_id: r for r in rows.collect()}
        if mode == "full":
            assert bytes(by["urn:uuid:1"].payload) == b"page one" and bytes(by["urn:uuid:2"].payload).startswith(b"HTTP/1.1 200 OK and") and bytes(by["urn:uuid:5"].payload) == b""
            assert by["urn:uuid:1"].payload_digest.startswith("sha1:3I42")
        want = hashlib.sha256(b"three").hexdigest()
        assert by["urn:uuid:3"].payload_digest == want and rows.where(F.col("payload_digest") == want).count() == 2
        if mode == "digest":
            assert by["urn:uuid:1"].payload_digest == hashlib.sha256(b"page one").hexdigest()
            assert rows.where(F.col("payload_digest") == by["urn:uuid:2"].payload_digest).count() == 2
    bad = record("response", 6, http + b"six", "sha256:" + "0" * 64)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.warc").write_bytes(bad)
    with pytest.raises(Exception, match="does not match"):
        spark.read.format("warc").option("payload", "digest").load(str(tmp_path / "c")).collect()


def test_stages_on_odd_and_empty_tables(spark, data):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "en", "src0", 5), (1, text, "en", "src0", 5), (1, text + " twelve", "en", "src1", 5), (None, text, None, None, None), (2, None, None, None, None), (3, "", "fr", "", 0), (4, " \n", None, "x", 1), (5, "wort " * 100_000, "de", "src1", 1)]
    odd = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, data)
            assert out.columns[:5] == docs.columns, name
            kept = [tuple(r)[:5] for r in out.collect()]
            assert len(kept) <= docs.count() and all(k in rows for k in kept), name
            if name == "near_duplicates" and docs is odd:  # one of the four alike, one without words
                assert sorted((i, t) for i, t, *_ in kept) == sorted([(1, min((text, text + " twelve"), key=lambda t: (1, t) not in [(k[0], k[1]) for k in kept])), (2, None), (5, rows[7][1])], key=str)


def test_operators_ship_the_package_to_workers_that_lack_it(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from mirrorlake.llm import {{}}
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (50, "g h")], "doc_id long, text string")
print("found", {{}})
"""
    calls = {
        "simhash": "simhash.keep_one(docs).count()", "decontam": "decontam.scan(docs, docs.toDF('item_id', 'text')).count()", "tokencount": "tokencount.count_with_edits(docs).count()",
        "quality": "quality.document_statistics(docs, keep=['doc_id']).count()", "lm": "lm.score(docs, train=F.lit(True)).count()",
    }
    script = code.format(", ".join(calls), ", ".join(calls.values()))
    env = {"PATH": str(Path(sys.executable).parent) + ":/usr/bin:/bin", "PYSPARK_PYTHON": sys.executable}
    import os

    env |= {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "HOME", "SPARK_LOCAL_IP", "PATH")}
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd="/tmp", capture_output=True, text=True, timeout=300)
    assert "found 2 3 3 3 3" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("tasks", [3, 8, 70])
def test_the_driver_gets_one_long_vector_in_small_rows(spark, monkeypatch, tasks):
    kind, size, got = type(spark.range(0)), 1 << 20, []
    collect = kind.collect

    def add(total, batch):
        total[batch.column(0).to_numpy()] += 1
        total[-1] += batch.num_rows

    def collected(self):
        got.extend(rows := collect(self))
        return rows

    monkeypatch.setattr(kind, "collect", collected)
    found = per_task_vector(spark.range(0, 1000, 1, tasks), size, add)
    assert found.nonzero()[0].tolist() == [*range(1000), size - 1] and found[:1000].max() == 1 and found[-1] == 1000
    blobs = [len(r.blob) for r in got]
    assert sum(blobs) == 8 * size and max(blobs) <= 1 << 18  # before, up to eight vectors, each in one row of 8 MB


@pytest.mark.parametrize("size", [1, 33, 1 << 15, (1 << 16) + 5])
def test_vectors_of_any_length_are_summed(spark, size):
    def add(total, batch):
        total += batch.column(0).to_numpy().sum() * np.arange(1, size + 1)

    assert (per_task_vector(spark.range(0, 500, 1, 19), size, add) == 499 * 250.0 * np.arange(1, size + 1)).all()
    assert per_task_vector(spark.range(0), size, add) is None
