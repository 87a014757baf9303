"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorlake.llm import decontam, langid, lm, mixing, quality, simhash, tokencount, topk, urlgraph, warc

LONG = "wort " * 200_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5, "x"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5, "x"),
        (2, None, None, None, None, None), (3, "", "en", "a", 0, ""), (4, " \n\t", "fr", None, 1, None), (5, "12 !! 34", "fr", "b", 1, None),
        (6, LONG, "de", "b", 1, None), (None, "tiny text", None, "b", None, None), (8, "Ünïcode ünïcode ÉÉ", "fr", "zz", 3, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(7, "TWO three four five six seven eight nine ten eleven"), (10, "Tiny, text"), (11, None), (12, "??"), (None, "wort"), (7, "Ünïcode ünïcode"), (9, "one two three four five six seven eight nine ten")], "item_id long, text string")
    clash = odd.withColumn("n_hit", F.lit("old"))
    for block in (64 << 20, 200):  # one block, several
        got = decontam.scan(clash, bench, block_bytes=block)
        assert got.columns == [*odd.columns, "n_words", "n_hit", "hit_spans", "hit_items"]
        by = {r.doc_id: r for r in got.collect()}
        assert got.count() == 9
        assert (by[1].n_words, by[1].n_hit, by[1].hit_items) == (11, 11, ["7", "9"]) and by[1].hit_spans == [0, 11]
        assert (by[2].n_words, by[2].n_hit, by[3].n_words, by[4].n_words, by[5].n_words) == (0, 0, 0, 0, 2)
        assert (by[6].n_hit, by[6].hit_items) == (200_000, []) and by[None].hit_items == ["10"]
        assert by[8].hit_items == ["7"] and by[8].n_hit == 2 and by[8].n_words == 3
    assert decontam.scan(empty, bench).count() == 0
    assert decontam.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    left = decontam.decontaminate(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(odd, bench, remove="spans").collect()}
    assert cut[1] == "" and cut[8] == " ÉÉ" and cut[2] is None and cut[5] == "12 !! 34"


def test_language(spark, odd, empty):
    more = spark.createDataFrame([(i, ("le chat est là " if i % 2 else "the cat sat here ") * (1 + i % 5), "fr" if i % 2 else "en", "s", 1, "") for i in range(100, 180)], DOCS)
    net = langid.train(more)
    got = langid.predict(odd.withColumn("Lang_Pred", F.lit(1)), net)
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 8 and got.count() == 9 and all(0 <= r.score <= 1 for r in by.values())
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 5)) and by[6].lang_pred in ("fr", "en")
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.train(empty) is None and langid.predict(empty, net).count() == 0
    ok = langid.predict(more, net)
    assert ok.where("lang = lang_pred").count() == 80
    assert langid.keep_identified(odd, net).columns == odd.columns


def test_network_tables_equal_the_convolution():
    net = langid.ByteConvNet(["a", "b", "c"])
    data = np.random.default_rng(0).integers(0, 256, langid.STEP * 5 + 3, dtype=np.uint8)
    got = langid.Predictor(net).log_probs(data)
    for k in range(5):
        window = data[k * langid.STEP : k * langid.STEP + langid.WINDOW]
        emb, pooled = net.p["E"][window], []
        for w in langid.WIDTHS:
            z = np.stack([emb[t : t + w].ravel() @ net.p[f"W{w}"] for t in range(langid.STEP)]) + net.p[f"b{w}"]
            pooled.append(z.max(0))
        z = np.maximum(np.concatenate(pooled), 0) @ net.p["D"] + net.p["c"]
        assert np.allclose(got[k], z - np.log(np.exp(z).sum()), atol=1e-4)


def brute_top(vectors, k):
    out = []
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for qi, q in good:
        if qi % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in good if i != qi)[:k]
            out += [(qi, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "clustered", "lengths", "odd", "huge"])
def test_top_k(spark, case):
    r = np.random.default_rng(5)
    if case == "odd":
        rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (50, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.5]), (8, [3.0])]
    elif case == "huge":
        rows = [(i, [float(x) for x in r.normal(0, 1e6, 3)]) for i in range(120)]
    else:
        v = r.normal(0, 0.2, (400, 8)) if case != "clustered" else r.normal(0, 1, 8) + r.normal(0, 0.02, (400, 8))
        if case == "lengths":
            v *= r.lognormal(0, 1.5, (400, 1))
        v[300:] = v[300]  # ties
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    for block in (8192, 3):
        got = topk.top_k(df, queries=F.col("vec_id") % 50 == 0, k=5, query_block=block)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    assert topk.top_k(df.limit(0), queries=F.col("vec_id") % 50 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    same, umlaut = "x" * 100, "ü" * 50
    rows = [(3, "http://a/\r\nx", same), (1, "http://b/", same), (2, None, same), (4, "u", "y" * 99), (5, "u", "y" * 99), (6, "u", None), (7, "u", ""), (8, "u", umlaut), (9, "u", umlaut), (None, "u", same), (10, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    path = warc.archive(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_pages(spark, path, payload="full").collect()}
    assert len(got) == 11
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        assert got[i].payload is None or bytes(got[i].payload) == data
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {2: ("revisit", 1), 3: ("revisit", 1), 9: ("revisit", 8)}
    raw = spark.read.format("warc").option("payload", "none").load(path)
    assert raw.where("record_type = 'revisit'").count() == 3
    assert raw.where("record_id IN ('urn:page:1', 'urn:page:4')").count() == 2 and raw.where("target_uri = 'http://b/'").first().record_id == "urn:page:1"
    assert warc.archive(pages.limit(0), str(tmp_path / "none")) and warc.read_pages(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("gz", [True, False])
def test_warc_payloads_that_are_not_wanted_are_skipped(gz):
    import io
    import zlib

    row = lambda i: {"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_bytes": 9, "payload": b"a\r\n\r\nb" * 50_000}
    made = [warc.record_bytes(row(i)) for i in range(4)]
    plain = zlib.compressobj(1, zlib.DEFLATED, 31)  # a member without a length field
    data = b"".join([warc.gzip_member(made[0]), plain.compress(made[1]) + plain.flush(), *map(warc.gzip_member, made[2:])]) if gz else b"".join(made)
    taken = list(warc.records(io.BytesIO(data), len(data), gz, lambda f: f["record_id"].endswith(("1", "3")), True))
    assert [f["record_id"] for f, _ in taken] == ["urn:page:1", "urn:page:3"] and all(p == b"a\r\n\r\nb" * 50_000 for _, p in taken)
    assert len(list(warc.records(io.BytesIO(data), len(data), gz, lambda f: True, False))) == 4


def simulate(blocks, weights):
    """Earliest deadline first, period by period."""
    left, order = dict(blocks), []
    done_before = dict.fromkeys(blocks, 0)
    while any(left.values()):
        b = {p: min(weights[p], left[p]) for p in left}
        d = sum(b.values())
        done = dict.fromkeys(b, 0)
        for t in range(d):
            ready = [(-(-(done[p] + 1) * d // b[p]), k, p) for k, p in enumerate(b) if done[p] < b[p] and done[p] * d // b[p] <= t]
            due, _, p = min(ready)
            assert due > t
            done[p] += 1
            assert all(abs(done[q] - b[q] * (t + 1) / d) < 1 for q in b)
            order.append((p, done_before[p] + done[p] - 1))
        for p in b:
            left[p] -= b[p]
            done_before[p] += b[p]
    return order


def test_mix(spark, odd, empty):
    weights = {"a": 3, "b": 2, "c": 1}
    r = random.Random(1)
    rows = [(i, r.choice("aaaabbcxx") if i % 11 else None, "p") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, POOL string")
    got = mixing.schedule(df, weights, rest_weight=1, block_docs=4).collect()
    assert sorted(g.doc_id for g in got) == list(range(500))
    pools = {p: sorted((i for i, s, _ in rows if (s if s in weights else "*") == p), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for p in ["a", "b", "c", "*"]}
    place = {x: k for k, x in enumerate(simulate({p: -(-len(v) // 4) for p, v in pools.items()}, {**weights, "*": 1}))}
    want = {i: (p, k // 4, place[p, k // 4], k % 4) for p, ids in pools.items() for k, i in enumerate(ids)}
    assert {g.doc_id: (g.pool, g.block, g.slot, g.in_block) for g in got} == want
    out = mixing.schedule(odd, weights)
    assert out.count() == 9 and out.select("slot", "in_block").distinct().count() == 9
    assert mixing.schedule(empty, weights).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": 0})


def test_lm(spark, odd, empty):
    out = lm.score(odd.withColumn("score", F.lit("old")), train=F.col("doc_id") != 5)
    assert out.count() == 9 and out.columns == [*odd.columns, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    by = {r.doc_id: r for r in out.collect()}
    assert (by[2].n_tokens, by[3].n_tokens, by[6].n_tokens) == (1, 1, 200_001) and by[None].n_known == 1
    assert lm.score(empty, train=F.lit(True)).count() == 0
    none = lm.score(odd, train=F.lit(False)).first()
    assert none.train_tokens == 0 and none.n_known == 0 and none.score == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_token_trees_survive_random_edits(seed):
    r, counter = random.Random(seed), tokencount.Counter(tokencount.load_ranks())
    alphabet = ["a", "b", "'", "ll", " ", "  ", "\n", "7", "é", "!", "don't", "word "]
    text = "".join(r.choice(alphabet) for _ in range(600))
    tree = tokencount.TokenTree(text, counter)
    for k in range(150):
        a = r.randrange(len(tree.text) + 1)
        b = min(len(tree.text), a + r.choice([0, 0, 1, 3, 40]))
        new = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 30])))
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text)), k
        assert [x for lengths, _ in tree.leaves for x in lengths] == list(map(len, tokencount._SPLIT.findall(text)))
    again = tokencount.TokenTree.from_bytes(text, tree.to_bytes(), counter)
    assert again.n_tokens == tree.n_tokens
    assert tree.reencoded < 150 * 60


def test_token_counts(spark, odd, empty):
    out = tokencount.count_with_edits(odd.withColumn("n_edits", F.lit("x")), with_text=True)
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[6].n_pretokens == 200_001 and out.count() == 9
    assert tokencount.count_with_edits(empty).count() == 0
    edits = spark.createDataFrame([(8, 0, 0, "new "), (8, 4, 7, ""), (99, 0, 0, "x")], "doc_id long, start long, stop long, new string")
    again = {r.doc_id: r for r in tokencount.recount(out.where("doc_id IN (5, 8)"), edits).collect()}
    encode = tokencount.Counter(tokencount.load_ranks()).encoding.encode_ordinary
    assert again[8].text_after == "new Ünïc ünïcode ÉÉ" and all(r.n_tokens == len(encode(r.text_after)) for r in again.values())


def test_simhash(spark, odd, empty):
    got = simhash.near_duplicates(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 9 and by[2].component_id == by[3].component_id == by[4].component_id == 2 and by[2].fp == 0
    assert by[1].component_id == 1
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 5, 6, 8]


def links_components(spark, fps, block, radius=3):
    df = spark.createDataFrame([(int(np.int64(np.uint64(f))),) for f in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.near_links(df, block=block, radius=radius), few=block).collect()}
    return [found.get(int(n), int(n)) for n in simhash.node_of(np.array(fps, np.uint64))]


@pytest.mark.parametrize(("block", "n"), [(512, 600), (16, 400)])
def test_near_links_equal_brute_force(spark, block, n):
    r = np.random.default_rng(block)
    fps = {int(x) for x in r.integers(0, 2**64, n, dtype=np.uint64)}
    centre = int(r.integers(0, 2**64, dtype=np.uint64))
    for _ in range(n):  # a large group of near copies, and chains out of it
        x = centre
        for b in r.integers(0, 64, r.integers(0, 7)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    label = np.arange(len(f))
    while not ((new := np.array([label[m].min() for m in near])) == label).all():
        label = new
    got = links_components(spark, fps, block)
    assert len(set(zip(label.tolist(), got, strict=True))) == len(set(label.tolist())) == len(set(got))


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)}


def test_similar(spark, odd, empty):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randrange(60, 400))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8, 30):
            copy = list(base)
            for at in r.sample(range(len(base)), edits):
                copy[at] = word()
            texts.append("  ".join(copy).upper())
    centre = [word() for _ in range(300)]
    for _ in range(150):  # a large group of near copies: one component in any blocks
        copy = list(centre)
        copy[r.randrange(300)] = word()
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(360) for j in range(i + 1, (i // 6 + 1) * 6)}
    for block in (simhash.WIDE_BLOCK, 40):
        of = {x.doc_id: x.component_id for x in simhash.similar(docs, block=block).collect()}
        near = [p for p, s in alike.items() if s >= 0.8]
        assert len(near) > 60 and sum(of[i] == of[j] for i, j in near) >= 0.9 * len(near)
        assert all(of[i] == of[j] for (i, j), s in alike.items() if s >= 0.88)
        assert not any(of[i] == of[j] for (i, j), s in alike.items() if i % 6 == 0 and s < 0.6)
        assert {of[i] for i in range(360, 510)} == {360} and all(of[i] // 6 == i // 6 for i in range(360))
    by = {x.doc_id: x for x in simhash.similar(odd).collect()}
    assert by[2].component_id == by[3].component_id == by[4].component_id == 2 and by[2].fp == bytes(8 * simhash.WORDS) and by[1].component_id == 1
    assert simhash.similar(empty).count() == 0
    kept = simhash.keep_one(odd, find=simhash.similar)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 5, 6, 8]


def test_similar_is_exact_on_short_and_long_texts(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**9)}"
    texts = []
    for words, more in [(8, 1), (8, 2), (9, 1), (10, 1), (16, 3), (16, 4), (2, 1)]:  # shingles against shingles plus some
        for _ in range(30):
            base = [word() for _ in range(words)]
            texts += [" ".join(base), " ".join([*base, *(word() for _ in range(more))])]
    for cut in (30, 39, 40, 41, 45, 60):
        for _ in range(20):
            base = [word() for _ in range(204)]
            texts += [" ".join(base), " ".join(base[: 204 - cut])]
    for _ in range(15):  # lists of more members than are compared with all others, not all of them similar
        base = [word() for _ in range(44)]
        texts += [" ".join(base), " ".join(base[:36])]
    line = [word() for _ in range(8)]
    texts += [" ".join([*line, word()]) for _ in range(40)] + [" ".join([*line, *(word() for _ in range(30))]) for _ in range(40)]
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"block": 16}):
        of = {x.doc_id: x.component_id for x in simhash.similar(docs, **options).collect()}
        assert [of[i] for i in range(len(texts))] == label


def test_pipeline_links_by_fingerprints_and_by_similarity(spark, data):
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for i in range(300):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in range(0, 300, 300 // (7 if i % 2 else 4)):  # a similarity of 0.75 to 0.79 or above 0.8
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    fps, sets = [simhash.fingerprint(t.encode()) for t in texts], [shingle_set(t) for t in texts]
    pairs = [(i, (fps[i] ^ fps[i + 1]).bit_count() <= 3, len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])) for i in range(0, 600, 2)]
    assert {p[1:] for p in pairs} == {(True, False), (False, True), (True, True), (False, False)}
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, data).collect()}
    assert kept == set(range(600)) - {i + 1 for i, near, alike in pairs if near or alike}


@pytest.mark.parametrize("find", [simhash.near_duplicates, simhash.similar])
def test_one_row_of_each_component_stays(spark, find):
    a, b, c, d = ("alpha one two three four five six", "bravo seven eight nine ten eleven twelve", "charlie red green blue cyan pink grey", "delta north south east west up down")
    rows = [(5, a), (7, a), (5, b), (2, b), (None, c), (None, c), (9, d), (None, d), (9, d), (5, c + " " + d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs, find=find).collect()), key=str)
    assert kept == sorted([(5, a), (2, b), (None, c), (9, d), (5, c + " " + d)], key=str)


def test_partitions_of_similar_sets_meet():
    rng, classes, counts = np.random.default_rng(4), simhash.Classes(0.8), np.zeros(simhash.SLOTS, np.uint32)
    assert classes.of(1) == classes.of(16) == 0 and classes.of(17) == 1 and all(classes.last[classes.of(n)] < n <= classes.last[classes.of(n) + 1] for n in range(1, 3000))
    for n in [*range(1, 60), 100, 333, 1000, 2500]:
        for m in sorted({math.ceil(0.8 * n - 1e-9), (9 * n + 9) // 10, n}):
            for _ in range(5):
                common = math.ceil(0.8 / 1.8 * (n + m) - 1e-9)  # just similar
                if common > m:
                    continue
                pool = np.unique(rng.integers(0, 2**64 - 1, n + m, np.uint64))
                rng.shuffle(pool)
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + m - common]]))
                (va, fa), (vb, fb) = simhash.set_entries(a, classes, counts), simhash.set_entries(b, classes, counts)
                assert set(va[(fa & simhash.PROBE) > 0].tolist()) & set(vb[(fb & simhash.INDEX) > 0].tolist()), (n, m)


def test_plan_is_a_general_pigeonhole():
    r = np.random.default_rng(1)
    for n in (10, 10_000, 10**9):
        p = r.uniform(0.2, 0.8, 64)
        both = np.outer(p, p) * n
        np.fill_diagonal(both, p * n)
        groups, thresholds = simhash.plan(n, both)
        assert sorted(b for g in groups for b in g) == list(range(64)) and sum(t + 1 for t in thresholds) == 4


def test_url_graph(spark):
    rules = [urlgraph.Rule("allow", "good.com", "/"), urlgraph.Rule("block", "bad.com", "/"), urlgraph.Rule("block", "good.com", "/x/")]
    link = lambda *hosts: "".join(f'<a HREF="http://{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://A.good.com/", link("friend.org", "/local")), (2, "https://bad.com/?q#f", ""), (3, "http://suspect.org/a?b", link("bad.com", "bad.com")), (4, "http://friend.org#z", None),
        (5, None, "x"), (6, "no scheme", ""), (7, "http://good.com/x/y", ""), (8, "http://worse.org/", link("suspect.org")), (8, "http://worse.org/", link("suspect.org")), (9, "http://far.net/p?http://bad.com/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("?"))
    got = {r.page_id: r for r in urlgraph.judge(pages, rules).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow"}
    assert (got[1].host, got[1].path, got[1].rule) == ("a.good.com", "/", "good.com/") and (got[2].host, got[2].path, got[2].rule) == ("bad.com", "/", "bad.com/")
    assert (got[7].rule, got[9].path, got[5].host, got[6].path) == ("good.com/x/", "/p", "", "")
    assert got[4].trust > 0 and got[3].distrust > got[8].distrust > 0
    assert urlgraph.judge(pages.limit(0), rules).count() == 0


def test_url_graph_settles_on_long_chains(spark):
    rules = [urlgraph.Rule("block", "h0.org", "/"), urlgraph.Rule("allow", "c0.org", "/")]
    links = {f"h{i}.org": [f"h{i - 1}.org"] for i in range(1, 14)} | {"h0.org": [], "c0.org": ["c1.org"], "c1.org": ["c2.org", "c0.org"], "c2.org": ["c1.org", "h3.org"]}
    rows = [(i, f"http://{h}/", "".join(f'<a href="http://{x}/">t</a>' for x in to)) for i, (h, to) in enumerate(links.items())]
    got = {r.host: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    hosts = sorted(links)
    for kind, seed in (("trust", "c0.org"), ("distrust", "h0.org")):
        edges = [(a, b) if kind == "trust" else (b, a) for a in hosts for b in links[a]]
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in edges:
            m[hosts.index(b), hosts.index(a)] = 0.85 / sum(x == a for x, _ in edges)
        want = np.linalg.solve(np.eye(len(hosts)) - m, 0.15 * np.array([h == seed for h in hosts]))
        assert np.allclose([got[h][kind] for h in hosts], want, rtol=1e-5, atol=0)
    assert all(got[f"h{i}.org"].verdict == "block" for i in range(4, 14))


def test_quality(spark, odd, empty):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) + ("!!$$" if i % 3 == 0 else "") for _ in range(20)), "en", "s", 1, "") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int").withColumn("text", F.lit("leak"))
    both = docs.unionByName(odd)
    stats = quality.document_statistics(both, keep=["doc_id"])
    model = quality.fit(stats, labels, train_rows=F.col("doc_id") < 500, calibrate=F.col("doc_id") % 4 == 3)
    got = {r.doc_id: r for r in quality.score(stats, model).collect()}
    assert all(got[i].predicted == int(i % 3 != 0) for i in range(500, 600)) and all(0 <= g.score <= 1 for g in got.values())
    assert quality.score(stats, model).count() == 609
    none = quality.fit(stats, labels.limit(0), train_rows=F.lit(True), calibrate=F.lit(False))
    assert none is None and {r.score for r in quality.score(stats, none).collect()} == {0.5}
    assert quality.document_statistics(empty, keep=["doc_id"]).count() == 0
    kept = quality.keep_good(docs, labels, train_rows=F.lit(True), calibrate=F.col("doc_id") % 4 == 3)
    assert kept.columns == docs.columns and kept.count() == 400


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), min_size=1, max_size=30))
def test_isotonic_rises_and_keeps_the_mean(points):
    w, m = (np.array(x, float) for x in zip(*points, strict=True))
    fit = quality.isotonic(w, m)
    assert len(fit) == len(m) and (np.diff(fit) >= -1e-12).all() and np.isclose((w * fit).sum(), (w * m).sum())
