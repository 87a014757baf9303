"""The registered queries: SQL where there is some, brute force where not."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from mirrorlake.llm import lm, queries
from test_llm_lm import plain_model


def rows(df):
    return [tuple(r) for r in df.select(*sorted(df.columns)).collect()]


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, data, name):
    df = queries.QUERIES[name](spark, data)
    want = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.ORACLE_SQL[name]}) z").fetchall()
    assert sorted(map(str, rows(df))) == sorted(map(str, want))


def test_lm_scores(spark, data, texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    _, model, (total, v) = plain_model([[w.hex() for w in ws] for i, ws in words.items() if not held(i)], lm.ORDER, lm.MU)
    uni = Counter(w for i, ws in words.items() if not held(i) for w in [*ws, None])
    got = {r.doc_id: r for r in queries.op6_lm_score(spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, ws in words.items():
        r, s = got[i], [*ws, None]
        base = sum(math.log10((uni[y] + 1) / (total + v + 1)) for y in s)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(s), sum(uni[y] > 0 for y in s), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, model([w.hex() for w in ws]), rel_tol=1e-9)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    label = np.arange(len(ids))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label.tolist(), strict=True)}
        label = new


def test_simhash_components(spark, data, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, data).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    comps = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comps[i]) for i in texts}


def test_language_accuracy_on_held_out_documents(spark, con):
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = dict(con.execute("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_quality_ranks_held_out_documents(spark, con):
    found = queries.op10_quality(spark, "/root/testdata/sf0.01").collect()
    label = dict(con.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [(r.score, label[r.doc_id]) for r in found if r.held_out and r.doc_id in label]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in found) and np.mean([g >= 0.7 for g in good]) > 0.95


def test_token_counts_equal_a_full_encoding(spark, data, texts):
    from mirrorlake.llm import tokencount as tc

    encode = tc.Counter(tc.load_ranks()).encoding.encode_ordinary
    for r in queries.op7_token_counts(spark, data).collect():
        text = texts[r.doc_id]
        after = text
        for a, b, new in sorted(tc.redactions(text), reverse=True):
            after = after[:a] + new + after[b:]
        assert (r.n_tokens, r.n_tokens_after) == (len(encode(text)), len(encode(after)))


def test_url_verdicts(spark, data, con):
    def judge(url):
        head, sep, rest = (url or "").partition("://")
        if not sep:
            return "", "", None
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=lambda r: len(r.name)) if fits else None

    verdict = {r.name: r.verdict for r in queries.URL_RULES}
    pages = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    found = queries.op9_url_filter(spark, data).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path, rule = judge(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict == (verdict[rule.name] if rule else "block" if r.distrust > r.trust else "allow")


def test_pipeline(spark, data, texts, con):
    import corpus_pipeline as p
    from mirrorlake.llm import decontam

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, set(texts)
    windows = set()
    for (t,) in con.execute("SELECT text FROM benchmark").fetchall():
        w = decontam.words_of(t.encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, data)
        kept = docs.collect()
        ids = [r.doc_id for r in kept]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        assert docs.columns[: len(columns)] == columns and all(r.text == texts[r.doc_id] for r in kept)
        if name == "near_duplicates":
            sets = {i: {tuple(w[j : j + 5]) for w in [(texts[i] or "").lower().split()] for j in range(max(len(w) - 5, 0) + 1)} for i in before}
            alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert not [(i, j) for i in ids for j in ids if i < j and alike(i, j) >= 0.8]
            assert not [i for i in before - set(ids) if max(alike(i, j) for j in before - {i}) < 0.7]
        if name == "decontamination":
            hit = lambda t: any(tuple(w[i : i + k]) in windows for w in [decontam.words_of(t.encode())] for k in {len(x) for x in windows} for i in range(len(w) - k + 1))
            assert {i for i in before if not hit(texts[i])} == set(ids)
        if name == "mix":
            assert set(ids) == before and len({(r.slot, r.in_block) for r in kept}) == len(kept)
        before = set(ids)
        docs = spark.createDataFrame(kept, docs.schema)
