"""The backoff automaton against dictionaries, its probabilities, and its traversal."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorlake.llm import lm


def plain_model(texts, order, mu):
    """log10 p(word | history) from dictionaries of counts, recursively."""
    grams = [Counter() for _ in range(order)]
    for words in texts:
        s = ["<s>", *words, "</s>"]
        for k in range(order):
            grams[k].update(tuple(s[i : i + k + 1]) for i in range(len(s) - k))
    total = sum(grams[0].values()) - grams[0][("<s>",)]
    v = len(grams[0]) - (("<s>",) in grams[0])

    def p(history, word):
        if not history:
            return (grams[0][word,] + 1) / (total + v + 1)
        h = tuple(history)
        return (grams[len(h)][(*h, word)] + mu * p(h[1:], word)) / (grams[len(h) - 1][h] + mu)

    def score(words):
        s = ["<s>", *words, "</s>"]
        return sum(math.log10(p(s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s)))

    return p, score, (total, v)


def some_texts(seed, n, longest):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    return [[rng.choice(vocab[: rng.randint(1, 30)]) for _ in range(rng.randint(0, longest))] for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_a_model_of_dictionaries(spark, order):
    texts = some_texts(order, 60, 40) + some_texts(9, 2, 1500)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, "unseen words w1 w2 only here"), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learnt = lambda i: i % 3 != 2 and i < 1000
    _, score, (total, _) = plain_model([t for i, t in enumerate(texts) if learnt(i)], order, 2.5)
    for chunk, bucket in ((8 << 20, 2 << 20), (700, 50)):  # one chunk a task, many chunks and buckets
        got = lm.score(df, train=(F.col("doc_id") % 3 != 2) & (F.col("doc_id") < 1000), order=order, mu=2.5, chunk_bytes=chunk, bucket_keys=bucket).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        for r in got:
            assert r.train_tokens == total and math.isclose(r.score, score((r.text or "").split()), rel_tol=1e-9), r.doc_id


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_after_a_history_add_up_to_one(spark, order):
    texts = some_texts(5, 20, 12)
    words = sorted({w for t in texts for w in t})
    p, _, _ = plain_model(texts, order, 4.0)
    for history in (["<s>"], ["w1"], ["w0", "w1"][-order + 1 :], ["nowhere"], ["nowhere", "w0"][-order + 1 :]):
        assert math.isclose(sum(p(history, w) for w in [*words, "</s>", "unknown"]), 1, rel_tol=1e-9)
    # the same from the automaton: the end, each word and an unknown word after the same text
    starts = [["w0", "w1"], ["w3"], ["unknown", "w0"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + 100 * i + j, " ".join([*s, *x])) for i, s in enumerate(starts) for j, x in enumerate([[], *[[w] for w in words], ["never"]])]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), train=F.col("doc_id") < 1000, order=order, mu=4.0).collect()}
    for i, s in enumerate(starts):
        h = ["<s>", *s]
        before = sum(math.log10(p(h[max(0, k - order + 1) : k], h[k])) for k in range(1, len(h)))
        after = [10 ** (got[1000 + 100 * i] - before)]
        for j, w in enumerate([*words, "never"], 1):
            end = math.log10(p([*h, w][-order + 1 :], "</s>"))
            after.append(10 ** (got[1000 + 100 * i + j] - before - end))
        assert math.isclose(sum(after), 1, rel_tol=1e-9), s


def automaton(texts, order):
    stream, lengths, hashes = lm.encode(" ".join(t).encode() for t in texts)
    grams = lm.Grams(stream, lengths, hashes, order, 64)
    counts = grams.counts(np.ones(len(texts), np.uint8))
    total, distinct = int(counts[0].sum()) - len(texts), len(grams.keys[0]) - 1
    return grams, lm.Automaton(grams, counts, total, distinct, 4.0)


def test_states_and_failure_arcs():
    grams, found = automaton([["a", "b", "a", "c"], ["b", "a"]], 3)
    # histories: <s> a b c; <s>a <s>b ab ba ac - no history ends in the end
    assert len(found.fail) == 1 + 4 + 5
    state, seen = np.zeros(1, np.int64), []
    for token in grams.stream[: grams.lengths[0]]:
        _, state = found.step(state, np.array([token]))
        seen.append(int(state[0]))
    assert len(set(seen[:-1])) == 5 and 0 not in seen[:-1]  # <s>, <s>a, ab, ba, ac: each another state
    depth = lambda s: 0 if s == 0 else 1 + depth(int(found.fail[s]))
    assert Counter(map(depth, range(len(found.fail)))) == {0: 1, 1: 4, 2: 5}
    assert (found.fail_weight[1:] < 0).all()


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_stretches_lead_to_the_same_scores(stretch):
    grams, found = automaton(some_texts(3, 20, 50), 4)
    assert np.allclose(found.traverse(grams, stretch), found.traverse(grams, 10**6), rtol=1e-12, atol=0)


def test_keys_survive_the_shuffle():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 64), (1, 64), (2, 64), (1000, 64), (5000, 41)):
        keys = np.unique(rng.integers(0, 1 << bits if bits < 64 else None, n, np.uint64) if bits < 64 else rng.integers(0, np.iinfo(np.uint64).max, n, np.uint64))
        assert (lm._unsqueeze(lm._squeeze(keys), len(keys)) == keys).all()
        cuts = lm._cuts(keys, bits, 7)
        assert cuts[0] == 0 and cuts[-1] == len(keys)
        want = defaultdict(list)
        for k in keys.tolist():
            want[k * 7 >> bits].append(k)
        assert [keys[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [want[b] for b in range(7)]


def test_ngrams_with_hashes_alike_are_counted_apart(spark):
    # of these pairs, the first 40 bits of a hash that named n-grams are alike
    one, other = ("w129", "w1978"), ("w33", "w148")
    texts = [[*one], [*one], [*other], [other[0], one[1]], [one[0], other[1]]]
    _, score, _ = plain_model(texts[:2], 3, 4.0)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    for chunk in (8 << 20, 1):
        for r in lm.score(df, train=F.col("doc_id") < 2, mu=4.0, chunk_bytes=chunk).collect():
            assert math.isclose(r.score, score(r.text.split()), rel_tol=1e-9), r.text


@pytest.mark.parametrize("space", [9, 1 << 21, 1 << 31, 1 << 40])
@pytest.mark.parametrize("order", [2, 3, 5])
def test_names_of_ngrams_tell_all_apart(space, order):
    rng = np.random.default_rng(order)
    near = rng.integers(0, 4, (3000, order)) + (rng.integers(0, 2, (3000, order)) * (space - 4))
    grams = np.unique(np.concatenate([near, rng.integers(0, space, (3000, order))]), axis=0)
    bucket, names = lm.name_of(list(grams.T), space, 7)
    assert len({*zip(bucket.tolist(), *(x.tolist() for x in names), strict=True)}) == len(grams)
    by = np.lexsort((*names[::-1], bucket))
    names = [x[by][bucket[by] == 3] for x in names]
    got = lm._names_from(lm._names_blob(names), len(names[0]), len(names))
    assert all((x == y).all() for x, y in zip(names, got, strict=True))
    back = lm._alike([np.concatenate([x, x]) for x in names])
    assert len(set(back.tolist())) == len(names[0]) and (back[: len(names[0])] == back[len(names[0]) :]).all()
