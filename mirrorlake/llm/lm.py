"""Language-model scoring by a weighted backoff automaton.

A state is a history of up to ``order - 1`` tokens that occurs in the training texts; the root is the empty
history. For every n-gram ``h w`` of the training texts, state ``h`` has an arc ``w`` to the longest suffix of
``h w`` that is a state; its weight is the logarithm of the smoothed probability

    p(w | h) = (c(h w) + MU p(w | h')) / (c(h) + MU)       h': h without its first token
    p(w)     = (c(w) + 1) / (N + V + 1)

and its failure arc goes to ``h'`` with weight MU / (c(h) + MU), so that an unseen ``h w`` costs the failure
weight times p(w | h'). At the root an unknown token costs 1 / (N + V + 1) and leads to the root. The
probabilities of all tokens after a history, and one unknown token, add up to 1.

A text is traversed from left to right: the state is carried, failure arcs are followed until the token has an
arc, weights are added up. Texts are traversed abreast, a token each at a time. Long texts are cut into
stretches; a stretch reads the ``order - 1`` tokens before it from the root without counting them, which leads
to the state that the whole text before it leads to, since no state remembers more.

The model is never gathered anywhere. Each task encodes its documents into chunks of a few MB of text, which
are written to the shared folder. First a chunk hands in the training counts of its distinct words, dealt by range of
their hash; it gets the words' counts in all chunks and, for words that another chunk holds too, their numbers. An n-gram
of such words alone may occur elsewhere: the chunk asks for its training count and hands in its own (summed before
the shuffle). Other n-grams are the chunk's own. Requests are dealt by a hash of the n-gram into buckets of bounded
size, as byte planes of sorted differences of the n-gram's word numbers, written as one number (or a few, where
that would pass 64 bits); with the bucket these give the n-gram back, so no two are ever taken for one. A bucket adds the
counts up and answers each chunk, which then builds the part of the automaton that its texts can traverse. A chunk makes
a request for each bucket in which it has n-grams, so work follows the number of n-grams.

Defined results: null text is empty (the end token alone); rows where ``train`` is null are not learnt from;
an empty training set gives N = V = 0 and score 0. Words of different chunks are known by 96-bit hashes (2^28 words
hold two alike with a chance of 2^-41), longer n-grams exactly. A text and its chunk must fit in a task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mirrorlake.deploy import ship
from mirrorlake.llm.common import binary_values, release, saved, scratch

#: Chosen by the likelihood of held-out documents of scale 0.1 among orders 2 to 4 and weights 1 to 16.
MU = 16.0
ORDER = 3
#: Text bytes of a chunk, n-grams of a bucket: what a task holds at once. Tokens of a stretch.
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 2 << 20
STRETCH = 256
#: Least number of buckets, for even loads on small inputs.
LEAST = 32
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Runs free of blank and \\t..\\r, A-Z lower-cased."""
    return (text or b"").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


# ---- codecs of the shuffle -----------------------------------------------------------


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys: the first one, then differences as byte planes; only the two highest planes can be compressed."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    low = max(0, width - 2)
    return b"".join((int(keys[0]).to_bytes(8, "little"), bytes([width]), planes[:low].tobytes(), pa.compress(planes[low:].tobytes(), "zstd", asbytes=True)))


def _unsqueeze(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    width, low = blob[8], max(0, blob[8] - 2)
    cut = 9 + low * (n - 1)
    raw = blob[9:cut] + pa.decompress(blob[cut:], (width - low) * (n - 1), "zstd", asbytes=True)
    wide = np.zeros((n, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8)
    wide[1:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n - 1).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _pack(x: np.ndarray) -> bytes:
    """Counts, as narrow as the largest allows, byte planes together; the first byte is the width."""
    width = 1 if not len(x) or x.max() < 256 else 2 if x.max() < 65536 else 4 if x.max() < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    width = b[0]
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


# ---- the n-grams of a chunk ------------------------------------------------------------


def encode(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token stream of some texts (for each a start mark, the words and the end token), its length for each text, and the hash of each token number (64 bits and 32)."""
    ids: dict[bytes, int] = {}
    lengths, parts = [], []
    for text in texts:
        words = tokens_of(text)
        row = np.empty(len(words) + 2, np.int32)
        row[0], row[-1] = 0, 1
        if words:
            row[1:-1] = [ids.setdefault(w, len(ids) + 2) for w in words]
        parts.append(row)
        lengths.append(len(row))
    hashes = np.empty((len(ids) + 2, 2), np.uint64)
    hashes[:2] = [[_START], [_END]]
    hashes[2:] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in ids), np.uint64).reshape(-1, 2)
    hashes[:, 1] >>= np.uint64(32)
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(lengths, np.int64), hashes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the index among them of each key, and a place of each."""
    by = np.argsort(keys)
    found = keys[by]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    back = np.empty(len(found), np.int64)
    back[by] = np.cumsum(new) - 1
    return found[new], back, by[new]


class Grams:
    """``keys[k]``: the distinct (k+1)-grams of a chunk, as sorted pairs of the k-gram before and a token, in one number. ``at[k]``
    has for each place of the stream the index of the (k+1)-gram that ends there, -1 where it would reach over the start;
    ``where[k]`` a place of each. ``numbers`` are those of the tokens in the corpus, below 0 for a token of this chunk alone."""

    def __init__(self, stream: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, order: int, buckets: int):
        self.stream, self.lengths, self.numbers, self.order, self.buckets = stream, lengths, numbers, order, buckets
        self.starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(stream)) - np.repeat(self.starts, lengths)
        self.keys, self.at, self.where = [], [], []
        for k in range(order):
            used = np.flatnonzero(self.place >= k)
            key = stream[used].astype(np.int64)
            if k:
                key += self.at[-1][used - 1] * len(numbers)
            found, back, where = _distinct(key)
            at = np.full(len(stream), -1, np.int64)
            at[used] = back
            self.keys.append(found)
            self.at.append(at)
            self.where.append(used[where])

    def shared(self, k: int, space: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The (k+1)-grams, k > 0, that other chunks may hold too, by bucket and name: index, where each bucket begins, and names (``name_of``)."""
        index = np.arange(len(self.keys[k]))
        for j in range(k + 1):
            index = index[self.numbers[self.stream[self.where[k][index] - j]] >= 0]
        bucket, names = name_of([self.numbers[self.stream[self.where[k][index] - j]] for j in range(k, -1, -1)], space, self.buckets)
        by = np.lexsort((*names[::-1], bucket))
        return index[by], np.searchsorted(bucket[by], np.arange(self.buckets + 1)), [n[by] for n in names]

    def counts(self, training: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram is in the training texts of the chunk."""
        weight = np.repeat(training, self.lengths).astype(np.float64)
        return [np.bincount(at[k:][at[k:] >= 0], weights=weight[k:][at[k:] >= 0], minlength=len(keys)).astype(np.int64) for k, (at, keys) in enumerate(zip(self.at, self.keys, strict=True))]


def name_of(words: list[np.ndarray], space: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bucket of each n-gram of word numbers below ``space``, and the numbers that tell it from all others of its bucket: one, or more if one would pass 64 bits."""
    *before, last = [w.astype(np.uint64) for w in words]
    mixed = np.zeros(len(last), np.uint64)
    for w in before:
        mixed = _mix(mixed + w + np.uint64(1))
    n = np.uint64(buckets)
    bucket = (mixed % n + last % n) % n  # with the words before, this gives the remainder of the last
    names, room = [], 1 << 64
    for w, radix in [*((w, space) for w in before), (last // n, -(-space // buckets))]:
        if names and room * radix <= 1 << 64:
            names[-1], room = names[-1] * np.uint64(radix) + w, room * radix
        else:
            names.append(w)
            room = radix
    return bucket.astype(np.int64), names


def _names_blob(names: list[np.ndarray]) -> bytes:
    return b"".join([*[x.tobytes() for x in names[1:]], _squeeze(names[0])])


def _names_from(blob: bytes, n: int, parts: int) -> list[np.ndarray]:
    cut = 8 * n * (parts - 1)
    return [_unsqueeze(blob[cut:], n), *np.frombuffer(blob[:cut], np.uint64).reshape(parts - 1, n)]


def _alike(names: list[np.ndarray]) -> np.ndarray:
    """Names in several columns: a number for each row, the same for equal ones."""
    by = np.lexsort(names[::-1])
    new = np.zeros(len(by), bool)
    for x in names:
        new[1:] |= x[by][1:] != x[by][:-1]
    back = np.empty(len(by), np.int64)
    back[by] = np.cumsum(new)
    return back


def _cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys of ``bits`` bits; buckets are ranges of equal width."""
    edge = [((b << bits) + buckets - 1) // buckets for b in range(buckets)]
    return np.concatenate([np.searchsorted(keys, np.array(edge, np.uint64)), [len(keys)]])


# ---- the automaton ------------------------------------------------------------------------


class _Table:
    """Open-addressed hash table from non-negative longs to their positions in the array given."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several, the last stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = left[placed]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return found


class Automaton:
    """States, arcs and failure arcs of the n-grams of a chunk that are in the training texts. State 0 is the root."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, mu: float):
        order, self.tokens = grams.order, int(grams.stream.max()) + 1 if len(grams.stream) else 1
        self.unknown = -np.log10(total + distinct + 1.0)
        fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        source, token, weight, target = [], [], [], []
        state_of, n = [], 1
        p = None
        for k in range(order):
            seen, last = counts[k] > 0, grams.stream[grams.where[k]]
            if k:
                suffix, history = grams.at[k - 1][grams.where[k]], grams.at[k - 1][grams.where[k] - 1]
                p = (counts[k] + mu * p[suffix]) / (counts[k - 1][history] + mu)
                from_ = state_of[-1][history]
                shorter = state_of[-1][suffix]
            else:
                p = (counts[0] + 1.0) / (total + distinct + 1.0)
                from_ = shorter = np.zeros(len(seen), np.int64)
            if k < order - 1:  # a history, unless it is the end
                states = np.flatnonzero(seen & (last != 1))
                own = np.zeros(len(seen), np.int64)
                own[states] = n + np.arange(len(states))
                n += len(states)
                state_of.append(own)
                fail.append(shorter[states])
                fail_weight.append(np.log10(mu / (counts[k][states] + mu)))
                leads = np.where(own > 0, own, shorter)
            else:
                leads = shorter
            arcs = np.flatnonzero(seen)
            for out, x in ((source, from_), (token, last), (weight, np.log10(p)), (target, leads)):
                out.append(x[arcs])
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        self.weight, self.target = np.concatenate(weight), np.concatenate(target)
        self.arcs = _Table(np.concatenate(source) * self.tokens + np.concatenate(token))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state with its token: log10 probability and next state."""
        state, score = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            arc = self.arcs.find(state[left] * self.tokens + token[left])
            hit = arc >= 0
            done, arc = left[hit], arc[hit]
            score[done] += self.weight[arc]
            state[done] = self.target[arc]
            left = left[~hit]
            root = state[left] == 0
            score[left[root]] += self.unknown
            left = left[~root]
            score[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return score, state

    def traverse(self, grams: Grams, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each text."""
        texts = np.repeat(np.arange(len(grams.lengths)), -(-(grams.lengths - 1) // stretch))
        first = np.arange(len(texts)) - np.searchsorted(texts, texts)
        begin = 1 + first * stretch
        warm = np.maximum(0, begin - (grams.order - 1))
        length = np.minimum(begin + stretch, grams.lengths[texts]) - warm
        by = np.argsort(-length, kind="stable")
        texts, at, ahead, length = texts[by], (grams.starts[texts] + warm)[by], (begin - warm)[by], length[by]
        state, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))  # stretches longer than t
            found, state[:n] = self.step(state[:n], grams.stream[at[:n] + t])
            score[:n] += np.where(t >= ahead[:n], found, 0.0)
        return np.bincount(texts, weights=score, minlength=len(grams.lengths))


# ---- the operator ----------------------------------------------------------------------------

_BODY = T.StructType([T.StructField(n, T.LongType()) for n in ("chunk", "tokens")] + [T.StructField(n, T.BinaryType()) for n in ("stream", "lengths", "training", "kept", "hashes", "own")])
_NUMBERED = T.StructType([T.StructField("chunk", T.LongType())] + [T.StructField(n, T.BinaryType()) for n in ("stream", "lengths", "training", "kept", "words", "numbers")])


def _chunks(rows: DataFrame, kept: list[str], chunk_bytes: int) -> DataFrame:
    """A row for each chunk: some rows of a task, encoded."""

    def body(no: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        stream, lengths, hashes = encode(t for c in table.column("_text").chunks for t in binary_values(c))
        sink = pa.BufferOutputStream()
        carried = table.select(kept)
        with pa.ipc.new_stream(sink, carried.schema) as writer:
            writer.write_table(carried)
        training = np.array(table.column("_train").to_pylist(), np.uint8)
        own = np.bincount(stream, weights=np.repeat(training, lengths), minlength=len(hashes)).astype(np.int64)
        blobs = [pa.compress(stream.tobytes(), "zstd", asbytes=True), lengths.tobytes(), training.tobytes(), sink.getvalue().to_pybytes()]
        blobs += [hashes[:, 0].tobytes() + hashes[:, 1].astype("<u4").tobytes(), _pack(own)]
        chunk = (TaskContext.get().partitionId() << 32) + no
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(stream)]), *[pa.array([b], pa.binary()) for b in blobs]], _BODY.names)

    def run(batches):
        parts, held, no = [], 0, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            done = 0
            while done < batch.num_rows:
                taken = int(ends[done - 1]) if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, taken + chunk_bytes - held, side="right")))
                stop = min(stop, batch.num_rows)
                parts.append(batch.slice(done, stop - done))
                held += int(ends[stop - 1]) - taken
                done = stop
                if held >= chunk_bytes or (done < batch.num_rows and held + int(ends[done] - ends[done - 1]) > chunk_bytes):
                    yield body(no, parts)
                    parts, held, no = [], 0, no + 1
        if parts:
            yield body(no, parts)

    return rows.mapInArrow(run, _BODY)


def _sorted_words(hashes: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From a chunk's ``hashes``: the order of its tokens by hash, both parts of the hashes in that order, and where each bucket begins."""
    n = len(hashes) // 12
    high, low = np.frombuffer(hashes, np.uint64, n), np.frombuffer(hashes, "<u4", n, 8 * n)
    high = _mix(high)
    by = np.lexsort((low, high))
    return by, high[by], low[by], _cuts(high[by], 64, buckets)


def _word_answers(bodies: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket: training counts of its words in all chunks, and 1 + their rank among the bucket's words that several chunks hold (else 0).

    One row of each bucket has its tokens and words in training texts; ``space`` is above all numbers of its words.
    """

    def request(batches):
        for batch in batches:
            for row in batch.to_pylist():
                by, high, low, cuts = _sorted_words(row["hashes"], buckets)
                own, out = _unpack(row["own"])[by], []
                for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    s = slice(cuts[b], cuts[b + 1])
                    out.append((int(b), row["chunk"], int(s.stop - s.start), _squeeze(high[s]), low[s].tobytes(), _pack(own[s])))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["bucket", "chunk", "n", "high", "low", "own"])

    def answer(table):
        n, bucket = table.column("n").to_pylist(), table.column("bucket")[0].as_py()
        high = np.concatenate([_unsqueeze(h, k) for h, k in zip(table.column("high").to_pylist(), n, strict=True)])
        low = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()])
        back = _alike([high, low])
        own = np.concatenate([_unpack(c) for c in table.column("own").to_pylist()])
        sums = np.bincount(back, weights=own).astype(np.int64)
        several = np.bincount(back) > 1
        rank = np.where(several, np.cumsum(several), 0)
        start = np.zeros(len(sums), bool)
        start[back[(high == _mix(np.array([_START]))[0]) & (low == np.uint32(_START >> np.uint64(32)))]] = True
        cuts = np.cumsum(n)[:-1]
        first = [True] + [False] * (len(n) - 1)
        totals = [int(sums[~start].sum()), int((sums[~start] > 0).sum()), int(several.sum()) * buckets + bucket + 1]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                **{c: pa.array([_pack(x) for x in np.split(values[back], cuts)], pa.binary()) for c, values in (("counts", sums), ("ranks", rank))},
                **{c: pa.array([x if f else 0 for f in first], pa.int64()) for c, x in zip(("total", "distinct", "space"), totals, strict=True)},
            }
        )

    requests = bodies.select("chunk", "hashes", "own").mapInArrow(request, "bucket int, chunk long, n long, high binary, low binary, own binary")
    return requests.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, counts binary, ranks binary, total long, distinct long, space long")


def _numbered(bodies: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Chunks with their words' counts, and 1 + their numbers (0 where no other chunk holds the word)."""
    empty = to_arrow_schema(_NUMBERED).empty_table()

    def number(left, right):
        if not left.num_rows:
            return empty
        row = left.to_pylist()[0]
        by, _, _, cuts = _sorted_words(row["hashes"], buckets)
        counts, numbers = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        for b, c, r in zip(*(right.column(x).to_pylist() for x in ("bucket", "counts", "ranks")), strict=True):
            here, rank = by[cuts[b] : cuts[b + 1]], _unpack(r)
            counts[here] = _unpack(c)
            numbers[here] = np.where(rank > 0, (rank - 1) * buckets + b + 1, 0)
        blobs = [row[c] for c in ("stream", "lengths", "training", "kept")] + [_pack(counts), _pack(numbers)]
        return pa.table([pa.array([row["chunk"]]), *[pa.array([x], pa.binary()) for x in blobs]], names=_NUMBERED.names)

    return bodies.drop("tokens", "own").groupBy("chunk").cogroup(words.select("chunk", "bucket", "counts", "ranks").groupBy("chunk")).applyInArrow(number, _NUMBERED)


def score(
    docs: DataFrame,
    *,
    train: Column,
    keep: list[str] | None = None,
    text_col: str = "text",
    order: int = ORDER,
    mu: float = MU,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """``keep`` columns plus n_tokens, n_known, train_tokens, base_score and score (log10).

    ``train`` marks the texts to learn from; all texts are scored.
    """
    spark = ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(F.coalesce(train, F.lit(False)).alias("_train"), F.col(text_col).alias("_text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    with scratch(spark) as stays:
        bodies = saved(_chunks(rows, kept, chunk_bytes), "lm-chunks")
        tokens = bodies.agg(F.sum("tokens")).first()[0] or 0
        buckets = max(LEAST, -(-2 * tokens // bucket_keys))
        words = saved(_word_answers(bodies, max(LEAST, -(-tokens // bucket_keys))), "lm-words")
        total, distinct, space = words.agg(F.sum("total"), F.sum("distinct"), F.max("space")).first()
        total, distinct, space = total or 0, distinct or 0, space or 1
        bodies = stays(saved(_numbered(bodies, words, max(LEAST, -(-tokens // bucket_keys))), "lm-numbered"))

    def grams_of(row: dict) -> Grams:
        lengths, numbers = np.frombuffer(row["lengths"], np.int64), _unpack(row["numbers"]) - 1
        stream = np.frombuffer(pa.decompress(row["stream"], 4 * int(lengths.sum()), "zstd", asbytes=True), np.int32)
        return Grams(stream, lengths, numbers, order, buckets)

    def request(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = grams_of(row)
                counts = grams.counts(np.frombuffer(row["training"], np.uint8))
                found = [grams.shared(k, space) for k in range(1, order)]
                out = []
                for b in np.flatnonzero(np.any([cuts[1:] > cuts[:-1] for _, cuts, _ in found], axis=0)) if found else ():
                    parts = [slice(cuts[b], cuts[b + 1]) for _, cuts, _ in found]
                    blobs = [_names_blob([x[s] for x in names]) for s, (_, _, names) in zip(parts, found, strict=True)]
                    own = np.concatenate([c[index[s]] for c, s, (index, _, _) in zip(counts[1:], parts, found, strict=True)])
                    out.append((int(b), row["chunk"], [int(s.stop - s.start) for s in parts], [len(names) for _, _, names in found], blobs, _pack(own)))
                del grams, counts, found
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["bucket", "chunk", "sizes", "parts", "names", "counts"])

    def answer(table):
        n = table.num_rows
        sizes = np.array(table.column("sizes").to_pylist()).reshape(n, order - 1)
        parts = table.column("parts")[0].as_py()
        counts = [_unpack(c) for c in table.column("counts").to_pylist()]
        blobs = table.column("names").to_pylist()
        replies = [[None] * (order - 1) for _ in range(n)]
        for k in range(order - 1):
            before = sizes[:, :k].sum(1)
            names = [_names_from(b[k], s, parts[k]) for b, s in zip(blobs, sizes[:, k].tolist(), strict=True)]
            names = [np.concatenate(x) for x in zip(*names, strict=True)]
            back = _distinct(names[0])[1] if len(names) == 1 else _alike(names)
            mine = np.concatenate([c[f : f + s] for c, f, s in zip(counts, before, sizes[:, k], strict=True)])
            sums = np.bincount(back, weights=mine).astype(np.int64)
            for i, part in enumerate(np.split(sums[back], np.cumsum(sizes[:, k])[:-1])):
                replies[i][k] = part
        blobs = [_pack(np.concatenate(r)) for r in replies]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array(blobs, pa.binary())})

    requests = bodies.select("chunk", "stream", "lengths", "training", "numbers").mapInArrow(request, "bucket int, chunk long, sizes array<long>, parts array<long>, names array<binary>, counts binary")
    answers = saved(requests.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, counts binary"), "lm-counts")
    release(spark)  # the requests' shuffle files

    def finish(left, right):
        if not left.num_rows:
            return empty
        row = left.to_pylist()[0]
        grams = grams_of(row)
        counts = grams.counts(np.frombuffer(row["training"], np.uint8))
        counts[0] = _unpack(row["words"])
        replies = {b: _unpack(c) for b, c in zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True)}
        read = dict.fromkeys(replies, 0)
        for k in range(1, order):
            index, cuts, _ = grams.shared(k, space)
            for b, found in replies.items():
                here = index[cuts[b] : cuts[b + 1]]
                counts[k][here] = found[read[b] : read[b] + len(here)]
                read[b] += len(here)
        c = counts[0][grams.at[0]]
        scored = grams.place > 0
        add = lambda x: np.add.reduceat(x, grams.starts)
        known = add(scored & (c > 0)).astype(np.int64)
        base = add(np.where(scored, np.log10((c + 1.0) / (total + distinct + 1.0)), 0.0))
        logp = Automaton(grams, counts, total, distinct, mu).traverse(grams)
        carried = pa.ipc.open_stream(row["kept"]).read_all() if kept else None
        columns = [carried.column(k) for k in kept]
        return pa.table([*columns, pa.array(grams.lengths - 1), pa.array(known), pa.array(np.full(len(base), total)), pa.array(base), pa.array(logp)], names)

    names = [*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    new_fields = [T.StructField(n, T.LongType()) for n in names[-5:-2]] + [T.StructField(n, T.DoubleType()) for n in names[-2:]]
    schema = T.StructType([rows.schema[c] for c in kept] + new_fields)
    empty = to_arrow_schema(schema).empty_table()
    out = bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
    ours = set(names[-5:])
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True) if c not in ours], *names[-5:])
