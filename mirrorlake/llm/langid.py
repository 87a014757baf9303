"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window, each filter
keeps its maximum over the window (max pooling), and a softmax layer gives the
languages. Training is plain numpy (Adam) on the driver over a bounded sample of
labelled windows. A text is cut into windows of ``WINDOW`` bytes that overlap by
the widest filter less one, so every byte run of every whole text is seen; the
windows' log-probabilities are averaged by the bytes they hold.

Prediction evaluates the same convolution through tables: byte embedding and
filter are both linear, so a filter of width 2 is a table over byte pairs, and
one of width 3 or 4 the sum of two such tables.

Defined results: null text or text without any letter is ``und`` with score 0;
so is everything where no labelled row exists. Rows with null language, null or
empty text teach nothing. Input columns named like outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import ship
from mirrorlake.llm.common import binary_values, without

WIDTHS = (2, 3, 4)
WINDOW = 256
STEP = WINDOW - max(WIDTHS) + 1
FILTERS = 12
EMBED = 8
#: Labelled rows (windows of whole texts) a language that training takes, about; languages that it learns, the most frequent ones.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 2400, 200
EPOCHS = 6
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_SLAB = 192


def _padded(text: bytes) -> bytes:
    """The text and at least 3 blanks, up to a whole number of steps."""
    n = -(-(len(text) + max(WIDTHS) - 1) // STEP) * STEP
    return text.ljust(n, b" ")


class ByteConvNet:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["D"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages)))
        self.p["c"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over windows ``x`` (n, WINDOW)."""
        n, emb, pooled, where = len(x), self.p["E"][x], [], []
        for w in WIDTHS:
            z = sum(emb[:, j : STEP + j] @ self.p[f"W{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w))
            at = z.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
        a = np.concatenate(pooled, 1)
        r = np.maximum(a, 0)
        z = r @ self.p["D"] + self.p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"D": r.T @ q, "c": q.sum(0), "E": np.zeros_like(self.p["E"])}
        da = (q @ self.p["D"].T) * (a > 0)
        for k, w in enumerate(WIDTHS):
            d = da[:, k * FILTERS : (k + 1) * FILTERS]
            seen = x[np.arange(n)[:, None, None], where[k][:, :, None] + np.arange(w)]  # n, filter, w
            patch = self.p["E"][seen].reshape(n, FILTERS, w * EMBED)
            g[f"W{w}"] = np.einsum("nf,nfk->kf", d, patch)
            g[f"b{w}"] = d.sum(0)
            np.add.at(g["E"], seen, (d[:, :, None] * self.p[f"W{w}"].T).reshape(n, FILTERS, w, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004) -> None:
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = epochs * -(-len(x) // batch)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                pick = order[i : i + batch]
                lr = rate * (1 - 0.9 * t / steps)
                for k, g in self.step(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a byte pair at offset 0, and one at offset 2, adds to every filter."""
        one = {(w, j): self.p["E"] @ self.p[f"W{w}"][j * EMBED : (j + 1) * EMBED] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        none = np.zeros((256, FILTERS), np.float32)
        first = np.concatenate([pair(one[w, 0], one[w, 1]) + self.p[f"b{w}"] for w in WIDTHS], 1)
        later = np.concatenate([pair(one[3, 2], none), pair(one[4, 2], one[4, 3])], 1)
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(later, np.float32)


class Predictor:
    """Batched prediction; built once a task."""

    def __init__(self, net: ByteConvNet):
        self.net, (self.first, self.later) = net, net.tables()
        blanks = 0x2020
        self.blank = self.first[blanks].copy()
        self.blank[FILTERS:] += self.later[blanks]

    def log_probs(self, data: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """Of each window: ``data`` is a whole number of steps and 3 bytes more. After the windows ``last``, which end in 3 blanks, come blanks, whatever ``data`` has there."""
        pairs = data[:-1].astype(np.int32) * 256 + data[1:]
        n = (len(data) - max(WIDTHS) + 1) // STEP
        pooled = np.empty((n, self.first.shape[1]), np.float32)
        for i in range(0, n, _SLAB):
            k = min(_SLAB, n - i)
            a, b = i * STEP, (i + k) * STEP
            z = self.first.take(pairs[a:b], axis=0)
            z[:, FILTERS:] += self.later.take(pairs[a + 2 : b + 2], axis=0)
            z = z.reshape(k, STEP, -1)
            if last is not None:
                z[last[(last >= i) & (last < i + k)] - i, STEP - max(WIDTHS) + 1 :] = self.blank
            z.max(axis=1, out=pooled[i : i + k])
        z = np.maximum(pooled, 0) @ self.net.p["D"] + self.net.p["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        has = [bool(t) and bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
        parts = [_padded(t) for t, h in zip(texts, has, strict=True) if h]
        if not parts:
            return [(UNDETERMINED, 0.0)] * len(texts)
        counts = np.array([len(p) // STEP for p in parts])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        logp = self.log_probs(np.frombuffer(b"".join([*parts, b"   "]), np.uint8), starts + counts - 1).astype(np.float64)
        sizes = [len(t) for t, h in zip(texts, has, strict=True) if h]
        weight = np.full(len(logp), float(STEP))
        weight[starts + counts - 1] = [max(1, s - (c - 1) * STEP) for s, c in zip(sizes, counts, strict=True)]
        mean = np.add.reduceat(logp * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        found = iter(zip(p.argmax(1).tolist(), p.max(1).tolist(), strict=True))
        out = []
        for h in has:
            k, score = next(found) if h else (-1, 0.0)
            out.append((self.net.languages[k], min(1.0, score)) if h else (UNDETERMINED, 0.0))
        return out


def train(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    where: Column | None = None,
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> ByteConvNet | None:
    """Fit on about ``per_language`` windows of each language, chosen by hash among all windows of the labelled texts; None without any."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    rows = rows if where is None else rows.where(where)
    count = F.sum(F.ceil((F.octet_length(text_col) + max(WIDTHS) - 1) / STEP))  # windows
    most = rows.groupBy(F.col(lang_col).alias("lang")).agg(count.alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    have = {r.lang: min(1.0, per_language / r.n) for r in most.collect()}
    if not have:
        return None
    languages = sorted(have)

    def windows(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2)), strict=True):
                padded = _padded(text) + b"   "
                chance = np.random.default_rng(xxhash.xxh64_intdigest(f"{key} langid")).random((len(padded) - 3) // STEP)
                for i in np.flatnonzero(chance < have[lang]).tolist():
                    out.append((key, i, lang, padded[i * STEP : i * STEP + WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["key", "i", "lang", "window"],
            )

    picked = (
        rows.where(F.col(lang_col).isin(languages))
        .select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(windows, "key long, i long, lang string, window binary")
    )
    seen = sorted({(r.key, r.i, r.lang, bytes(r.window)) for r in picked.toLocalIterator()})
    if not seen:
        return None
    net = ByteConvNet(languages)
    net.fit(np.frombuffer(b"".join(s[3] for s in seen), np.uint8).reshape(len(seen), WINDOW), np.array([languages.index(s[2]) for s in seen]))
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (all by default) plus lang_pred and score."""
    docs = without(docs, "lang_pred", "score")
    keep = docs.columns if keep is None else keep
    model = ship(docs.sparkSession).sparkContext.broadcast(net)  # a few thousand weights

    def run(batches):
        use = Predictor(model.value) if model.value else None
        for batch in batches:
            found: list[tuple[str, float]] = []
            texts: list[bytes | None] = []
            held = 0
            for text in binary_values(batch.column(text_col)):
                texts.append(text)
                held += len(text or b"")
                if held > 4 << 20:
                    found += use.predict(texts) if use else [(UNDETERMINED, 0.0)] * len(texts)
                    texts, held = [], 0
            found += use.predict(texts) if use else [(UNDETERMINED, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    carried = docs.select(*dict.fromkeys([*keep, text_col]))
    schema = T.StructType(
        [carried.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return carried.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, net: ByteConvNet | None, *, languages: list[str] | None = None, min_score: float = 0.5) -> DataFrame:
    """Input columns of the documents whose language is determined, wanted and scored ``min_score`` or more."""
    names = docs.columns
    found = predict(docs, net).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(languages))
    return found.select(*[c for c in names if c in found.columns])
