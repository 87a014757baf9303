"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Document statistics are computed once for each whole text. Standardised, they are mapped by
random cosines whose inner products approximate a Gaussian kernel. Every task adds up its
part of Z'Z and Z'y; the parts are summed in a tree and the driver solves one small ridge
system. A second, disjoint part of the labelled rows calibrates: (bin of ridge score) sums
go through pool-adjacent-violators, so the score is an estimated probability of label 1.

Nothing is sampled: all labelled rows count, and the driver receives only sums of fixed size.

Defined results: null text counts like empty text; labels are averaged for a repeated
doc_id, and a row of each document joins it; null labels and null ids teach nothing; without
labels every score is 0.5, with one class that class's share; columns named like outputs are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import ship
from mirrorlake.llm.common import binary_values, per_task_vector, saved

COMPONENTS = 200
#: Kernel width in standard deviations of the statistics.
WIDTH = 5.0
RIDGE = 1.0
BINS = 2048
THRESHOLD = 0.7

_CLASS = np.full(256, 7, np.int64)  # other
for _k, _set in enumerate((b" ", b"\t\r\x0b\x0c", b"\n", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)))):
    _CLASS[list(_set)] = _k
_SIGNS = (b"!", b"?", b".", b",", b"|#$%&*@^~=+<>{}[]\\/_", b"\"'`-:;()")
_SIGN_BYTES = [np.frombuffer(s, np.uint8) for s in _SIGNS]
STATISTICS = 26


def statistics(text: bytes | None) -> np.ndarray:
    """What is known of one text; bounded numbers, whatever its length."""
    out = np.zeros(STATISTICS, np.float64)
    data = np.frombuffer(text or b"", np.uint8)
    n = len(data)
    if not n:
        return out
    counts = np.bincount(data, minlength=256)
    share = counts / n
    out[0] = np.log1p(n)
    out[1:9] = np.bincount(_CLASS, weights=share, minlength=8)
    for k, sign in enumerate(_SIGN_BYTES):
        out[9 + k] = np.sqrt(share[sign].sum())
    words = text.split()
    if not words:
        return out
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    out[15] = lengths.mean() / 10
    out[16] = min(5.0, lengths.std() / 10)
    out[17] = np.log1p(lengths.max()) / 5
    out[18] = (lengths <= 3).mean()
    distinct = len(set(words))
    out[19] = np.log(distinct) / np.log(m) if m > 1 else 1.0
    some = share[share > 0]
    out[20] = -(some * np.log2(some)).sum() / 8
    lines = [x for x in text.split(b"\n") if x]
    out[21] = np.log1p(m / max(1, len(lines))) / 5
    out[22] = 1 - len(set(lines)) / max(1, len(lines))
    letters = out[5] + out[6] + out[7]
    out[23] = out[5] / letters if letters else 0.0
    ends = np.frombuffer(bytes(w[-1] for w in words), np.uint8)
    out[24] = (_CLASS[ends] == 7).mean()
    starts = np.frombuffer(bytes(w[0] for w in words), np.uint8)
    out[25] = (_CLASS[starts] == 4).mean()
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # of raw scores, ascending
    values: np.ndarray  # calibrated score at each edge

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.omega + self.phase
        return np.concatenate([np.sqrt(2 / COMPONENTS) * np.cos(z), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of least squares."""
    blocks: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist(), strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def document_statistics(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus ``x``, the statistics as float64 bytes."""

    def run(batches):
        for batch in batches:
            x = [statistics(t).tobytes() for t in binary_values(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(x, pa.binary())], [*keep, "x"])

    ship(docs.sparkSession)
    carried = docs.select(*dict.fromkeys([*keep, text_col]))
    return carried.mapInArrow(run, T.StructType([carried.schema[c] for c in keep] + [T.StructField("x", T.BinaryType())]))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, STATISTICS)


def train(rows: DataFrame, *, calibrate: Column, seed: int = 3) -> Model | None:
    """Fit on rows of (x, y); those that ``calibrate`` marks only calibrate. None without labels."""
    ship(rows.sparkSession)
    rows = rows.select("x", F.col("y").cast("double").alias("y"), F.coalesce(calibrate, F.lit(False)).alias("c"))

    def moments(total, batch):
        x = _rows(batch.column(0))
        total[0] += len(x)
        total[1 : 1 + STATISTICS] += x.sum(0)
        total[1 + STATISTICS :] += (x * x).sum(0)

    got = per_task_vector(rows, 1 + 2 * STATISTICS, moments)
    if got is None or not got[0]:
        return None
    mean = got[1 : 1 + STATISTICS] / got[0]
    scale = np.sqrt(np.maximum(got[1 + STATISTICS :] / got[0] - mean * mean, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (STATISTICS, COMPONENTS)), rng.uniform(0, 2 * np.pi, COMPONENTS), np.zeros(COMPONENTS + 1), np.zeros(1), np.zeros(1))
    d = COMPONENTS + 1

    def normal(total, batch):
        fit = ~batch.column(2).to_numpy(zero_copy_only=False)
        x, y = _rows(batch.column(0))[fit], batch.column(1).to_numpy(zero_copy_only=False)[fit]
        for i in range(0, len(x), 4096):
            z = model.features(x[i : i + 4096])
            total[: d * d] += (z.T @ z).ravel()
            total[d * d :] += z.T @ y[i : i + 4096]

    got = per_task_vector(rows, d * d + d, normal)
    ridge = RIDGE * np.eye(d)
    ridge[-1, -1] = 1e-6
    model.weights = np.linalg.solve(got[: d * d].reshape(d, d) + ridge, got[d * d :])

    def histogram(which):
        def add(total, batch):
            c = batch.column(2).to_numpy(zero_copy_only=False)
            use = c if which else np.ones(len(c), bool)
            x, y = _rows(batch.column(0))[use], batch.column(1).to_numpy(zero_copy_only=False)[use]
            at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            total[:BINS] += np.bincount(at, minlength=BINS)
            total[BINS:] += np.bincount(at, weights=y, minlength=BINS)

        return per_task_vector(rows, 2 * BINS, add)

    got = histogram(True)
    if got is None or not got[:BINS].sum():
        got = histogram(False)
    n, y = got[:BINS], got[BINS:]
    some = np.flatnonzero(n)
    model.edges = (some + 0.5) / BINS * 2 - 0.5
    model.values = isotonic(n[some], y[some] / n[some])
    return model


def fit(stats: DataFrame, labels: DataFrame, *, train_rows: Column, calibrate: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Join statistics (id, x) with labels and train. The conditions are on the id."""
    wanted = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train_rows)
        .groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    )
    return train(saved(stats.join(wanted, id_col).select(id_col, "x", "y"), "labelled"), calibrate=calibrate)


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``stats`` but x, plus score and predicted."""
    keep = [c for c in stats.columns if c not in ("x", "score", "predicted")]
    use = ship(stats.sparkSession).sparkContext.broadcast(model)  # some thousand numbers

    def run(batches):
        for batch in batches:
            x = _rows(batch.column("x"))
            s = use.value.score(x) if use.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"]
            )

    schema = T.StructType([stats.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return stats.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, train_rows: Column, calibrate: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input columns of the documents with predicted label 1, judged on the text alone. Without any label there is nothing to judge by, and all documents stay."""
    stats = saved(document_statistics(docs, keep=[id_col], text_col=text_col), "statistics")
    model = fit(stats, labels, train_rows=train_rows, calibrate=calibrate, id_col=id_col)
    use = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in binary_values(batch.column(text_col))]).reshape(-1, STATISTICS)
            if use.value is None:
                yield batch
            else:
                yield batch.filter(pa.array(use.value.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
