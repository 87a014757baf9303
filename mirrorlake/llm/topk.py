"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are quantised to integers and grouped by length: a range partitioning on the
norm, longest first, then buckets of ``BUCKET`` vectors in norm order. For a query q
with a proven lower bound theta on its k-th best score, a bucket whose longest vector
has norm l can only matter if the local cosine threshold t = theta / (|q| l) is at most 1.
Where t is low the bucket is pruned by length (the prefix of norms >= theta / |q|); where
it is high it is pruned by coordinates: with q' = q/|q| and p' = p/|p|, cos(p, q) >= t
bounds every p'_f to an interval around q'_f, so the vectors outside the intervals of the
query's largest coordinates are left out. What remains is verified by integer products,
and theta rises as results are found.

Queries are read in blocks of bounded size, each one broadcast; the first bound of a block
comes from a fixed number of the longest vectors. A task returns at most k rows a query.

Defined results: null vectors and those with a null or non-finite component take no part;
a shorter vector counts as padded with zeros; rows that share the query's id are not its
candidates; repeated query rows give a result each; ties go to the smaller id, then repeat.
Scores beyond the range of a long are clamped to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorlake.deploy import ship
from mirrorlake.llm.common import new_dir, saved

BUCKET = 2048
#: Cosine threshold from which a bucket is pruned by coordinates.
COORDINATES_FROM = 0.75
FOCUS = 6
#: Queries of one broadcast block, and longest vectors that give the first bounds.
QUERY_BLOCK = 8192
SEED_VECTORS = 4096


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (integral doubles) and norm of the rows that take part."""
    # floor() of a double is a long: beyond its range the double itself is integral already
    small = lambda x: F.when(F.abs(x) < 2.0**52, x)
    scaled = F.transform(F.transform(vector_col, lambda x: x.cast("double")), lambda x: F.coalesce(F.floor(F.lit(256.0) * small(x)).cast("double"), F.lit(256.0) * x))
    fits = F.col(vector_col).isNotNull() & F.coalesce(
        F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)
    )
    good = rows.where(fits).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))
    return good.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False) if len(lengths) else np.empty(0)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), lengths[0])
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def _products(q: np.ndarray, p: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer products as int64; Python integers where doubles are not exact."""
    if largest < 2**53:
        return (q @ p.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in p], object).reshape(p.shape).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class Search:
    """Running top-k of one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, theta: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors * vectors).sum(1))
        self.floor = np.full(len(ids), -np.inf) if theta is None else theta.astype(float)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def _offer(self, i: int, scores: np.ndarray, vec_ids: np.ndarray) -> None:
        ok = (scores >= self.floor[i]) & (vec_ids != self.ids[i])
        if not ok.any():
            return
        s, v = np.concatenate([self.best[i][0], scores[ok]]), np.concatenate([self.best[i][1], vec_ids[ok]])
        if len(s) > 4 * self.k:  # narrow before the sort, ties kept
            ok = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, v = s[ok], v[ok]
        top = np.lexsort((v, -s.astype(object) if (s == -(2**63)).any() else -s))[: self.k]
        self.best[i] = s[top], v[top]
        if len(top) == self.k:
            self.floor[i] = max(self.floor[i], float(self.best[i][0][-1]))

    def bucket(self, vec_ids: np.ndarray, p: np.ndarray, norms: np.ndarray) -> None:
        """One bucket: norms descending."""
        q, p = _same_width(self.q, p)
        longest = norms[0]
        largest = float(longest * self.norm.max(initial=0))
        with np.errstate(divide="ignore", invalid="ignore"):
            local = self.floor / (self.norm * longest)
            need = self.floor / self.norm  # least norm that can reach theta
        slack = 1e-9
        zero = (self.norm == 0) | (longest == 0)
        active = np.where(zero, self.floor <= 0, local <= 1 + slack)
        by_coordinates = active & ~zero & (local >= COORDINATES_FROM)
        by_length = np.flatnonzero(active & ~by_coordinates)
        if len(by_length):
            least = np.where(zero[by_length], 0, np.maximum(need[by_length], 0)) * (1 - slack)
            ends = np.searchsorted(-norms, -least, side="right")
            for a in range(0, len(by_length), 512):
                part, stop = by_length[a : a + 512], int(ends[a : a + 512].max())
                scores = _products(q[part], p[:stop], largest)
                reach = scores.max(1, initial=-(2**63)) >= self.floor[part]
                for j in np.flatnonzero(reach):
                    self._offer(part[j], scores[j], vec_ids[:stop])
        if by_coordinates.any():
            unit = p / np.maximum(norms, 1e-300)[:, None]
            for i in np.flatnonzero(by_coordinates):
                t = min(1.0, local[i]) - slack
                u = q[i] / self.norm[i]
                rest = np.arange(len(p))
                for f in np.argsort(-np.abs(u))[:FOCUS]:
                    spread = np.sqrt(max(0.0, (1 - u[f] * u[f]) * (1 - t * t))) + slack
                    low = -1.0 if u[f] * t - spread <= -1 or t < -u[f] else u[f] * t - spread
                    high = 1.0 if t < u[f] else u[f] * t + spread
                    x = unit[rest, f]
                    rest = rest[(x >= low - slack) & (x <= high + slack)]
                if len(rest):
                    self._offer(i, _products(q[i : i + 1], p[rest], largest)[0], vec_ids[rest])

    def add(self, vec_ids: np.ndarray, p: np.ndarray, norms: np.ndarray) -> None:
        for a in range(0, len(vec_ids), BUCKET):
            self.bucket(vec_ids[a : a + BUCKET], p[a : a + BUCKET], norms[a : a + BUCKET])


def top_k(rows: DataFrame, *, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest integer product for each row that ``queries`` marks.

    ``queries`` is a condition on ``vec_id``.
    """
    spark = ship(rows.sparkSession)
    good = quantised(rows, id_col, vector_col)
    ranged = saved(good.repartitionByRange(F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), F.asc("vec_id")), "vectors")
    asked = ranged.where(queries)
    n = asked.count()
    blocks = max(1, -(-n // query_block))
    seed = ranged.orderBy(F.desc("norm"), F.asc("vec_id")).limit(SEED_VECTORS).toArrow()
    seed_ids, seed_p, seed_norms = seed["vec_id"].to_numpy(), _matrix(seed["v"]), seed["norm"].to_numpy()
    found, folder = None, new_dir(spark, "found")
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
        block = mine.select("vec_id", "v").toArrow()
        ids, vectors = block["vec_id"].to_numpy(), _matrix(block["v"])
        first = Search(ids, vectors, k)
        if len(ids) and len(seed_ids):
            first.add(seed_ids, seed_p, seed_norms)
        use = spark.sparkContext.broadcast((ids, vectors, first.floor))

        def run(batches, use=use, b=b):
            ids, vectors, theta = use.value
            search = Search(ids, vectors, k, theta)
            for batch in batches:
                if batch.num_rows and len(ids):
                    norms = batch.column("norm").to_numpy()
                    order = np.argsort(-norms, kind="stable")
                    search.add(batch.column("vec_id").to_numpy()[order], _matrix(batch.column("v"))[order], norms[order])
            some = [i for i in range(len(ids)) if len(search.best[i][0])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(b << 32) + i for i in some], pa.int64()),
                    pa.array([int(ids[i]) for i in some], pa.int64()),
                    pa.array([[{"score": int(s), "vec_id": int(v)} for s, v in zip(*search.best[i], strict=True)] for i in some], pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))),
                ],
                ["query", "query_id", "best"],
            )

        part = ranged.mapInArrow(run, "query long, query_id long, best array<struct<score: long, vec_id: long>>")
        if blocks == 1:
            found = part
        else:  # a job for each block; the plan doesn't grow with their number
            part.write.mode("append").parquet(folder)
            use.destroy()
    if found is None:
        found = spark.read.schema("query long, query_id long, best array<struct<score: long, vec_id: long>>").parquet(folder)
    # (query, query_id): a row of at most k pairs from each task
    merged = found.groupBy("query", "query_id").agg(F.flatten(F.collect_list("best")).alias("all"))
    ordered = F.array_sort(
        "all",
        lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1).otherwise(0),
    )
    top = merged.select("query_id", F.posexplode(F.slice(ordered, 1, k)).alias("at", "hit"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
