"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words are runs free of blank and \\t..\\r, shingles of
``k`` words joined by a blank (a shorter text is one shingle), each hashed with
XXH64 (seed 42); a bit is set if it is set in more than half of the hashes. Text
that is null or has no word has fingerprint zero, which links like any other.

Linking works on distinct fingerprints. Correlated bits are grouped into
partitions from an exact co-occurrence matrix of all fingerprints. If two differ
in at most r bits, then for any thresholds t_i with sum(t_i + 1) = r + 1 some
partition differs in at most t_i bits. Number of partitions and thresholds come
from a dynamic programme that weighs probes against estimated candidates, so
that wider partitions are taken as the data grow. Each fingerprint is an index
entry under its partition values and probes the ball of radius t_i around them.
Values held by very many fingerprints are split into pairs of blocks, so that a
task holds two blocks at most; candidates are verified on all 64 bits, and only a
spanning forest of the links found in a block leaves the task.

Components: rounds that contract every node into its smallest neighbour under a
random order, with pointer jumping, until the links left are few enough (checked)
for one task. Nothing is collected on the driver.

``similar`` serves a Jaccard similarity of shingle sets instead of a radius of few bits, by the same principle on
the sets themselves. Two sets of n and m shingles at similarity t differ in at most d = (1 - t) / (1 + t) (n + m)
shingles. The shingles are split into partitions by their hash, more for larger sets; at most d partitions
differ. So a set that probes any d + 1 of its partitions, holding shingles, meets in one of them every set that
is not larger and similar: thresholds are 0 for those probed and none for the others, and those probed are the ones
with the least estimated candidates: partitions with the most shingles, or, for sets of up to ``SHORT`` shingles,
where each shingle is a partition, the rarest by a sketch of counts. A set probes its own size class and those
of the smaller sets that may be similar. Candidates that a bound by parity bitmaps doesn't rule out (it loses
none) are decided by the Jaccard similarity of their sets, so every link is a true one. Pairs are tried in two rounds:
a spanning forest of the possible pairs of each list (or pair of blocks of a long one); then, in the lists where
one of these was refuted, all possible pairs of different components.
With a ``radius``, the texts whose fingerprints are within so many bits are linked first, as ``near_duplicates`` does; then
the sets bring the links of similar texts whose fingerprints are further apart, and only pairs not yet joined are tried.
A set is known by a 64-bit hash; a similar pair is missed only if more than 16 shingles of a set fall on fewer
than d + 1 partitions (below 1e-11 for a set).

Defined results: repeated documents are one fingerprint and link to each other;
rows with null doc_id take part and get the component of their fingerprint (null
if no row of the component has an id); an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import ship
from mirrorlake.llm.common import binary_values, per_task_vector, release, saved, scratch, without

SHINGLE = 3
RADIUS = 3
BITS = 64
#: Fingerprints in one block of a partition value that very many share.
BLOCK = 512
#: Links that one task may finish.
FEW_LINKS = 12_000
_ONE = np.uint64(1)
#: ``similar``: words of a shingle, Jaccard similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Sets of up to so many shingles are found by single shingles.
SHORT = 16
#: 64-bit words of a parity bitmap; its bitmaps in one block; members of a list that a task holds to look for partners.
WORDS, WIDE_BLOCK, LONG_LIST = 10, 1024, 200_000
#: Counters of the sketch that orders shingles; nodes whose texts are found by broadcast (by shuffle beyond).
SLOTS, FEW_NODES = 1 << 20, 200_000
_EPS = 1e-9


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    k = min(k, len(words))
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``keep`` columns (all by default) plus ``fp``, the fingerprint as a signed long."""
    docs = without(docs, "fp")
    keep = docs.columns if keep is None else keep

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, k) for t in binary_values(batch.column(text_col))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found.view(np.int64))], [*keep, "fp"])

    carried = docs.select(*dict.fromkeys([*keep, text_col]))
    return carried.mapInArrow(run, T.StructType([carried.schema[c] for c in keep] + [T.StructField("fp", T.LongType())]))


# ---- the plan: partitions and thresholds ------------------------------------------------


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set."""

    def add(total, batch):
        bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total[0] += len(bits)
        for i in range(0, len(bits), 4096):
            part = bits[i : i + 4096]
            total[1:] += (part.T @ part).ravel()

    got = per_task_vector(fps.select("fp"), 1 + BITS * BITS, add)
    return (0, np.zeros((BITS, BITS))) if got is None else (int(got[0]), got[1:].reshape(BITS, BITS))


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits into ``m`` groups of near equal size, each grown around strongly correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = len(free) // (m - g)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def _ball(bits: int, t: int) -> int:
    return sum(math.comb(bits, d) for d in range(t + 1))


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds (-1: not probed) of least estimated cost."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best = None
    for m in range(2, 2 * (radius + 1)):
        groups = group_bits(n, both, m)
        costs = []  # of each group at thresholds -1, 0, ...
        for group in groups:
            dist = np.zeros(len(group) + 1)
            dist[0] = 1
            for b in group:  # distribution of the distance within the group
                dist[1:] = dist[1:] * (1 - differ[b]) + dist[:-1] * differ[b]
                dist[0] *= 1 - differ[b]
            near = np.cumsum(dist)
            costs.append([0.0] + [40.0 * n * (1 + _ball(len(group), t)) + n * n * near[t] for t in range(radius + 1)])
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:  # spend radius + 1 units of t_i + 1
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for t in range(-1, radius + 1 - used):
                    new = (c + cost[t + 1], [*ts, t])
                    if used + t + 1 not in step or new < step[used + t + 1]:
                        step[used + t + 1] = new
            table = step
        c, ts = table[radius + 1]
        if best is None or c < best[0]:
            best = (c, groups, ts)
    return best[1], best[2]


def _value(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & _ONE) << np.uint64(k)
    return out


# ---- candidates and verification ------------------------------------------------------


def _entries(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, value, fp): every fingerprint under its own values, and under those within a threshold above 0."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                own = _value(fp, group)
                for d in range(t + 1):
                    for flip in itertools.combinations(range(len(group)), d):
                        mask = np.uint64(sum(1 << f for f in flip))
                        values = pa.array((own ^ mask).view(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), values, batch.column(0)], ["part", "value", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, value long, fp long")


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _thinned(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with the transitive closure of a symmetric matrix: the matrix if sparse, else a star for each component."""
    if near.sum() <= 8 * len(near):
        return np.nonzero(np.triu(near, 1))
    b = np.arange(len(near))
    while True:
        least = np.where(near, b[None], len(near)).min(1)
        least = np.minimum(b, least[least])
        if (least == b).all():
            break
        b = least
    a = np.flatnonzero(b != np.arange(len(near)))
    return a, b[a]


def _links(u: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs whose transitive closure is that of all near pairs among ``u``, of bounded length: no more than a few a row."""
    if len(u) < 8:
        return [(x, y) for x, y in itertools.combinations(u.tolist(), 2) if (x ^ y).bit_count() <= radius]
    a, b = _thinned(np.bitwise_count(u[:, None] ^ u[None]) <= radius)
    return list(zip(u[a].tolist(), u[b].tolist(), strict=True))


def node_of(fp: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of fingerprints: random order of nodes."""
    x = fp.view(np.uint64).copy()
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _verify(entries: DataFrame, radius: int) -> DataFrame:
    """Rows sorted by group in; a spanning forest (a, b) of the near pairs of each task out.

    A group is the holders of one partition value, at most a block of them, or two blocks.
    """

    def run(batches):
        forest, out = _Union(), []

        def close(rows):
            if len(rows) < 2:
                return
            for x, y in _links(np.unique(rows["fp"]), radius):  # one group, or two blocks of a large one
                if forest.join(x, y):
                    out.append((x, y))

        def emit():
            pairs = node_of(np.array(out, np.uint64).reshape(-1, 2).ravel()).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        kind = [("part", np.int32), ("value", np.int64), ("lo", np.int32), ("hi", np.int32), ("fp", np.uint64)]
        rest = np.empty(0, kind)
        for batch in batches:
            rows = np.empty(batch.num_rows, kind)
            for name, _ in kind:
                x = batch.column(name).to_numpy(zero_copy_only=False)
                rows[name] = x.view(np.uint64) if name == "fp" else x
            rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for name in ("part", "value", "lo", "hi"):
                new[1:] |= rows[name][1:] != rows[name][:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [len(rows)]])
            many = np.flatnonzero(np.diff(cuts) > 1)
            for g in many[many < len(cuts) - 2]:
                close(rows[cuts[g] : cuts[g + 1]])
            rest = rows[cuts[-2] :].copy()
            if len(out) > 10_000:
                yield emit()
        close(rest)
        yield emit()

    return entries.mapInArrow(run, "a long, b long")


def _large(entries: DataFrame, block: int) -> DataFrame:
    """Partition values held by more than a block, at most one row for each ``block`` entries, with the number of blocks."""
    many = entries.groupBy("part", "value").count().where(F.col("count") > block)
    return many.select("part", "value", F.ceil(F.col("count") / block).cast("int").alias("blocks"))


def _dealt(entries: DataFrame, large: DataFrame, by: str) -> DataFrame:
    """Entries with the pair of blocks (lo, hi) they meet in: one pair for most, all pairs of their own block for large values."""
    kept = [c for c in entries.columns if c not in ("part", "value")]
    return (
        entries.join(large, ["part", "value"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *kept)
    )


def near_links(fps: DataFrame, *, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between ``node_of`` distinct fingerprints ``fp``; transitively, all pairs within ``radius``."""
    n, both = co_occurrence(fps)
    groups, thresholds = plan(n, both, radius)
    entries = _entries(fps, groups, thresholds)
    dealt = _dealt(entries, _large(entries, block), "fp")
    keys = ["part", "value", "lo", "hi"]
    return _verify(dealt.repartition(*keys).sortWithinPartitions(*keys), radius)


# ---- components ---------------------------------------------------------------------


def _finish(links: DataFrame) -> DataFrame:
    """Components of a few links in one task: (node, root)."""

    def run(batches):
        forest = _Union()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
                forest.up.setdefault(a, a)
                forest.up.setdefault(b, b)
        nodes = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, *, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) for every node that has a link; nodes of one component share the root."""
    links = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping = None  # node -> where earlier rounds moved it
    while links.count() > few:
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = saved(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        for _ in range(2):  # pointer jumping
            next_ = down.select(F.col("node").alias("to"), F.col("to").alias("next"))
            down = saved(down.join(next_, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "hooks")
        links = saved(
            links.join(down.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(down.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        if mapping is None:
            mapping = down.select("node", F.col("to").alias("root"))
        else:
            mapping = saved(
                mapping.join(down.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
            )
    last = _finish(links)
    if mapping is None:
        return last
    return mapping.join(last.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (signed long) and component_id, the smallest id reachable over links; one row for each input row.

    With ``carry``, also those columns and ``root``, which names the component where it has no id.
    """
    ship(docs.sparkSession)
    fps = fingerprints(docs.select(id_col, text_col, *carry), keep=[id_col, *carry], text_col=text_col, k=k)

    def nodes(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(fp))], [*batch.schema.names, "node"])

    fps = saved(fps.mapInArrow(nodes, T.StructType([*fps.schema, T.StructField("node", T.LongType())])), "fingerprints")
    named = saved(fps.groupBy("node", "fp").agg(F.min(id_col).alias("least")), "distinct")
    found = components(near_links(named, radius=radius))
    return _named_components(fps, named.select("node", "least"), found, id_col, carry=carry)


def _named_components(fps: DataFrame, named: DataFrame, found: DataFrame, id_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, fp, node) with the least id of their node's component; ``least`` is written before it is joined, so that Spark can split large components."""
    rooted = saved(named.join(found, "node").select("node", "least", "root"), "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    linked = rooted.join(least, "root").select("node", "component_id", "root")
    alone = named.join(found, "node", "left_anti").select("node", F.col("least").alias("component_id"), F.col("node").alias("root"))
    by_node = saved(linked.unionByName(alone), "nodes")
    return fps.join(by_node, "node").select(id_col, "fp", "component_id", *carry, *["root"][: len(carry)])


# ---- a given similarity of shingle sets ---------------------------------------------


def shingle_set(text: bytes | None, k: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Distinct XXH64 hashes of the shingles, sorted."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    k = min(k, len(words))
    digest, starts, stops = xxhash.xxh64_intdigest, (ends - sizes).tolist(), (ends[k - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops)))


def set_node(shingles: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def parity(shingles: np.ndarray) -> bytes:
    """``WORDS`` words of bits, each the parity of the shingles that fall on it: two differ in no more bits than their sets in shingles."""
    at = ((shingles >> np.uint64(20)) % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * WORDS) & 1, bitorder="little").tobytes()


def most_apart(n, m, similarity: float):
    """Shingles in which two sets of ``n`` and ``m`` at the similarity may differ, at most."""
    return np.floor((1 - similarity) / (1 + similarity) * (n + m) + _EPS).astype(np.int64)


def _may(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """If sets of ``n`` and ``m`` shingles can be at ``similarity``."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - _EPS


class Classes:
    """Size classes: class 0 up to ``SHORT`` shingles, then ranges whose ends are at the similarity of each other."""

    def __init__(self, similarity: float):
        self.similarity, self.last = similarity, [0, SHORT]  # of the class before, and of each

    def of(self, n: int) -> int:
        while self.last[-1] < n:
            low = self.last[-1] + 1
            self.last.append(max(low, int(low / self.similarity)))
        return bisect.bisect_left(self.last, n, 1) - 1

    def partitions(self, c: int) -> int:
        """Partitions of the shingles for the sets of a class; 0: each shingle is one."""
        return 0 if c == 0 else math.ceil(2 * (1 - self.similarity) * (self.last[c] + 1)) + 16


def _sub_sets(shingles: np.ndarray, c: int, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each partition that holds shingles: hash of these, how many they are, and the first one."""
    if not partitions:
        at, values = np.arange(len(shingles)), shingles
    else:
        part = ((shingles >> np.uint64(8)) % np.uint64(partitions)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.diff(part[by], prepend=-1))
        shingles = shingles[by]
        values = np.add.reduceat(shingles * np.uint64(0xD6E8FEB86659FD93) ^ (shingles >> np.uint64(29)), at)
        values = values + part[by][at].astype(np.uint64)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), np.diff(np.append(at, len(shingles))), shingles[at]


INDEX, PROBE = 1, 2


def set_entries(shingles: np.ndarray, classes: Classes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values under which a set is found, and whether by index, by probe or both (flags)."""
    n = len(shingles)
    own = classes.of(n)
    values, flags = [], []
    for c in range(classes.of(math.ceil(classes.similarity * n - _EPS)), own + 1):
        found, sizes, first = _sub_sets(shingles, c, classes.partitions(c))
        need = int(most_apart(n, min(n, classes.last[c + 1]), classes.similarity)) + 1
        cost = counts[_slot(first)] if c == 0 else -sizes  # few candidates: rare shingles, or partitions with many
        probed = np.zeros(len(found), np.int8)
        probed[np.lexsort((found, cost))[:need]] = PROBE
        if c == own:
            values.append(found)
            flags.append(probed | INDEX)
        else:
            values.append(found[probed > 0])
            flags.append(probed[probed > 0])
    return np.concatenate(values), np.concatenate(flags)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def _short_counts(fps: DataFrame) -> np.ndarray:
    """How many shingles of the short sets fall on each counter; of equal rows in a batch, one counts."""

    def add(total, batch):
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in pc.unique(batch.column(0)) if v.is_valid]
        if sets:
            total += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS)

    got = per_task_vector(fps.select("short"), SLOTS, add)
    return np.zeros(SLOTS, np.uint32) if got is None else np.minimum(got, 2**32 - 1).astype(np.uint32)


def _entries_of_sets(docs: DataFrame, text_col: str, k: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """(value, node, n, flag) of every set; a set that a task has met before is left out, as its entries are the same."""
    names = ["value", "node", "n", "flag"]

    def run(batches):
        classes, met = Classes(similarity), set()

        def entries(shingles, node):
            if len(shingles) and node not in met:
                if len(met) >= FEW_NODES:
                    met.clear()
                met.add(node)
                values, flags = set_entries(shingles, classes, counts)
                return values.view(np.int64), np.full(len(values), node), np.full(len(values), len(shingles), np.int32), flags
            return None

        for batch in batches:
            held, rows = [], 0
            for text in binary_values(batch.column(0)):
                shingles = shingle_set(text, k)
                found = entries(shingles, set_node(shingles))
                if found:
                    held.append(found)
                    rows += len(found[0])
                if rows > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

    return docs.select(text_col).mapInArrow(run, "value long, node long, n int, flag byte")


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], axis=1)


def _partnered(rows: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows (value, n, node, flag), sorted, have one in their list that they can meet: a probe and an index of fitting sizes."""
    value, n, _, flag = rows.T
    probe, index = (flag & PROBE) > 0, (flag & INDEX) > 0

    def near(mine, theirs, step):
        """If the next of ``theirs`` in direction ``step`` fits."""
        at = np.flatnonzero(theirs)
        here = np.arange(len(rows))
        k = np.searchsorted(at, here, "left") - 1 if step < 0 else np.searchsorted(at, here, "right")
        there = (k >= 0) & (k < len(at))
        x = at[np.clip(k, 0, max(0, len(at) - 1))] if len(at) else here
        return mine & there & (value[x] == value) & _may(n, n[x], similarity), there & (n[x] == n)

    smaller, _ = near(probe, index, -1)
    equal, same = near(probe, index, 1)
    larger, _ = near(index, probe, 1)
    equal2, same2 = near(index, probe, -1)
    return smaller | (equal & same) | larger | (equal2 & same2)


def _shared(entries: DataFrame, similarity: float) -> DataFrame:
    """Rows sorted by value, n and node in; those out, once each, that have a partner in their list."""
    names = ("value", "n", "node", "flag")

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(t)) for i, t in enumerate((np.int64, np.int32, np.int64, np.int8))], list(names))

    def run(batches):
        rest, open_value = np.empty((0, 4), np.int64), None
        for batch in itertools.chain(batches, [None]):
            rows = rest if batch is None else np.concatenate([rest, _numbers(batch, names)])
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            rows = rows[new]
            cut = len(rows) if batch is None else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            whole, rest = rows[:cut], rows[cut:].copy()
            if len(whole):
                keep = _partnered(whole, similarity)
                if open_value is not None:  # a part of this list went out before: all of it does
                    keep |= whole[:, 0] == open_value
                yield made(whole[keep])
            if len(rest) > LONG_LIST:
                open_value = int(rest[0, 0])
                yield made(rest[:-1])
                rest = rest[-1:]

    return entries.repartition("value").sortWithinPartitions(*names[:3]).mapInArrow(run, "value long, n int, node long, flag byte")


def _wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), np.uint64).reshape(-1, WORDS)



def _block_pairs(dealt: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Rows sorted by list and blocks in; pairs (a, b, value) of different components that may be similar, or a spanning forest of the components of a block by such pairs."""

    def thinned(root, a, b):
        """Of the pairs, those that join components which none before has joined."""
        joined = _Union()
        use = [i for i, (x, y) in enumerate(zip(root[a].tolist(), root[b].tolist(), strict=True)) if joined.join(x, y)]
        return a[use], b[use]

    def pairs(keys, nodes, fps):
        """Whole lists in."""
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        out = []
        for lo, hi in itertools.pairwise(cuts.tolist()):
            (node, root, n, flag), fp = nodes[lo:hi].T, fps[lo:hi]
            probe, index = (flag & PROBE) > 0, (flag & INDEX) > 0
            held = []
            for i in range(0, hi - lo, 128):
                rows = slice(i, i + 128)
                fits = (probe[rows, None] & index[None] & (n[rows, None] >= n[None])) & _may(n[rows, None], n[None], similarity) & (root[rows, None] != root[None])
                a, b = np.nonzero(fits)
                if 4 * len(a) < fits.size:
                    apart = np.bitwise_count(fp[i + a] ^ fp[b]).sum(1, dtype=np.int64)
                else:
                    apart = np.zeros(fits.shape, np.int64)
                    for w in range(WORDS):
                        apart += np.bitwise_count(fp[rows, w, None] ^ fp[None, :, w])
                    apart = apart[a, b]
                near = apart <= most_apart(n[i + a], n[b], similarity)
                a, b = i + a[near], b[near]
                held.append(thinned(root, a, b) if forest else (a, b))
            a, b = map(np.concatenate, zip(*held, strict=True))
            if forest:
                a, b = thinned(root, a, b)
            out.append((np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), np.full(len(a), keys[lo, 0])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "value"])

    def run(batches):
        keys, nodes, fps = np.empty((0, 3), np.int64), np.empty((0, 4), np.int64), np.empty((0, WORDS), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = np.concatenate([keys, _numbers(batch, ("value", "lo", "hi"))]), np.concatenate([nodes, _numbers(batch, ("node", "root", "n", "flag"))])
            fps = np.concatenate([fps, _wide(batch.column("fp"))])
            other = np.flatnonzero((keys != keys[-1]).any(1))
            if len(other):
                end = int(other[-1]) + 1
                yield pairs(keys[:end], nodes[:end], fps[:end])
                keys, nodes, fps = keys[end:].copy(), nodes[end:].copy(), fps[end:].copy()
        if len(keys):
            yield pairs(keys, nodes, fps)

    return dealt.mapInArrow(run, "a long, b long, value long").distinct()


def _decided(pairs: DataFrame, named: DataFrame, docs: DataFrame, text_col: str, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at ``similarity``, counted on the sets of their texts."""
    wanted = saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(named.select("node", "source"), "node"), "wanted")
    texts = docs.select(F.md5(F.col(text_col)).alias("source"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(wanted) if wanted.count() <= FEW_NODES else wanted, "source").select("node", "text").dropDuplicates(["node"])

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t, k).tobytes() for t in binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    sets = saved(one.mapInArrow(sets, "node long, shingles binary"), "sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))

    def decide(batches):
        for batch in batches:
            good = []
            for u, v in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                u, v = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= similarity * (len(u) + len(v) - both) - _EPS)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return saved(pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(decide, "a long, b long"), "near")


def marked_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the nodes of rows whose fingerprints ``mark`` are within ``radius`` of each other, transitively."""

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(batch.column("fp").to_numpy()))], ["fp", "mark"])

    marks = saved(fps.select(F.col("mark").alias("fp")).distinct().mapInArrow(named, "fp long, mark long"), "marks")
    roots = components(near_links(marks, radius=radius)).withColumnRenamed("node", "mark")
    roots = saved(marks.join(roots, "mark", "left").select(F.col("fp").alias("mark"), F.coalesce("root", "mark").alias("root")), "roots")
    rooted = saved(fps.select("node", "mark").distinct().join(roots, "mark").select("node", "root"), "rooted")
    hubs = saved(rooted.groupBy("root").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").select("root", "hub"), "hubs")
    return saved(rooted.join(hubs, "root").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "marked")


def similar_links(entries: DataFrame, named: DataFrame, docs: DataFrame, *, text_col: str, k: int, similarity: float, block: int = WIDE_BLOCK, linked: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes; transitively, all pairs whose shingle sets are at ``similarity``, and no others but those of ``linked``."""
    lists = saved(_shared(entries, similarity), "lists")
    release(docs.sparkSession)  # the entries' shuffle files, the largest of all
    keys = ["value", "lo", "hi"]

    def tried(rows, forest):
        rows = rows.join(named.select("node", "fp"), "node").select(F.lit(0).alias("part"), "value", "node", "root", "n", "flag", "fp")
        dealt = _dealt(rows, _large(rows, block), "node")
        return _block_pairs(dealt.repartition(*keys).sortWithinPartitions(*keys), similarity, forest)

    def under(rows, links):
        return rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    first = saved(tried(under(lists, linked) if linked is not None else lists.withColumn("root", F.col("node")), True), "pairs")
    links = _decided(first.select("a", "b").distinct(), named, docs, text_col, k, similarity)
    refuted = saved(first.join(links, ["a", "b"], "left_anti").select("value").distinct(), "refuted")  # only these lists can hold more links
    links = links if linked is None else links.unionByName(linked)
    rest = under(lists.join(refuted, "value", "left_semi"), links)
    more = tried(rest, False).select("a", "b").distinct().join(first.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return links.unionByName(_decided(saved(more, "pairs"), named, docs, text_col, k, similarity))


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int | None = None, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """id, fp (the parity bitmap) and component_id, as ``near_duplicates``, by similarity of shingle sets; with ``radius``, by fingerprints within it, too."""
    docs = ship(docs.sparkSession) and docs.select(id_col, text_col, *carry)

    def run(batches):
        for batch in batches:
            rows = []
            for t in binary_values(batch.column(1)):
                s = shingle_set(t, k)
                rows.append((parity(s), set_node(s), len(s), s.tobytes() if 0 < similarity * len(s) - _EPS <= SHORT else None))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.binary()))]
            marks = None if radius is None else np.fromiter(map(fingerprint, binary_values(batch.column(1))), np.uint64, batch.num_rows).view(np.int64)
            made.append(pa.nulls(batch.num_rows, pa.int64()) if radius is None else pa.array(marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *made], [id_col, *carry, "source", "fp", "node", "n", "short", "mark"])

    kinds = {"source": T.StringType(), "fp": T.BinaryType(), "node": T.LongType(), "n": T.IntegerType(), "short": T.BinaryType(), "mark": T.LongType()}
    schema = T.StructType([*[docs.schema[c] for c in (id_col, *carry)], *[T.StructField(c, t) for c, t in kinds.items()]])
    fps = saved(docs.withColumn("source", F.md5(F.col(text_col))).mapInArrow(run, schema), "fingerprints")
    named = saved(fps.groupBy("node").agg(F.min(id_col).alias("least"), F.min("source").alias("source"), F.first("fp").alias("fp"), F.first("n").alias("n")), "distinct")
    linked = None if radius is None else marked_links(fps, radius)
    entries = _entries_of_sets(docs, text_col, k, similarity, _short_counts(fps))
    found = components(similar_links(entries, named, docs, text_col=text_col, k=k, similarity=similarity, linked=linked, **options))
    return _named_components(fps.select(id_col, "fp", "node", *carry), named.select("node", "least"), found, id_col, carry=carry)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, **options) -> DataFrame:
    """Input columns of one row of each component: that with the smallest id, then hash of the row. ``find`` is near_duplicates or similar.

    Rows without an id come last, and one stays where no row of the component has an id. Of rows equal in all columns one stays.
    """
    columns = docs.columns
    ship(docs.sparkSession)
    marked = docs.withColumn("_row", F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]))
    with scratch(docs.sparkSession) as kept:
        found = saved(find(marked, id_col=id_col, text_col=text_col, carry=("_row",), **options), "found")
        best = saved(found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("_id"), F.col("_row"))).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "best")
        is_best = F.col(id_col).eqNullSafe(F.col("best._id")) & (F.col("_row") == F.col("best._row"))
        rows = found.join(best, "root").select(F.col(id_col).alias("_id"), F.col("_row").alias("_mark"), is_best.alias("kept"))
        rows = kept(saved(rows.groupBy("_id", "_mark", "kept").count().where("NOT kept OR count > 1"), "rows"))
    few = rows.count() <= FEW_NODES  # else by shuffle
    side = lambda df: F.broadcast(df) if few else df
    same = F.col("_row").eqNullSafe(F.col("_mark")) & F.col(id_col).eqNullSafe(F.col("_id"))
    left = marked.join(side(rows.where("NOT kept")), same, "left_anti")
    repeated = side(rows.where("kept"))
    if rows.where("kept").isEmpty():
        return left.select(*columns)
    once = left.join(repeated, same, "left_semi").dropDuplicates([id_col, "_row"])
    return left.join(repeated, same, "left_anti").select(*columns).unionByName(once.select(*columns))
