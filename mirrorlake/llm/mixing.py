"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Every source has an integer weight a; a period serves a blocks of each source that has
any left. Within a period of D blocks, block j (from 0) of a source that has b blocks in
it is released at floor(j D / b) and due at ceil((j + 1) D / b); each slot goes to the
released block with the earliest deadline. The deadlines can always be met, so a source
is at every slot less than one block from its target share.

Period p serves min(a, max(0, n - p a)) blocks of a source with n blocks, so it starts at
slot sum(min(n, p a)), and the pattern of a period changes only where a source runs out.
All positions follow from arithmetic and a small table of patterns; no row waits for
another. Order within a source is by MD5 of the id; ranks are taken in buckets of an MD5
prefix, so no task orders a whole source, however large it is; what the buckets before hold
is summed in two levels of the prefix.

Sources without a weight of their own, and null, form one pool named ``*`` with the rest
weight, so there are at most len(weights) + 1 pools and the pattern table is bounded by
that and the weights, whatever the data.

Defined results: each input row is scheduled exactly once, however often it repeats; rows
with equal id are ordered by a hash of all their columns; null ids are placed by that hash; a pool without rows
has no share; an empty table gives an empty schedule. Columns named like outputs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm.common import without

REST = "*"
#: Documents of a block.
BLOCK_DOCS = 8
#: Rows that one rank bucket has, about.
BUCKET_ROWS = 4096
OUT = ("pool", "block", "slot", "in_block")


def _pattern(counts):
    """Array of pool numbers, the slots of one period: earliest deadline first. ``counts``: blocks of each pool."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def choose(state, slot):
        done = state["done"]
        open_ = F.transform(
            counts,
            lambda b, i: F.when(
                (F.get(done, i) < b) & (F.floor(F.get(done, i) * total / b) <= slot),
                F.struct(F.ceil((F.get(done, i) + 1) * total / b).alias("due"), i.alias("pool")),
            ),
        )
        pool = F.array_min(F.filter(open_, lambda x: x.isNotNull()))["pool"]
        return F.struct(
            F.transform(done, lambda d, i: F.when(i == pool, d + 1).otherwise(d)).alias("done"),
            F.concat(state["slots"], F.array(pool)).alias("slots"),
        )

    start = F.struct(F.transform(counts, lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("slots"))
    return F.when(total > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, choose)["slots"]).otherwise(F.array().cast("array<int>"))


def schedule(
    docs: DataFrame,
    weights: dict[str, int],
    *,
    rest_weight: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Input columns plus pool, block (number within the pool), slot (place of the block in the mix) and in_block.

    Ordering by (slot, in_block) is the mix.
    """
    if any(w < 1 for w in [*weights.values(), rest_weight]):
        raise ValueError("weights are positive integers")
    docs = without(docs, *OUT)
    pools = [*sorted(weights), REST]
    table = {p: (i, weights.get(p, rest_weight)) for i, p in enumerate(pools)}
    pool_no = F.lit(len(pools) - 1)
    if weights:
        numbers = F.create_map(*[F.lit(x) for p in sorted(weights) for x in (p, table[p][0])])
        pool_no = F.coalesce(F.try_element_at(numbers, F.coalesce(F.col(source_col).cast("string"), F.lit(""))), pool_no)
    names = F.array(*[F.lit(p) for p in pools])

    total = docs.select(F.count(F.lit(1))).first()[0]
    digits = min(8, max(2, math.ceil(math.log(max(1, total / BUCKET_ROWS), 16))))
    tie = F.xxhash64(*docs.columns)
    dealt = docs.select(
        F.struct(*docs.columns).alias("_row"),
        pool_no.alias("_pool"),
        F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.md5(tie.cast("string").cast("binary"))).alias("_key"),
        tie.alias("_tie"),
    ).withColumn("_bucket", F.substring("_key", 1, digits))
    # ranks: inside a bucket by window, plus what the buckets before it hold
    sizes = dealt.groupBy("_pool", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # summed in two levels, so that no window holds more than the square root of the buckets
    fine = sizes.withColumn("_part", F.substring("_bucket", 1, digits // 2))
    parts = fine.groupBy("_pool", "_part").agg(F.sum("_n").alias("_n")).selectExpr("_pool", "_part", "sum(_n) OVER (PARTITION BY _pool ORDER BY _part) - _n AS _start")
    within = fine.selectExpr("_pool", "_part", "_bucket", "sum(_n) OVER (PARTITION BY _pool, _part ORDER BY _bucket) - _n AS _inside")
    before = within.join(parts, ["_pool", "_part"]).selectExpr("_pool", "_bucket", "_start + _inside AS _before")
    per_pool = sizes.groupBy("_pool").agg(F.ceil(F.sum("_n") / block_docs).cast("long").alias("_blocks"))
    ranked = (
        dealt.selectExpr("*", "row_number() OVER (PARTITION BY _pool, _bucket ORDER BY _key, _tie) - 1 AS _local")
        .join(before, ["_pool", "_bucket"])
        .withColumn("_rank", F.col("_local") + F.col("_before"))
        .withColumn("_block", F.floor(F.col("_rank") / block_docs))
    )
    # one row: blocks n and weight a of every pool
    stock = per_pool.agg(F.map_from_entries(F.collect_list(F.struct("_pool", "_blocks"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(len(pools) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("n"),
        F.array(*[F.lit(table[p][1]).cast("long") for p in pools]).alias("a"),
    )
    full = F.zip_with("n", "a", lambda n, a: F.floor(n / a))  # periods that a pool fills
    regimes = stock.select("n", "a", F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), full, F.transform(full, lambda x: x + 1)))).alias("from"))
    counts = F.transform(F.arrays_zip("n", "a"), lambda x: F.greatest(F.lit(0).cast("long"), F.least(x["a"], x["n"] - F.col("from") * x["a"])))
    patterns = (
        regimes.withColumn("slots", _pattern(counts))
        .select("from", F.posexplode("slots").alias("at", "_pool"))
        .selectExpr("`from`", "at", "_pool", "row_number() OVER (PARTITION BY `from`, _pool ORDER BY at) - 1 AS _j")
    )
    starts = stock.select(
        "n", "a", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), full, F.transform(full, lambda x: x + 1)))).alias("starts")
    )
    a = F.element_at("a", F.col("_pool") + 1)
    period = F.floor(F.col("_block") / a)
    placed = (
        ranked.join(F.broadcast(starts))  # one row
        .withColumn("_period", period)
        .withColumn("_j", (F.col("_block") % a).cast("int"))
        .withColumn("from", F.array_max(F.filter("starts", lambda s: s <= F.col("_period"))))
        .withColumn("_base", F.aggregate(F.arrays_zip("n", "a"), F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], F.col("_period") * x["a"])))
        .drop("n", "a", "starts")
        .join(F.broadcast(patterns), ["from", "_pool", "_j"])  # at most (2 pools + 1) x sum of weights rows
    )
    return placed.select(
        "_row.*", F.element_at(names, F.col("_pool") + 1).alias("pool"), F.col("_block").alias("block"),
        (F.col("_base") + F.col("at")).alias("slot"), (F.col("_rank") % block_docs).cast("int").alias("in_block"),
    )
