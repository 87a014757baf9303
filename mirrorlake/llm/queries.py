"""The registered queries of the ten operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.llm import decontam, langid, lm, mixing, quality, simhash, tokencount, topk, urlgraph, warc
from mirrorlake.llm.common import crc_mod, read, saved

#: Target weights of the mix: a block each period for a source, more for some; all others share ``*``.
MIX_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2, "src3": 2, **{f"src{i}": 1 for i in range(4, 20)}}
MIX_REST = 1

URL_RULES = [
    urlgraph.Rule("allow", "com", "/"),
    urlgraph.Rule("block", "example.com", "/en/"),
    urlgraph.Rule("allow", "www.example.com", "/en/"),
    urlgraph.Rule("block", "net", "/es/"),
    urlgraph.Rule("block", "net", "/fr/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.train(docs, where=crc_mod("doc_id", 3) != 1)
    held = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return langid.predict(held, net, keep=["doc_id", "held_out"])


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs, MIX_WEIGHTS, rest_weight=MIX_REST)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    found = lm.score(docs, train=~held, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_score_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_lm_score with its scores rounded, so that SQL gives the same values."""
    return op6_lm_score(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("base_score", "score")})


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_with_edits(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES, keep=["page_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = saved(quality.document_statistics(docs, keep=["doc_id"]), "statistics")
    fold = crc_mod("doc_id", 4)
    model = quality.fit(stats, read(spark, sf_dir, "labels"), train_rows=fold != 2, calibrate=fold == 3)
    found = quality.score(stats, model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_language_id, op3_topk_search, op4_warc, op5_source_mix,
        op6_lm_score, lm_score_digest, op7_token_counts, op8_simhash, op9_url_filter, op10_quality,
    )
}

_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _crc32(value: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit, as SQL."""
    bits = "list_reduce(range(0, 9), lambda a, k: CASE WHEN k = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, {0})"
    step = bits.format("xor(c, b)")
    return f"xor(list_reduce(list_transform(range(1, strlen({value}) + 1), lambda i: ascii(substr({value}, i::INT, 1))::BIGINT), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


def _lm_sql(order: int, mu: float) -> str:
    """Counts and scores by joins: one table of tokens with the n-grams that end there."""
    gram = lambda n, at="t": f"[{', '.join(f't{i}' for i in range(n - 1, -1, -1))}]" if at == "t" else f"[{', '.join(f't{i}' for i in range(n, 0, -1))}]"
    lags = ", ".join(f"lag(w, {i}) OVER (PARTITION BY r ORDER BY p) AS t{i}" for i in range(1, order))
    counts = "".join(f"g{n} AS (SELECT {gram(n)} AS g, count(*) FILTER (NOT held_out) AS c FROM s WHERE t{n - 1} IS NOT NULL GROUP BY 1),\n" for n in range(1, order + 1))
    joins = "".join(f" LEFT JOIN g{n} ON g{n}.g = {gram(n)}" for n in range(1, order + 1)) + "".join(f" LEFT JOIN g{n} AS h{n} ON h{n}.g = {gram(n, 'h')}" for n in range(1, order))
    p = "(coalesce(g1.c, 0) + 1.0::DOUBLE) / (n_all + v + 1)"
    for n in range(2, order + 1):
        p = f"CASE WHEN t{n - 1} IS NULL THEN {{0}} ELSE (g{n}.c + {mu}::DOUBLE * {{0}}) / (h{n - 1}.c + {mu}) END".format(f"({p})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc32("doc_id::VARCHAR")} % 7 = 2, false) AS held_out,
                  ['<s> '] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || ['</s> '] AS ws FROM documents),
k AS (SELECT r, doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
s AS (SELECT r, doc_id, held_out, w AS t0, p, {lags} FROM k),
{counts}n AS (SELECT sum(c)::BIGINT AS n_all, count(*) FILTER (c > 0) AS v FROM g1 WHERE g <> ['<s> ']),
x AS (SELECT s.r, s.doc_id, s.held_out, n_all, coalesce(g1.c, 0) AS c1, log10((coalesce(g1.c, 0) + 1.0::DOUBLE) / (n_all + v + 1)) AS b, log10({p}) AS m FROM s, n{joins} WHERE p > 1)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, any_value(n_all) AS train_tokens, round(sum(b), 4) AS base_score, round(sum(m), 4) AS score
FROM x GROUP BY r, doc_id, held_out"""


ORACLE_SQL = {
    "lm_score_digest": _lm_sql(lm.ORDER, lm.MU),
    "op1_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS g
        FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
dw AS (SELECT r, i, k, list_slice(w, i, i + k - 1) AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, i, k, item FROM dw JOIN win USING (g)),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)""",
    "op3_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)""",
    "op5_source_mix": f"""
WITH RECURSIVE weights(pool, a) AS (VALUES {", ".join(f"('{p}', {w})" for p, w in [*sorted(MIX_WEIGHTS.items()), (mixing.REST, MIX_REST)])}),
d AS (SELECT doc_id, source, CASE WHEN source IN (SELECT pool FROM weights WHERE pool <> '*') THEN source ELSE '*' END AS pool FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(doc_id::VARCHAR)) - 1 AS rank FROM d),
stock AS (SELECT pool, a, row_number() OVER (ORDER BY CASE WHEN pool = '*' THEN 1 ELSE 0 END, pool) - 1 AS no, ceil(count(doc_id) / 8)::BIGINT AS n
          FROM weights LEFT JOIN d USING (pool) GROUP BY pool, a),
periods AS (SELECT unnest(range(0, (SELECT max(n // a) + 1 FROM stock))) AS p),
share AS (SELECT p, pool, no, a, greatest(0, least(a, n - p * a)) AS b FROM periods, stock),
plans AS (SELECT p, sum(b)::BIGINT AS d, list(b ORDER BY no) AS bs FROM share GROUP BY p),
slots AS (
  SELECT p, d, bs, 0 AS t, list_transform(bs, lambda x: 0) AS done, NULL::BIGINT AS pick FROM plans WHERE d > 0
  UNION ALL
  SELECT p, d, bs, t + 1, list_transform(done, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best
  FROM (SELECT *, list_extract(list_sort(list_filter(list_transform(bs, lambda b, i:
            CASE WHEN done[i] < b AND (done[i] * d) // b <= t THEN [((done[i] + 1) * d + b - 1) // b, i] END), lambda x: x IS NOT NULL)), 1)[2] AS best
        FROM slots WHERE t < d)
),
placed AS (SELECT p, pick - 1 AS no, t - 1 AS place, row_number() OVER (PARTITION BY p, pick ORDER BY t) - 1 AS j FROM slots WHERE pick IS NOT NULL),
bases AS (SELECT p, sum(least(n, p * a))::BIGINT AS base FROM periods, stock GROUP BY p)
SELECT doc_id, source, r.pool, (rank // 8)::BIGINT AS block, (base + place)::BIGINT AS slot, (rank % 8)::INTEGER AS in_block
FROM ranked r JOIN stock USING (pool) JOIN placed ON placed.p = (rank // 8) // a AND placed.no = stock.no AND placed.j = (rank // 8) % a
JOIN bases ON bases.p = placed.p""",
}
