"""Benchmark decontamination: broadcast set of test n-grams, scan, verify, remove.

Words are maximal runs of ``[0-9a-z]`` and of characters from U+0080 up, after
lower-casing A-Z. A benchmark item gives every run of ``n`` consecutive words as
a window; an item with 1 to n-1 words is one window. The windows are turned into
a hash index over word ids. Documents are scanned by a map over Arrow batches
with no shuffle: a window key is looked up, then the word ids are compared, so a
hash collision can never make a hit.

The index is broadcast only in blocks of at most ``block_bytes`` of window text.
A larger benchmark is dealt into several blocks by hash of (window, item); each
block is one more pass whose hits are merged into those found so far.

Defined results: null or word-free text has no words and no hits; items with
null text or no words have no windows; a null item id can cause hits but is not
listed; repeated item ids count once; repeated documents are judged one by one;
an empty benchmark hits nothing. An input column named like an output column is
replaced by it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import ship
from mirrorlake.llm.common import binary_values, saved, without

NGRAM = 10
#: Window text in one broadcast block, about a quarter of what the built index takes.
BLOCK_BYTES = 64 << 20

_TO_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORD).split()


def _windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (window, item) pairs; a window is its words joined by blanks."""

    def make(batches):
        for batch in batches:
            windows, items = [], []
            for item, text in zip(batch.column(0), binary_values(batch.column(1)), strict=True):
                words = words_of(text or b"")
                for i in range(max(1, len(words) - n + 1) if words else 0):
                    windows.append(b" ".join(words[i : i + n]))
                    items.append(item.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"]
            )

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "window binary, item string").distinct()


class Index:
    """Windows as word-id rows, sorted by a key; items of each window."""

    def __init__(self, pairs: pa.Table):
        self.vocab: dict[bytes, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]] = {}
        found: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for window, item in zip(pairs["window"].to_pylist(), pairs["item"].to_pylist(), strict=True):
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in window.split())
            items = found.setdefault(len(ids), {}).setdefault(ids, [])
            if item is not None:
                items.append(item)
        for length, rows in found.items():
            ids = np.array(list(rows), np.int64)
            items = list(rows.values())
            for seed in range(64):  # a multiplier under which no two windows share a key
                mult = np.random.default_rng(seed).integers(1, 2**63, length, dtype=np.uint64) | np.uint64(1)
                keys = (ids.astype(np.uint64) * mult).sum(1, dtype=np.uint64)
                order = np.argsort(keys)
                if len(np.unique(keys)) == len(keys):
                    break
            else:
                raise ValueError("no collision-free key found for the benchmark windows")
            self.by_length[length] = (keys[order], ids[order], [items[i] for i in order], mult)

    def hits(self, ids: np.ndarray):
        """(start, length, items) arrays of every verified window in ``ids``; ids below 0 match nothing."""
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        for length, (keys, rows, items, mult) in self.by_length.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] == known[:-length])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(length):
                h += ids[at + k].astype(np.uint64) * mult[k]
            j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[j] == h
            at, j = at[same], j[same]
            if len(at):
                right = (rows[j] == ids[at[:, None] + np.arange(length)]).all(1)
                yield at[right], length, j[right], items


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_batch(index: Index, texts, before_spans, before_items):
    get, offsets, parts, n_words = index.vocab.get, [0], [], []
    for text in texts:
        words = words_of(text or b"")
        n_words.append(len(words))
        ids = np.full(len(words) + 1, -1, np.int64)  # the last one ends the document
        if words:
            ids[:-1] = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        parts.append(ids)
        offsets.append(offsets[-1] + len(ids))
    offsets = np.array(offsets)
    spans: dict[int, list[tuple[int, int]]] = {}
    named: dict[int, set[str]] = {}
    if parts:
        for at, length, j, items in index.hits(np.concatenate(parts)):
            docs = np.searchsorted(offsets, at, side="right") - 1
            for d, start, w in zip(docs.tolist(), (at - offsets[docs]).tolist(), j.tolist(), strict=True):
                spans.setdefault(d, []).append((start, start + length))
                named.setdefault(d, set()).update(items[w])
    out = []
    for d, n in enumerate(n_words):
        old = before_spans[d] or []
        runs = _merge([*zip(old[::2], old[1::2], strict=True), *spans.get(d, [])])
        out.append((n, sum(b - a for a, b in runs), [x for r in runs for x in r], sorted({*(before_items[d] or []), *named.get(d, ())})))
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: list[str] | None = None,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = NGRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns (all by default) plus n_words, n_hit, hit_spans and hit_items.

    ``hit_spans`` holds word positions start, end, start, end, ... of merged hit runs.
    """
    ship(docs.sparkSession)
    docs = without(docs, *_OUT.names)
    keep = [c for c in (docs.columns if keep is None else keep) if c in docs.columns]
    pairs = _windows(benchmark, item_col, item_text_col, n)
    size = pairs.agg(F.sum(F.length("window") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        pairs = saved(pairs, "windows")
    carried = list(dict.fromkeys([*keep, text_col]))
    out = docs.select(*carried)
    for b in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b) if blocks > 1 else pairs
        index = docs.sparkSession.sparkContext.broadcast(Index(part.toArrow()))
        last = b == blocks - 1
        columns = keep if last else carried
        schema = T.StructType([out.schema[c] for c in columns] + _OUT.fields)

        def run(batches, index=index, columns=columns):
            for batch in batches:
                had = batch.schema.names
                none = [None] * batch.num_rows
                rows = _scan_batch(
                    index.value,
                    binary_values(batch.column(text_col)),
                    batch.column("hit_spans").to_pylist() if "hit_spans" in had else none,
                    batch.column("hit_items").to_pylist() if "hit_items" in had else none,
                )
                new = [
                    pa.array([r[k] for r in rows], kind)
                    for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new, [*columns, *_OUT.names])

        out = out.mapInArrow(run, schema)
        if not last:
            out = saved(out, "decontam")
    return out


def cut_spans(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """Remove the hit words, and what stands between them, from the text of a ``scan`` result."""

    def cut(text: bytes, spans: list[int]) -> bytes:
        at = [m.span() for m in _WORD.finditer(text)]
        out, end = [], 0
        for a, b in zip(spans[::2], spans[1::2], strict=True):
            out.append(text[end : at[a][0]])
            end = at[b - 1][1]
        return b"".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            texts = [
                cut(t, s) if s else t
                for t, s in zip(binary_values(batch.column(text_col)), batch.column("hit_spans").to_pylist(), strict=True)
            ]
            arrays = [
                pa.array([None if t is None else t.decode() for t in texts], batch.schema.field(c).type) if c == text_col else batch.column(c)
                for c in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return scanned.mapInArrow(run, scanned.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """Input columns of the documents left: contaminated ones dropped, or (``remove="spans"``) their hit words cut out."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is {remove!r}")
    scanned = scan(docs, benchmark, **options)
    left = scanned.where("n_hit = 0") if remove == "documents" else cut_spans(scanned, options.get("text_col", "text"))
    return left.select(*[c for c in left.columns if c not in _OUT.names])
