"""Edit-aware token counts with a segment tree over pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum over
its pre-tokens. Each document keeps a segment tree: leaves hold runs of ``LEAF`` pre-tokens
(their lengths in characters and token counts), inner nodes the sums of characters and
tokens below. An edit descends to the leaf of its place, splits anew from ``CONTEXT``
pre-tokens before it until a boundary after it falls on an old one, re-encodes only those
pre-tokens, and updates the sums on the paths from the touched leaves to the root.

The pre-token pattern looks back at nothing and ahead by at most two characters, so pre-tokens
that end ``CONTEXT`` pre-tokens before an edit can't change, and from a common boundary on
the splits agree. The count of a pre-token comes from the vocabulary's merge ranks, kept in
a bounded table in each task.

The vocabulary file's path is a parameter; the file is read on the driver and sent along.

Defined results: null text counts like empty text, 0 tokens; edits are given in characters
of the text before any of them, don't overlap and apply together; empty edits change
nothing; repeated documents are counted one by one; columns named like outputs are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorlake.deploy import ship
from mirrorlake.llm.common import without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the byte-level vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CONTEXT = 4
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 1 << 19
_SPLIT = regex.compile(PATTERN)


class Counter(dict):
    """Token count of a pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encoded = 0

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        self.encoded += 1
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n
        return n


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _sums(leaf: np.ndarray) -> list[np.ndarray]:
    levels = [leaf]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(np.add.reduceat(x, np.arange(0, len(x), 2)))
    return levels


class TokenTree:
    """Segment tree of one text. ``levels[0]`` are the leaves; columns are characters and tokens."""

    def __init__(self, text: str, counter: Counter):
        pieces = _SPLIT.findall(text)
        self.text, self.counter = text, counter
        lengths, counts = list(map(len, pieces)), list(map(counter.__getitem__, pieces))
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, max(1, len(pieces)), LEAF)]
        starts = np.arange(0, max(1, len(pieces)), LEAF)
        both = np.array([lengths, counts], np.int64).T.reshape(-1, 2) if pieces else np.zeros((1, 2), np.int64)
        self.levels = _sums(np.add.reduceat(both, starts))
        self.reencoded = 0

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    @property
    def n_pieces(self) -> int:
        return sum(len(a) for a, _ in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds character ``place`` (the last leaf for the end), and where it starts."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(level) and place >= start + level[node, 0]:
                start += int(level[node, 0])
                node += 1
        return node, start

    def _update(self, leaf: int) -> None:
        lengths, counts = self.leaves[leaf]
        self.levels[0][leaf] = sum(lengths), sum(counts)
        for k in range(1, len(self.levels)):
            leaf //= 2
            self.levels[k][leaf] = self.levels[k - 1][2 * leaf : 2 * leaf + 2].sum(0)

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of characters ``start`` to ``end``."""
        if start == end and not new:
            return
        leaf, at = self._leaf_at(start)
        # the piece that holds `start` or ends there, then CONTEXT pieces back
        i = 0
        lengths = self.leaves[leaf][0]
        while i < len(lengths) and at + lengths[i] <= start:
            at += lengths[i]
            i += 1
        back = CONTEXT
        while back and (i or leaf):
            if not i:
                leaf -= 1
                i = len(self.leaves[leaf][0])
                continue
            i -= 1
            at -= self.leaves[leaf][0][i]
            back -= 1
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # walk old boundaries and new matches until they meet after the edit
        pieces: list[str] = []
        old, last, j = at, leaf, i
        for m in _SPLIT.finditer(text, at):
            pieces.append(m.group())
            stop = m.end() - shift
            while old < stop and (last < len(self.leaves) - 1 or j < len(self.leaves[last][0])):
                if j >= len(self.leaves[last][0]):
                    last, j = last + 1, 0
                    continue
                old += self.leaves[last][0][j]
                j += 1
            if m.end() >= start + len(new) and old == stop and old >= end:
                break
        else:  # to the end of the text
            last, j = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.text = text
        self.reencoded += len(pieces)
        fresh = list(map(len, pieces)), [self.counter[p] for p in pieces]
        head, tail = self.leaves[leaf], self.leaves[last]
        rest = tail[0][j:], tail[1][j:]
        for k in range(leaf, last + 1):
            self.leaves[k] = [], []
        self.leaves[leaf] = head[0][:i] + fresh[0] + (rest[0] if last == leaf else []), head[1][:i] + fresh[1] + (rest[1] if last == leaf else [])
        if last != leaf:
            self.leaves[last] = rest
        if len(self.leaves[leaf][0]) > 8 * LEAF:  # a large insertion: share it out
            self._rebuild()
        else:
            for k in range(leaf, last + 1):
                self._update(k)

    def _rebuild(self) -> None:
        lengths = [x for a, _ in self.leaves for x in a]
        counts = [x for _, b in self.leaves for x in b]
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, max(1, len(lengths)), LEAF)]
        self.levels = _sums(np.array([(sum(a), sum(b)) for a, b in self.leaves], np.int64))

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits in characters of the present text, not overlapping; from the last to the first."""
        for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
            self.edit(start, end, new)

    def to_bytes(self) -> bytes:
        """Lengths and counts of the pre-tokens; with the text, all that ``from_bytes`` needs."""
        return np.array([x for a, b in self.leaves for p in zip(a, b, strict=True) for x in p], "<u4").tobytes()

    @classmethod
    def from_bytes(cls, text: str, data: bytes, counter: Counter) -> TokenTree:
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.reencoded = text, counter, 0
        flat = np.frombuffer(data, "<u4").astype(np.int64).reshape(-1, 2).tolist()
        tree.leaves = [([p[0] for p in flat[i : i + LEAF]], [p[1] for p in flat[i : i + LEAF]]) for i in range(0, max(1, len(flat)), LEAF)]
        tree.levels = _sums(np.array([(sum(a), sum(b)) for a, b in tree.leaves], np.int64))
        return tree


# ---- on DataFrames ---------------------------------------------------------------------

_MAIL = regex.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
_DIGITS = regex.compile(r"\d(?:[ .-]?\d){6,18}")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a mark in the place of e-mail addresses and of runs of 7 to 19 digits."""
    found = [(m.start(), m.end(), "<EMAIL>") for m in _MAIL.finditer(text)] if "@" in text else []
    taken = found.copy()
    for m in _DIGITS.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b, _ in taken):
            found.append((m.start(), m.end(), "<NUMBER>"))
    return found


_COUNTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_pretokens", "n_edits", "n_reencoded", "n_tokens_after")]
)


def count_with_edits(
    docs: DataFrame,
    edits_of: Callable[[str], list[tuple[int, int, str]]] = redactions,
    *,
    vocabulary: str = VOCABULARY,
    keep: list[str] | None = None,
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """``keep`` columns plus counts before and after the edits, and how many pre-tokens the edits encoded again.

    ``with_text`` adds text_after and tree_after (to go on from later, see ``TokenTree.from_bytes``).
    """
    extra = [T.StructField("text_after", T.StringType()), T.StructField("tree_after", T.BinaryType())] if with_text else []
    docs = without(docs, *_COUNTS.names, *[f.name for f in extra])
    keep = docs.columns if keep is None else keep
    ranks = ship(docs.sparkSession).sparkContext.broadcast(load_ranks(vocabulary))  # a vocabulary file's size

    def run(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                tree = TokenTree(text or "", counter)
                before, pieces = tree.n_tokens, tree.n_pieces
                edits = edits_of(text or "")
                tree.apply(edits)
                out.append((before, pieces, len(edits), tree.reencoded, tree.n_tokens, *((tree.text, tree.to_bytes()) if with_text else ())))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]],
                [*keep, *_COUNTS.names, *[f.name for f in extra]],
            )

    carried = docs.select(*dict.fromkeys([*keep, text_col]))
    return carried.mapInArrow(run, T.StructType([carried.schema[c] for c in keep] + _COUNTS.fields + extra))


def recount(trees: DataFrame, edits: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """Apply ``edits`` (id, start, stop, new) to stored trees (id, text_after, tree_after): the same columns, edited, and n_tokens.

    Documents without edits are returned as they are. Ids are unique in ``trees``.
    """
    ranks = ship(trees.sparkSession).sparkContext.broadcast(load_ranks(vocabulary))
    wanted = edits.groupBy(id_col).agg(F.collect_list(F.struct("start", "stop", "new")).alias("edits"))
    both = trees.select(id_col, "text_after", "tree_after").join(wanted, id_col, "left")

    def run(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            out = []
            for text, data, todo in zip(*[batch.column(c).to_pylist() for c in ("text_after", "tree_after", "edits")], strict=True):
                tree = TokenTree.from_bytes(text or "", data, counter)
                tree.apply([(e["start"], e["stop"], e["new"]) for e in todo or []])
                out.append((tree.text, tree.to_bytes(), tree.n_tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))]],
                [id_col, "text_after", "tree_after", "n_tokens"],
            )

    return both.mapInArrow(run, T.StructType([both.schema[id_col], T.StructField("text_after", T.StringType()), T.StructField("tree_after", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))
