"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is contained in a document when the document has at least the threshold's share of the item's word
shingles. A long document has thousands of shingles, so its Jaccard similarity to a short item says nothing. Shingles
that no item has don't change any containment; they are left out of the document first. What is left is a small set,
and sets are partitioned by size in powers of two. For each class of item sizes and each partition the containment
threshold becomes the Jaccard similarity that a set of that size must reach, and the number of rows in a MinHash band
is the largest that misses such a set with a probability below one in a million. Where even bands of one row would
miss more often (a document that holds many items), the item's smallest shingles serve as keys: as many as guarantee
that a containing set has one of them. Candidates are verified on the shingles themselves.

Documents are read once and nothing is shuffled. Items go to the executors in blocks of bounded size; each further
block costs another pass over the documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrowmap import map_texts
from fathomline.llm.common import ODD, WordHashes, run_hashes

_WORD = re.compile(r"\w+")
PERMUTATIONS = 64
MISS = 1e-6
#: Bytes of benchmark text that go to the executors at once.
BLOCK_BYTES = 4 << 20


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _signature(h: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima over the set ``h``."""
    odd = np.arange(1, 2 * PERMUTATIONS, 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    out = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * odd
        x ^= x >> np.uint64(32)
        out = np.minimum(out, (x * ODD).min(axis=0))
    return out


def _bands(signature: np.ndarray, rows: int) -> list[tuple]:
    return [(rows, k, signature[k : k + rows].tobytes()) for k in range(0, PERMUTATIONS - rows + 1, rows)]


def rows_in_band(items: int, upper: int, threshold: float) -> int:
    """Rows of a band for items of ``items`` shingles and sets of at most ``upper``; 0: MinHash would miss too many."""
    s = threshold / (upper / items + 1 - threshold)
    return max((r for r in (1, 2, 4, 8) if (1 - min(1.0, s) ** r) ** (PERMUTATIONS // r) <= MISS), default=0)


class Index:
    """Items of one block: their shingles, and the keys under which sets of each size find them."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold, self.shingles, hashes = threshold, [], []
        by_width = defaultdict(set)
        cache = WordHashes()
        for item, text in items:
            w = words(text)
            if not w:
                continue
            k = min(width, len(w))
            own = {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}
            h = np.unique(run_hashes(np.array([cache[x] for x in w], np.uint64), k))
            by_width[k].update(h.tolist())
            self.shingles.append((item, frozenset(own)))
            hashes.append(h)
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in sorted(by_width.items())}
        # A bitmap says quickly that a hash is none of the known ones.
        self.bits = {k: np.zeros(1 << 20, bool) for k in self.known}
        for k, v in self.known.items():
            self.bits[k][v >> np.uint64(44)] = True
        self.signatures = [_signature(h) for h in hashes]
        self.hashes = hashes
        self.tables: dict[int, tuple[dict, set[int]]] = {}

    def table(self, p: int) -> tuple[dict, set[int]]:
        """For sets of 2^p to 2^(p+1) - 1 shingles: items by key, and the kinds of keys in use (0: shingles)."""
        if p not in self.tables:
            found, kinds = defaultdict(list), set()
            for i, (h, signature) in enumerate(zip(self.hashes, self.signatures)):
                need = math.ceil(self.threshold * len(h) - 1e-9)
                if need >= 2 ** (p + 1):
                    continue  # no set of this size has so many
                r = rows_in_band(len(h), 2 ** (p + 1) - 1, self.threshold)
                kinds.add(r)
                for key in _bands(signature, r) if r else h[: len(h) - need + 1].tolist():
                    found[key].append(i)
            self.tables[p] = dict(found), kinds
        return self.tables[p]

    def search(self, text: str | None, cache: WordHashes) -> list[tuple[int, int, int]]:
        """(item, shared shingles, its shingles) of each item that the text contains."""
        if not text or not self.known:
            return []
        w = words(text)
        got = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
        kept, own = [], set()
        for k, known in self.known.items():
            h = run_hashes(got, k)
            at = np.flatnonzero(self.bits[k][h >> np.uint64(44)])
            if len(at):
                x = h[at]
                at = at[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x]
            if len(at):
                kept.append(h[at])
                own.update(" ".join(w[i : i + k]) for i in at.tolist())
        if not kept:
            return []
        left = np.unique(np.concatenate(kept))
        found, kinds = self.table(len(left).bit_length() - 1)
        candidates: set[int] = set()
        signature = _signature(left) if kinds - {0} else None
        for r in kinds:
            for key in _bands(signature, r) if r else left.tolist():
                candidates.update(found.get(key, ()))
        out = []
        for i in sorted(candidates):
            item, shingles = self.shingles[i]
            shared = len(shingles & own)
            if shared >= self.threshold * len(shingles) - 1e-9:
                out.append((item, shared, len(shingles)))
        return out


_LAST: dict[str, tuple[Index, WordHashes]] = {}


def _index(name: str, sent, width: int, threshold: float) -> tuple[Index, WordHashes]:
    """The index of a sent block; a Python process keeps the last one over its tasks."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(sent.value, width, threshold), WordHashes()
    return _LAST[name]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of bounded size, one block at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].encode("utf-8", "surrogatepass")) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The (document, item) pairs with the item contained in the document.

    Returns ``id_col``, ``item_id``, ``n_shared``, ``n_item`` (distinct shingles) and ``containment``. Words are runs of
    letters, digits and underscores in lower case. An item with fewer words than ``width`` is one shingle of all its
    words; one without words, like a null one, is contained nowhere, and a null or empty document contains nothing.
    Repeated documents and repeated items give repeated pairs. Either table may be empty.
    """
    spark = df.sparkSession
    schema = "id long, item_id long, n_shared long, n_item long"
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(block)  # at most block_bytes and one item

        def run(batch, sent=sent, name=uuid.uuid4().hex):
            index, cache = _index(name, sent, width, threshold)
            out = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in index.search(t, cache)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "item_id", "n_shared", "n_item"])

        parts.append(map_texts(rows, run, schema))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    return found.select(F.col("id").alias(id_col), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` that contain no item, with all their columns; each row is judged by its own text.

    Rows are filtered where they are read, block after block, so no text is shuffled.
    """
    at = df.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = df.sparkSession.sparkContext.broadcast(block)  # at most block_bytes and one item

        def run(batch, sent=sent, name=uuid.uuid4().hex):
            index, cache = _index(name, sent, width, threshold)
            clean = pa.array([not index.search(t, cache) for t in batch.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema).filter(clean)

        df = map_texts(df, run, df.schema, text=at)
    return df
