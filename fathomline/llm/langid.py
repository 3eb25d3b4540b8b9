"""Language identification by prediction by partial matching.

Each language has byte context trees of orders 0 to 4, whose counts are frozen after learning. A symbol costs
-log2(n / (N + D)) bits in its context (n: count of the symbol there, N: of all symbols, D: of different ones); a
symbol not seen there costs the escape -log2(D / (N + D)) and then what it costs one order lower; a context not seen
costs nothing and passes to the order below it; below order 0 each of the 256 bytes is alike. The language with the
shortest code for the whole text wins. Code lengths are exact: they are the sums of these costs over all bytes.

Texts are lower-cased, and each run of ASCII characters other than letters counts as one blank. Where two languages
have equally short codes, the alphabetically first wins.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrowmap import map_texts

ORDER = 4
#: Bounds of the sample that is learnt from: different texts, and bytes, of each language; bytes of each are fewer where
#: there are very many languages, so that bytes times languages squared stay within CELLS.
DOCS_EACH, BYTES_EACH, CELLS = 500, 2 << 20, 1 << 30
#: Bytes that are scored at once.
_AT_ONCE = 1 << 20
_NOT_LETTERS = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def prepared(text: str | None) -> bytes:
    """The bytes whose code length counts; empty if the text has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return _NOT_LETTERS.sub(" ", text.lower()).strip(" ").encode("utf-8", "surrogatepass")


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """For each byte the ``n`` bytes up to it as one integer; ``data`` has ORDER blanks in front."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER - n + 1, ORDER + 1):
        out = out << np.uint64(8) | data[k : k + len(out)]
    return out


def _padded(texts: list[bytes], blanks: int = ORDER) -> np.ndarray:
    return np.frombuffer(b"".join(b" " * blanks + t for t in texts), np.uint8).astype(np.uint64)


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class Hashed:
    """Positions of 64-bit keys by an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, int(4 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, the last stays
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that aren't there."""
        if not len(self.keys):
            return np.full(len(x), -1, np.int32)
        slot = self._slot(x)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != x))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slots[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != x[todo])]
        return out


class Trees:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        n = len(self.languages)
        counts = []
        for lang in self.languages:
            data = _padded(texts[lang])
            keep = np.concatenate([np.arange(ORDER + len(t)) >= ORDER for t in texts[lang]])[ORDER:]
            counts.append([np.unique(_grams(data, k + 1)[keep], return_counts=True) for k in range(ORDER + 1)])
        self.grams, self.cost, self.contexts, self.escape = [], [], [], []
        below = None
        for k in range(ORDER + 1):
            grams = np.unique(np.concatenate([np.empty(0, np.uint64), *(c[k][0] for c in counts)])) if k else np.arange(256, dtype=np.uint64)
            contexts = np.unique(grams >> np.uint64(8))
            cost, escape = np.zeros((len(grams), n)), np.zeros((len(contexts), n))
            lower = np.full((len(grams), n), 8.0) if below is None else self._score(grams & np.uint64((1 << 8 * k) - 1), k - 1)
            for j, c in enumerate(counts):
                seen, times = c[k]
                own, first = np.unique(seen >> np.uint64(8), return_index=True)
                total, different = np.add.reduceat(times, first) if len(first) else times, np.diff(np.append(first, len(seen)))
                at, there = _find(own, contexts)
                escape[there, j] = np.log2((total[at[there]] + different[at[there]]) / different[at[there]])
                at, in_context = _find(own, grams >> np.uint64(8))
                where, found = _find(seen, grams)
                cost[:, j] = lower[:, j]
                gone = in_context & ~found
                cost[gone, j] += np.log2((total[at[gone]] + different[at[gone]]) / different[at[gone]])
                cost[found, j] = np.log2((total[at[found]] + different[at[found]]) / times[where[found]])
            below = cost
            self.grams.append(Hashed(grams))
            self.cost.append(cost)
            self.contexts.append(Hashed(contexts))
            self.escape.append(escape)

    def _score(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each gram after the ``k`` bytes before it, for each language."""
        at = self.grams[k].find(grams)
        out = self.cost[k][at]
        gone = np.flatnonzero(at < 0)
        if len(gone):
            x = grams[gone]
            lower = self._score(x & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(x), len(self.languages)), 8.0)
            at = self.contexts[k].find(x >> np.uint64(8))
            lower[at >= 0] += self.escape[k][at[at >= 0]]
            out[gone] = lower
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each non-empty text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0

        def add() -> None:
            # Each piece has the ORDER bytes before it in front; their own grams are left out.
            grams, at = _grams(_padded([p for _, p in group], 0), ORDER + 1), 0
            for i, p in group:
                out[i] += self._score(grams[at : at + len(p) - ORDER], ORDER).sum(axis=0)
                at += len(p)
            group.clear()

        for i, t in enumerate(texts):
            for a in range(0, len(t), _AT_ONCE):
                group.append((i, t[a - ORDER : a + _AT_ONCE] if a else b" " * ORDER + t[:_AT_ONCE]))
                size += len(group[-1][1])
                if size >= _AT_ONCE:
                    add()
                    size = 0
        if group:
            add()
        return out


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = DOCS_EACH, bytes_each: int = BYTES_EACH, cells: int = CELLS) -> Trees:
    """Trees from a bounded sample of the rows of ``df`` with a language; every language that occurs is learnt.

    Of each language the texts with the smallest hashes are taken, copies once, whole, until ``docs_each`` texts or
    ``bytes_each`` bytes are reached; with n languages ``bytes_each`` is ``cells / n**2`` at most, and 1024 at least.
    The driver gets these texts only. Rows with a null text or language are left out; no rows give trees of no language.
    """
    h = F.shiftrightunsigned(F.xxhash64(df[text_col]), 2)
    rows = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull()).select(df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"), h.alias("h"))
    # The number of different hashes of each length in bits says below which one enough of them lie. Only counts meet
    # by language, 62 of each.
    lengths = rows.select("lang", "h").distinct().groupBy("lang", F.length(F.bin("h")).alias("bits")).count()
    below: dict[str, list] = {}
    for r in sorted(lengths.collect(), key=lambda r: (r["lang"], r["bits"])):
        got = below.setdefault(r["lang"], [0, 0])
        if got[0] < docs_each:
            got[0], got[1] = got[0] + r["count"], r["bits"]
    texts: dict[str, list[bytes]] = {}
    if below:
        bytes_each = max(1024, min(bytes_each, cells // len(below) ** 2))
        bounds = df.sparkSession.createDataFrame([(k, 2 ** v[1]) for k, v in below.items()], "lang string, bound long")
        # Bounded by the number of languages; about twice docs_each texts of each pass it.
        some = rows.join(F.broadcast(bounds), "lang").where("h < bound").groupBy("lang", "h").agg(F.first("text").alias("text"))
        taken: dict[str, int] = {}
        for r in some.orderBy("lang", "h").toLocalIterator():
            got, data = texts.setdefault(r["lang"], []), prepared(r["text"])
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            if data and taken[r["lang"]] <= docs_each and sum(map(len, got)) < bytes_each:
                got.append(data)
    return Trees({k: v for k, v in texts.items() if v})


def predict(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``bits`` (code length of the text under that language) for each row.

    ``score`` is the share of the language among all, each weighted by two to the power of minus its code length.
    A text that is null or has no letter, like any text if nothing was learnt, gets ``und``, score 0 and no bits.
    """
    sent = df.sparkSession.sparkContext.broadcast(trees)  # bounded by cells

    def run(batch):
        trees = sent.value
        data = [prepared(t) for t in batch.column(1).to_pylist()]
        some = [i for i, t in enumerate(data) if t and trees.languages]
        langs, scores, bits = ["und"] * len(data), [0.0] * len(data), [None] * len(data)
        if some:
            length = trees.bits([data[i] for i in some])
            best = length.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(-1000.0, length.min(axis=1)[:, None] - length)).sum(axis=1)
            for i, b, s, x in zip(some, best, share, length.min(axis=1)):
                langs[i], scores[i], bits[i] = trees.languages[b], float(s), float(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), pa.array(bits, pa.float64())], ["id", "lang_pred", "score", "bits"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)
