"""SentencePiece (BPE) encoding by a prefix table, and decoding.

For each prefix of a segment the table stores the one last token of its encoding: the token that ends there (an
automaton over the pieces finds all that do) and is compatible with the last token of the prefix before it. Two tokens
are compatible when encoding their joined text gives just these two. The ids are then recovered backwards from the end.

Texts are cut where no piece can lie across: in front of a space mark that follows something else, and around
characters that no piece has. Encodings of segments are kept in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.arrowmap import map_texts
from fathomline.llm.common import located

_MARK = "▁"


class Pieces:
    """The encoder and decoder of a SentencePiece BPE model with byte fallback and without text normalisation."""

    def __init__(self, model: str, cached: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and identity normalisation is asked for")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.ids, self.score, self.bytes, self.end = {}, {}, {}, None
        self.spell: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.spell.append(p.piece.replace(_MARK, " ").encode())
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.spell.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.UNKNOWN:
                self.spell.append(" ⁇ ".encode())
            elif p.type == kinds.CONTROL:
                self.spell.append(b"")
                if p.piece == "</s>":
                    self.end = i
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        self.text = {i: p for p, i in self.ids.items()}
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        if any(_MARK in p.lstrip(_MARK) for p in self.ids):
            raise ValueError("a piece goes on over a space")
        self.chars = {c for p in self.ids for c in p}
        self.automaton = ahocorasick.Automaton()
        # Only pieces that the merges reach can stand in an encoding.
        for p, i in self.ids.items():
            if self.merge(p) == [i]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Two generations: what is used again moves to the younger one, the older one is dropped when that is full.
        self.cached, self.cache, self.older = cached // 2, {}, {}
        self.cut = re.compile(f"{_MARK}+[^{_MARK}\n]*|[^{_MARK}\n]+|\n")

    def merge(self, text: str) -> list[int]:
        """The encoding by its definition: join the adjacent pair with the best score, the leftmost of equals."""
        parts, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], right[i] = joined, "", right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        out: list[int] = []
        for p in parts:
            if p:
                out.extend([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])
        return out

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            self.pairs[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return self.pairs[key]

    def segment(self, text: str) -> list[int]:
        """The ids of one segment by the prefix table."""
        n = len(text)
        if not self.chars.issuperset(text):
            out: list[int] = []
            start = 0
            for k, c in enumerate(text):
                if c not in self.chars:
                    out += self.segment(text[start:k]) if k > start else []
                    out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                    start = k + 1
            return out + (self.segment(text[start:]) if start < n else [])
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        pairs = self.pairs
        for end, token in self.automaton.iter(text):
            if last[end + 1] is None:
                j = end + 1 - token[0]
                if j == 0:
                    last[end + 1] = token
                elif (before := last[j]) is not None:
                    ok = pairs.get(before[1] << 32 | token[1])
                    if self.compatible(before[1], token[1]) if ok is None else ok:
                        last[end + 1] = token
        out = []
        while n:
            size, token = last[n]
            out.append(token)
            n -= size
        return out[::-1]

    def known(self, s: str) -> bytes:
        """The ids of a segment that isn't in the younger generation of the cache."""
        ids = self.older.get(s)
        if ids is None:
            cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in self.joins]
            if cuts:
                # No piece has these two characters side by side, so no merge goes over the place between them.
                cache, parts = self.cache, (s[i:j] for i, j in zip([0, *cuts], [*cuts, len(s)]))
                ids = b"".join([cache.get(p) or self.known(p) for p in parts])
            else:
                ids = array("i", self.segment(s)).tobytes()
        if len(s) <= 64:
            if len(self.cache) >= self.cached:
                self.older, self.cache = self.cache, {}
            self.cache[s] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers, without an end id."""
        if not text:
            return b""
        text = (_MARK if self.dummy_prefix else "") + text.replace(" ", _MARK)
        known = self.known
        out = []
        for s in self.cut.findall(text):
            out.append(self.cache.get(s) or known(s))
        return b"".join(out)

    def encode(self, text: str | None, end: bool = False) -> list[int]:
        ids = np.frombuffer(self.encode_bytes(text or ""), "<i4").tolist()
        return [*ids, self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces joined, bytes put together, control ids left out, one leading space dropped."""
        out = b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.spell[i]), None)
        return out[1:] if self.dummy_prefix and first is not None and out.startswith(" ") and first in self.text else out


_LOADED: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One encoder for each model and Python process."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(located(model))
    return _LOADED[model]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, decoded: bool = False) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for each row of ``df``, exactly as the sentencepiece library encodes its
    text, then an end id if ``end``; with ``decoded`` also the text that the ids decode to.

    A null text counts as empty and has the end id alone. Texts are encoded whole. Repeated rows give repeated rows.
    ``model`` is the file's path, which must be readable on every executor, or the name of a public tokenizer.
    """

    def run(batch):
        p = pieces(model)
        tail = np.array([p.end] if end else [], "<i4").tobytes()
        got = [p.encode_bytes(t or "") + tail for t in batch.column(1).to_pylist()]
        flat = np.frombuffer(b"".join(got), "<i4")
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in got]))).astype(np.int32)
        out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        if decoded:
            out.append(pa.array([p.decode(np.frombuffer(x, "<i4").tolist()) for x in got], pa.string()))
        yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    kind = df.schema[id_col].dataType.simpleString()
    out = map_texts(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` for each row's array of ids; null ids give null."""

    def run(batch):
        p = pieces(model)
        got = [None if x is None else p.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df.select(df[id_col].alias("id"), df[ids_col].alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)
