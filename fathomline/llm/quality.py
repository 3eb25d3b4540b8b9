"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's features are its own and its neighbours'; the chain's transitions
tie adjacent lines. The field is trained on documents with a label, whose lines all take that label. Forward-backward
marginals of "good", weighted by the lines' lengths, make the document's score. A chain is never cut, whatever its
length: a line takes a few numbers of memory. Texts without a line have no chain; their score is the share of good ones
among the labelled documents that have none either, 0 if there are none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrowmap import map_texts
from fathomline.llm.common import written

#: Bounds of the training sample: labelled documents, and bytes in all.
DOCS, BYTES = 2000, 24 << 20
#: Lines whose features are held at once, and from how many lines on a training chain is gone through on its own.
BLOCK, LONG = 4096, 256
#: Emissions are kept within this, so that no ratio overflows.
_MOST = 200.0
_SYMBOLS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_PLAIN = b".,;:'\"-?()"
_ODD = bytes(c for c in _SYMBOLS if c not in _PLAIN)
_DIGITS = b"0123456789"
#: Capitals of the Latin, Greek and Cyrillic alphabets.
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]")
OWN = 12


def lines_of(text: str | None) -> list[str]:
    """The lines that have anything besides white space."""
    return [x for x in (text or "").split("\n") if x.strip()]


def _line(text: str, before: str | None) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n, words = len(raw), text.split()
    k = len(words)
    odd = n - len(raw.translate(None, _ODD))
    plain = n - len(raw.translate(None, _PLAIN))
    digits = n - len(raw.translate(None, _DIGITS))
    upper = len(_UPPER.findall(text))
    return [
        min(1.0, np.log1p(n) / 8),
        odd / n,
        min(1.0, odd / k),
        plain / n,
        digits / n,
        upper / n,
        min(1.0, upper / k / 3),
        min(1.0, n / k / 20),
        len(set(words)) / k,
        float(text.rstrip()[-1] in ".!?\"'"),
        float(text == before),
        float(k < 4),
    ]


def _own(lines: list[str], before: str | None = None) -> np.ndarray:
    return np.array([_line(x, lines[i - 1] if i else before) for i, x in enumerate(lines)])


def features(lines: list[str]) -> np.ndarray:
    """A row for each line: its own features, those of the lines before and after it, and whether there are such."""
    own = _own(lines)
    none = np.zeros((1, OWN))
    ends = np.zeros((len(lines), 3))
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2] = 1
    return np.hstack((own, np.vstack((none, own[:-1])), np.vstack((own[1:], none)), ends))


class Field:
    """Weights of a field with two states (0 bad, 1 good): ``w`` scores good against bad, ``t`` holds the transitions."""

    def __init__(self, w: np.ndarray, t: np.ndarray, mean: np.ndarray, scale: np.ndarray, empty: float = 0.0):
        self.w, self.t, self.mean, self.scale, self.empty = w, t, mean, scale, empty
        v = w / scale
        self.parts = v[: 3 * OWN].reshape(3, OWN).T, v[3 * OWN :], -float(mean @ v)

    def emissions(self, lines: list[str]) -> np.ndarray:
        """Score of good against bad of each line, from blocks of lines."""
        weights, ends, base = self.parts
        got = np.vstack([_own(lines[i : i + BLOCK], lines[i - 1] if i else None) @ weights for i in range(0, len(lines), BLOCK)])
        out = got[:, 0] + base + ends[2]
        out[1:] += got[:-1, 1]
        out[:-1] += got[1:, 2]
        out[0] += ends[0]
        out[-1] += ends[1]
        return out

    def marginals(self, lines: list[str]) -> np.ndarray:
        """P(good) of each line."""
        return _chain(self.emissions(lines), self.t)[0]

    def score(self, text: str | None) -> float:
        lines = lines_of(text)
        if not lines:
            return self.empty
        size = np.array([len(y) for y in lines], float)
        return float(np.clip(self.marginals(lines) @ size / size.sum(), 0.0, 1.0))


def _chain(emit: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each place of one chain, and the expected transitions (2 x 2).

    With two states a message is one number, the ratio of good to bad.
    """
    (t00, t01), (t10, t11) = np.exp(t - t.max()).tolist()
    e = np.exp(np.clip(emit, -_MOST, _MOST))
    odds, n = e.tolist(), len(emit)
    forward, backward = [odds[0]] * n, [1.0] * n
    r = odds[0]
    for i in range(1, n):
        r = forward[i] = odds[i] * (t01 + r * t11) / (t00 + r * t10)
    r = 1.0
    for i in range(n - 2, -1, -1):
        x = odds[i + 1] * r
        r = backward[i] = (t10 + t11 * x) / (t00 + t01 * x)
    f, b = np.array(forward), np.array(backward)
    x = f * b
    good = x / (1 + x)
    y = e[1:] * b[1:]
    pairs = np.stack((np.full(n - 1, t00), t01 * y, f[:-1] * t10, f[:-1] * t11 * y), axis=1)
    return good, (pairs / pairs.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)


def _forward_backward(emit: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains as rows of ``emit`` (score of good against bad), each ``length`` long: P(good), and the expected
    transitions summed over all chains (2 x 2)."""
    n, m = emit.shape
    e = np.stack((np.zeros_like(emit), emit), axis=2)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    step = np.exp(t - t.max())
    f, b = np.empty((n, m, 2)), np.ones((n, m, 2))
    for i in range(m):
        x = e[:, i] if i == 0 else f[:, i - 1] @ step * e[:, i]
        f[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(m - 2, -1, -1):
        x = (e[:, i + 1] * b[:, i + 1]) @ step.T
        x /= x.sum(axis=1, keepdims=True)
        b[:, i] = np.where((i + 1 < length)[:, None], x, 1.0)
    good = f * b
    good = good[:, :, 1] / good.sum(axis=2)
    pair = f[:, :-1, :, None] * step * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    live = np.arange(1, m)[None, :] < length[:, None]
    return good, (pair * live[:, :, None, None]).sum(axis=(0, 1))


def train(documents: list[tuple[str | None, int]], rounds: int = 60, rate: float = 0.1, l2: float = 2e-3) -> Field:
    """A field from (text, label) pairs: maximum conditional likelihood with an L2 penalty, by Adam on whole passes."""
    chains, empties = [], []
    for text, label in documents:
        lines = lines_of(text)
        if lines:
            chains.append((features(lines), label))
        else:
            empties.append(label)
    empty = sum(empties) / len(empties) if empties else 0.0
    width = 3 * OWN + 3
    if not chains:
        return Field(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), empty)
    rows = np.vstack([x for x, _ in chains])
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    chains.sort(key=lambda c: len(c[0]))
    batches = []
    long = next((i for i, c in enumerate(chains) if len(c[0]) > LONG), len(chains))
    for i in [*range(0, long, 64), *range(long, len(chains))]:
        part = chains[i : min(i + 64, long)] if i < long else chains[i : i + 1]
        x = np.zeros((len(part), len(part[-1][0]), width))
        for k, (rows, _) in enumerate(part):
            x[k, : len(rows)] = (rows - mean) / scale
        length, label = np.array([len(r) for r, _ in part]), np.array([y for _, y in part])
        live = (np.arange(x.shape[1])[None, :] < length[:, None]).astype(float)
        seen = np.zeros((2, 2))
        for y, k in zip(label, length):
            seen[y, y] += k - 1
        batches.append((x, length, live, label[:, None] * live, seen))
    total, w, t = sum(b[1].sum() for b in batches), np.zeros(width), np.zeros((2, 2))
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        gw, gt = np.zeros(width), np.zeros((2, 2))
        for x, length, live, truth, seen in batches:
            if len(x) > 1 or length[0] <= LONG:
                good, pairs = _forward_backward(x @ w, length, t)
            else:
                good, pairs = _chain(x[0] @ w, t)
                good = good[None, :]
            gw += np.einsum("ij,ijk->k", (truth - good) * live, x)
            gt += seen - pairs
        g = np.concatenate((gw, gt.ravel())) / total - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, t = theta[:width], theta[width:].reshape(2, 2)
    return Field(w, t, mean, scale, empty)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs: int = DOCS, most_bytes: int = BYTES) -> Field:
    """A field from a bounded sample of labelled rows: the ``docs`` ids with the smallest hashes, whole texts,
    at most ``most_bytes`` in all. Null labels and labels other than 0 and 1 are left out."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    # A table and not rows from the driver, which would start Python workers of their own on each executor.
    picks = written(known.orderBy(F.xxhash64("id"), "id").limit(docs), "quality-picks")
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(picks), "id")
    out, size = [], 0
    # written first, so that going through them on the driver starts no second scan
    for r in written(texts, "quality-sample").orderBy(F.xxhash64("id"), "id").toLocalIterator():
        size += len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if size > most_bytes and out:
            break
        out.append((r["text"], r["label"]))
    return train(out)


def scores(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``) for each row of ``df``.

    Texts are scored whole, whatever their length. A null or empty text, or one of white space alone, gets the share of
    good ones among such labelled texts, 0 if none has a label.
    Repeated rows give repeated rows; ids may be null.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch):
        got = [field.score(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["id", "score"])

    out = map_texts(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` whose score reaches ``threshold``, with all their columns."""
    names, at = df.columns, df.columns.index(text_col)

    def run(batch):
        keep = pa.array([field.score(t) >= threshold for t in batch.column(at).to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema).filter(keep)

    return map_texts(df, run, df.schema, text=names.index(text_col))
