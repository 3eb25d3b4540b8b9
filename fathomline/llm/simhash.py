"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint of 64 bits has two segments of 32. Two fingerprints that differ in at most 3 bits differ in at most one
bit of one of the segments. So the table holds each fingerprint under both segment values, a search enumerates the
Hamming ball of radius 1 around each of its segment values, and matches are verified on all 64 bits.

Documents with one fingerprint are one entry of the table. A segment value under which very many different
fingerprints lie (a large family of near copies) isn't searched pair by pair: fingerprints within two bits are linked
first through the values one bit away from both (of which each has 65), and then only fingerprints outside the
bucket's largest linked class search the bucket, and those outside their own large bucket's. This finds the same
components: links inside that class add nothing.

Sets of a given Jaccard similarity differ in far more than 3 of 64 bits. For these a fingerprint has 1024 bits, over the set of
shingles, and 42 segments of 24: the table holds each set under every segment's value, and matches are verified on the
sets (``jaccard``). Fingerprints that differ in at most 41 bits share a segment for certain, others by chance: with the
similarity of 0.8 at the least (about 155 bits) 0.56 of the pairs, 0.79 at 0.85, 0.96 at 0.9, by calculation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm import jaccard
from fathomline.llm.arrowmap import map_texts
from fathomline.llm.common import written
from fathomline.llm.components import components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Shingles hashed at once, to bound the memory that a very long text takes.
_AT_ONCE = 200_000
_LAST = 2**63 - 1
#: Words of 64 bits of a set's fingerprint, bytes of its segments, and hashes taken at once.
WORDS, SEGMENT, HASHES = 16, 3, 16 * 255
#: Ids that may be broadcast, at 8 bytes each.
GONE = 500_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint: bit i is 1 if it is set in over half the hashes of the text's shingles.

    A to Z are lower-cased, words are what ASCII white space separates, shingles are ``width`` words joined by a space,
    repeats included; fewer words make one shingle, none (or null) give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _AT_ONCE):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE])], np.uint64)
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > n, axis=1, bitorder="little").reshape(-1).view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of 64-bit hashes, as bytes: a bit is 1 if it is set in over half the hashes' extensions to
    ``WORDS`` words (outputs of splitmix64 from the hash on)."""
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), HASHES):
        x = hashes[i : i + HASHES].view(np.uint64)[:, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        # Eight counters of a byte are added at once, which holds for 255 hashes.
        lanes = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1).view(np.uint64)
        counts += np.add.reduceat(lanes, np.arange(0, len(x), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes))


def cells(hashes: np.ndarray) -> np.ndarray:
    """The values of the segments of the set's fingerprint."""
    octets = set_fingerprint(hashes)
    octets = octets[: len(octets) // SEGMENT * SEGMENT].reshape(-1, SEGMENT).astype(np.int32)
    return octets @ (1 << 8 * np.arange(SEGMENT, dtype=np.int32))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for each row of ``df``; ``fp`` as a signed long."""

    def run(batch):
        got = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["id", "fp"])

    return map_texts(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")), run, "id long, fp long")


def _segment(fp: Column, s: Column) -> Column:
    return F.shiftrightunsigned(F.when(s == 0, fp).otherwise(F.shiftleft(fp, 32)), 32)


def _bits(n: int) -> Column:
    """The longs with one of the lowest ``n`` bits set, as one constant."""
    return F.split(F.lit(",".join(str(1 << i if i < 63 else -(1 << 63)) for i in range(n))), ",").cast("array<bigint>")


def _near(distance: int) -> Column:
    return (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)


def links(distinct: DataFrame, full_bucket: int = 256) -> DataFrame:
    """Links (a, b) between ``node`` values of ``distinct`` (node long, fp long; a row for each fingerprint) that give the
    components of "differ in at most 3 bits".

    Buckets of at most ``full_bucket`` fingerprints are compared in full; larger ones as the module says.
    """
    entries = distinct.withColumn("seg", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("val", _segment(F.col("fp"), F.col("seg")))
    sizes = written(entries.groupBy("seg", "val").count().where(F.col("count") > full_bucket), "mih-large")
    has_large = bool(sizes.take(1))
    flips = F.transform(_bits(32), lambda m: F.col("val").bitwiseXOR(m))
    # Where all buckets are small, each pair one bit apart is met from the side whose bit is 0.
    probes = entries.select(F.col("node").alias("other_node"), F.col("fp").alias("other"), "seg", "val", F.explode(F.array_append(flips if has_large else F.filter(flips, lambda x: x > F.col("val")), F.col("val"))).alias("at"))
    probe = probes.select("other_node", "other", "seg", F.col("val").alias("own"), F.col("at").alias("val"))
    near = _near(3) & ((F.col("val") != F.col("own")) | (F.col("fp") < F.col("other")))
    small = entries.join(sizes, ["seg", "val"], "left_anti") if has_large else entries
    out = probe.join(small, ["seg", "val"]).where(near).select(F.col("other_node").alias("a"), F.col("node").alias("b"))
    return out.union(_crowded(distinct, entries, probe, sizes)) if has_large else out


def _crowded(distinct: DataFrame, entries: DataFrame, probe: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links that the large buckets give."""
    large = sizes.select("seg", "val")
    inside = written(entries.join(large, ["seg", "val"]), "mih-members")
    seekers = probe.join(large, ["seg", "val"]).select("other_node", "other", "seg", "own", "val")
    seekers = written(seekers, "mih-seekers")
    crowd = seekers.select(F.col("other_node").alias("node"), F.col("other").alias("fp")).distinct()
    ball = F.array_append(F.transform(_bits(64), lambda m: F.col("fp").bitwiseXOR(m)), F.col("fp"))
    # At most 65 fingerprints share a value one bit away, so these groups are bounded.
    around = crowd.select("node", F.explode(ball).alias("value")).groupBy("value").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    stars = around.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct()
    stars = written(stars, "mih-stars")
    classes = components(stars)
    classed = crowd.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("class"))
    classed = written(classed, "mih-classes")
    counts = inside.join(classed, "node").groupBy("seg", "val", "class").count()
    largest = counts.groupBy("seg", "val").agg(F.max_by("class", F.struct("count", "class")).alias("largest"))
    outside = seekers.join(classed, seekers["other_node"] == classed["node"]).drop("node").join(largest, ["seg", "val"])
    # Whoever skips a neighbouring large bucket must be of its own bucket's largest class too: else two that are one bit
    # apart here could each skip the other's bucket.
    at_home = largest.select("seg", F.col("val").alias("own"), F.col("largest").alias("own_largest"))
    outside = outside.join(at_home, ["seg", "own"], "left").where("class <> largest OR class <> own_largest").select("other_node", "other", "seg", "val")
    pairs = outside.join(inside, ["seg", "val"]).where(_near(3)).select(F.col("other_node").alias("a"), F.col("node").alias("b"))
    return stars.union(pairs)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Each row of ``df`` with its fingerprint and component: ``id_col``, ``fingerprint`` (16 lowercase hex digits),
    ``component_id`` (the smallest id reachable over links of at most 3 bits, its own included).

    Null and empty texts have fingerprint zero and are linked like others. A null id counts as larger than any other
    and comes back as null. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    fps = written(fingerprints(df, id_col, text_col, width), "simhash")
    entries = fps.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(_LAST))).alias("node"))
    entries = written(entries, "simhash-distinct")
    found = components(links(entries))
    classes = entries.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("least"))
    return fps.join(classes, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("least") != _LAST, F.col("least")).alias("component_id"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest id.

    Links are fingerprints of at most 3 differing bits; with ``similarity`` they are sets of ``width``-word shingles of
    that Jaccard similarity or more, found by the segments of the sets' fingerprints and verified. As no table finds all of
    those, ``jaccard.near_duplicates`` adds the links that segments miss. Rows that share an id stay or go together, and stay if
    any of them is its component's smallest. Rows with a null id can't be told apart and stay. Texts that are null or empty
    are copies of one another. The ids that go are written and counted: up to GONE of them are broadcast, beyond that the
    texts are shuffled once to meet them.
    """
    got = near_duplicates(df, id_col, text_col, width) if similarity is None else jaccard.near_duplicates(df, id_col, text_col, width, similarity, cells)
    goes = got.groupBy(F.col(id_col).alias("__goes")).agg(F.max(F.col(id_col) == F.col("component_id")).alias("least")).where("__goes IS NOT NULL AND NOT least").select("__goes")
    goes = written(goes, "near-gone")
    goes = F.broadcast(goes) if goes.count() <= GONE else goes
    return df.join(goes, df[id_col].cast("long") == goes["__goes"], "left_anti")
