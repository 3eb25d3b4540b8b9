"""Sharding by histogram sort.

The rows are ordered by (hash of the text, id). The bytes below candidate boundaries are counted exactly over all
partitions, round after round; each round puts new candidates only into the gaps that still hold a wanted boundary,
until every boundary is within the tolerance of its target. Then rows are exchanged once.

Rows with equal texts are neighbours in this order. A boundary falls between two texts where the tolerance allows it
and goes through a group of copies, by id, only where that group is larger than the tolerance.
Only DataFrame functions are used. Between the driver and the executors go counts for candidates alone:
``probes`` for each gap with an open boundary. The finer pieces in which a shard's rows are numbered are PIECES at most,
and one candidate is aimed at each of their boundaries.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import fresh_path, rank_among, shuffle_partitions

LEAST = -(2**63)
#: Pieces in which rows are numbered, at most; a boundary is two longs.
PIECES = 20_000


@dataclass
class Gap:
    """A stretch of the order between two counted boundaries: its first and last row, bytes below it, bytes and rows in it."""

    first: tuple[int, int]
    last: tuple[int, int]
    below: int
    size: int
    rows: int


def _between(gap: Gap, probes: int) -> list[tuple[int, int]]:
    """Candidates at both ends of a gap and inside it: by the hash while it holds several, then by the id."""
    (h0, i0), (h1, i1) = gap.first, gap.last
    inside = [(h0 + (h1 - h0) * k // probes, LEAST) for k in range(1, probes + 1)] if h0 != h1 else [(h0, i0 + (i1 - i0) * k // probes) for k in range(1, probes + 1)]
    return sorted({gap.first, (h1, min(i1 + 1, 2**63 - 1)), *(x for x in inside if x > gap.first)})


def _aimed(gap: Gap, target: float) -> tuple[int, int]:
    """Where a target would lie if a gap's bytes were spread evenly: by the hash while it holds several, then by the id."""
    (h0, i0), (h1, i1) = gap.first, gap.last
    part = int(max(1, min((1 << 20) - 1, (target - gap.below) / gap.size * (1 << 20))))
    return (h0 + max(1, (h1 - h0) * part >> 20), LEAST) if h0 != h1 else (h0, i0 + max(1, (i1 - i0) * part >> 20))


def histogram_splitters(keys: DataFrame, parts: int, tolerance: float, probes: int = 48, aimed: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """Boundaries (h, id) cutting ``keys`` (h, id, size) into ``parts`` of nearly equal bytes, and the target each serves.

    A boundary is accepted when the exact bytes below it are within ``tolerance`` times a part's share of its target,
    or when the row that spans the target can't be divided; the nearer side of that row is taken then. With ``aimed``
    each open boundary has one candidate, its gap's ends and middle, and not ``probes`` a gap.
    """
    stats = [F.sum("size"), F.count(F.lit(1)), F.min(F.struct("h", "id")), F.max(F.struct("h", "id"))]
    total, n, lo, hi = keys.agg(*stats).first()
    if not n or parts < 2:
        return [], []
    share = total / parts
    gaps, chosen = {j: Gap(tuple(lo), tuple(hi), 0, total, n) for j in range(1, parts)}, {}
    while gaps:
        if aimed:
            tries = sorted({p for j, g in gaps.items() for p in (*_between(g, 2), _aimed(g, j * share))})
        else:
            tries = sorted({p for g in gaps.values() for p in _between(g, probes)})
        counted = {r[0]: Gap(tuple(r[3]), tuple(r[4]), 0, r[1], r[2]) for r in keys.groupBy(rank_among(tries, (F.col("h"), F.col("id")), ("long", "long")).alias("bin")).agg(*stats).collect()}
        below, bins = 0, []
        for b in sorted(counted):
            g = counted[b]
            g.below, below = below, below + g.size
            bins.append(g)
        still, ends_at = {}, [g.below + g.size for g in bins]
        for j in gaps:
            target = j * share
            k = bisect_left(ends_at, target)
            g = bins[k]
            ends = [(abs(g.below - target), g.first), (abs(g.below + g.size - target), bins[k + 1].first if k + 1 < len(bins) else None)]
            miss, at = min(ends, key=lambda e: e[0])
            if miss <= tolerance * share or g.first == g.last:
                chosen[j] = at
            else:
                still[j] = g
        gaps = still
    order = [j for j in sorted(chosen) if chosen[j] is not None]
    return [chosen[j] for j in order], order


def shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    count: int = 40,
    tolerance: float = 0.01,
    overhead: int = 16,
    rows_per_task: int = 250_000,
    carry: bool = False,
) -> DataFrame:
    """Each row of ``df`` with its shard (0 to ``count`` - 1) and its slot there (gapless from 0).

    Returns ``id_col``, ``size`` (UTF-8 bytes of the text plus ``overhead``; a null text has none), ``text_crc32``
    (unsigned, of the UTF-8 text; of the empty text where it is null), ``shard``, ``slot``, and with ``carry`` every
    column of ``df`` in one struct ``row``.

    The bytes of a shard differ from the mean by the tolerance on either side, and by at most one row more, as rows
    aren't divided. A table with fewer rows than shards leaves some shards empty; an empty table gives none. Null ids
    come first. Repeated rows share a key and lie next to each other. A task numbers
    about ``rows_per_task`` rows, more of them once the pieces are PIECES.
    """
    spark = df.sparkSession
    text = F.coalesce(df[text_col], F.lit(""))
    path = fresh_path(spark, "histogram-sort")
    wide = df.select(
        df[id_col].alias("out_id"),
        F.coalesce(df[id_col].cast("long"), F.lit(LEAST)).alias("id"),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *([F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else []),
    )
    wide.write.parquet(path)
    rows = spark.read.schema(wide.schema).parquet(path)
    keys = rows.select("h", "id", "size")
    cuts, order = histogram_splitters(keys, count, tolerance)
    # Finer pieces only bound a task's work, so a loose tolerance does for them.
    n = keys.count()
    pieces = max(1, min(PIECES // count, max(-(-n // (count * rows_per_task)), -(-shuffle_partitions(spark) // count))))
    fine, _ = histogram_splitters(keys, count * pieces, 0.5, aimed=True) if n and pieces > 1 else ([], [])
    every = sorted(set(cuts) | set(fine))
    shard = rank_among(cuts, (F.col("h"), F.col("id")), ("long", "long"))
    piece = rank_among(every, (F.col("h"), F.col("id")), ("long", "long"))
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn("piece", piece)
    sizes = dealt.groupBy("shard", "piece").count().collect()  # a row for each piece
    start, seen = {}, {}
    for r in sorted(sizes):
        start[r["piece"]] = seen.get(r["shard"], 0)
        seen[r["shard"]] = start[r["piece"]] + r["count"]
    starts = F.split(F.lit(",".join(str(start.get(p, 0)) for p in range(len(every) + 1))), ",").cast("array<bigint>")
    dealt = dealt.repartitionById(len(every) + 1, F.col("piece"))
    place = F.row_number().over(Window.partitionBy("piece").orderBy("h", "id", "text_crc32")) - 1
    return dealt.select(
        F.col("out_id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.get(starts, F.col("piece")) + place).alias("slot"),
        *(["row"] if carry else []),
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The rows of ``df`` with all their columns as one folder for each shard, in slot order inside a file."""
    out = shards(df, carry=True, **options)
    out.select("shard", "slot", "row.*").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
