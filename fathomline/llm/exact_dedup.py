"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, an external sort inside each range places equal texts next
to each other, full comparisons of neighbours find the runs, and one row of each run is retained.

The range key is (first bytes, SHA-256, id), so a run of copies of any size is cut across several ranges by its ids
and no task holds it whole. Inside a range rows are sorted by first bytes, SHA-256 and full bytes, the order that the
ranges follow, and neighbours are compared by their full bytes. A run that continues in the next range is put together
from the rows at the edges of the ranges, of which there are two a range.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import rank_among, shuffle_partitions, written

#: Sampled keys for each range. The driver gets this many times the number of ranges, at about 120 bytes each.
SAMPLES_PER_RANGE = 30
HEAD_BYTES = 16


def splitters(keys: DataFrame, ranges: int, per_range: int = SAMPLES_PER_RANGE) -> list[tuple]:
    """``ranges - 1`` boundaries from a sample of ``keys`` (k string, size long), so that ranges hold nearly equal sizes.

    A row is sampled by a hash of its key, with a probability in proportion to its size.
    """
    n, total = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    if n == 0 or ranges < 2:
        return []
    rate = per_range * ranges / total
    share = F.least(F.lit(1.0), F.col("size") * rate)
    drawn = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)
    # A row that is sure to be drawn stands for its whole size, any other for 1 / rate.
    got = sorted((r[0], r[1]) for r in keys.where(drawn).select("k", F.greatest(F.lit(1.0), F.col("size") * rate)).collect())
    whole, before, cut = sum(w for _, w in got), 0.0, set()
    for k, w in got:
        if int(before * ranges / whole) != int((before + w) * ranges / whole):
            cut.add(k)
        before += w
    return [(k,) for k in sorted(cut)]


def content_sort(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    ranges: int | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row for each row of ``df``: which row of its group of equal texts stays.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text in UTF-8), and
    with ``carry`` every column of ``df`` in one struct ``row``.

    ``normalise`` maps the text column before the comparison (default: no change). A null text counts as empty.
    ``keep`` is ``smallest`` or ``largest`` id. A null id loses against any other; where two rows have the same text
    and the same id, exactly one is kept. An empty table gives an empty result. Other columns, whatever their names,
    don't matter. Texts are compared whole, whatever their length.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = df.sparkSession

    def body(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return (normalise(text) if normalise else text).cast("binary")

    rows = df.select(
        df[id_col].alias("id"),
        body(df[text_col]).alias("body"),
        *([F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else []),
    )
    sha = F.sha2("body", 256)
    # "-" sorts before the digits, so that the key's order is that of its parts.
    key = F.concat(F.hex(F.substring("body", 1, HEAD_BYTES)), F.lit("-"), sha, F.lit("-"), F.hex(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ranges = ranges or max(2, shuffle_partitions(spark))
    cut = splitters(rows.select(key.alias("k"), (F.octet_length("body") + 64).cast("long").alias("size")), ranges)
    dealt = rows.withColumn("text_sha256", sha).withColumn("range", rank_among(cut, (key,), ("string",)))
    # A carried row has its text already, so the normalised bytes are made again after the exchange.
    dealt = (dealt.drop("body") if carry else dealt).repartitionById(len(cut) + 1, F.col("range"))
    dealt = dealt.withColumn("body", body(F.col("row")[text_col])) if carry else dealt

    first = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    line = Window.partitionBy("range").orderBy(F.substring("body", 1, HEAD_BYTES), "text_sha256", "body", first)
    before, after = F.lag("body").over(line), F.lead("body").over(line)
    runs = (
        dealt.withColumn("before", before)
        .withColumn("after", after)
        .withColumn("starts", F.when(F.col("before") == F.col("body"), 0).otherwise(1))
        .withColumn("edge", F.when(F.col("before").isNull() | F.col("after").isNull(), F.col("body")))
        .withColumn("run", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("before", "after", "body", "starts")
    )
    run = Window.partitionBy("range", "run")
    best = F.min("id") if keep == "smallest" else F.max("id")
    runs = runs.withColumn("place", F.row_number().over(run.orderBy(first))).withColumn("run_size", F.count(F.lit(1)).over(run)).withColumn("run_best", best.over(run))
    runs = written(runs, "content-sort")

    # Runs at the edges of ranges, two a range at most, with their whole text; those with equal texts are one group.
    ends = runs.where(F.col("edge").isNotNull()).groupBy("range", "run").agg(F.first("edge").alias("edge"), F.first("run_size").alias("n"), F.first("run_best").alias("best"))
    same = Window.partitionBy("edge")
    order = F.col("best").asc_nulls_last() if keep == "smallest" else F.col("best").desc_nulls_last()
    whole = F.min("best") if keep == "smallest" else F.max("best")
    joined = (
        ends.withColumn("all_n", F.sum("n").over(same))
        .withColumn("all_best", whole.over(same))
        .withColumn("wins", F.row_number().over(same.orderBy(order, "range")) == 1)
        .where(F.col("all_n") > F.col("n"))
        .select("range", "run", "all_n", "all_best", "wins")
    )
    # Bounded by two rows a range, whatever the input.
    out = runs.join(F.broadcast(joined), ["range", "run"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("all_best", "run_best").alias("keep_id"),
        F.coalesce("all_n", "run_size").cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.coalesce("wins", F.lit(True))).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def deduplicate(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    return content_sort(df, carry=True, **options).where("kept").select("row.*")
