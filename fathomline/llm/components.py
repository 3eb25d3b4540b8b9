"""Connected components by alternating large-star and small-star steps, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import fresh_path, removed, written

#: Links from which a node is a hub, and hubs that may be broadcast, at 16 bytes each.
HUB, HUBS = 64, 200_000
#: Pieces that every node's links are dealt to where there are more hubs.
SALTS = 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included).

    The links of a hub meet its minimum where they are, without a shuffle, or in several tasks.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = written(least, "components-least")
    up, hubs = both.where("b > a"), least.where(F.col("n") > HUB)
    count = hubs.count()
    if count > HUBS:
        pieces = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = up.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least.withColumn("s", pieces), ["a", "s"])
    elif count:
        known = up.join(F.broadcast(hubs.select("a", F.col("m").alias("hub"))), "a", "left")
        rest = known.where("hub IS NULL").join(least.where(F.col("n") <= HUB), "a").select("a", "b", "m")
        met = rest.union(known.where("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m")))
    else:
        met = up.join(least, "a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    inner = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long) that isn't its component's smallest.

    ``component`` is the smallest node reachable. Loops (a = b) and repeated edges are allowed; no edges give an empty
    table. Nodes mustn't be null. The minimum of a node's neighbours is taken with partial aggregation before the
    shuffle, and a hub's links aren't shuffled by the hub, so a node with very many links doesn't gather in one task. Rounds grow with the logarithm of the longest
    path; each writes its edges to the shared folder, and the one before it is deleted.
    """
    spark = edges.sparkSession
    schema = "a long, b long"

    def put(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = fresh_path(spark, "components")
        df.select("a", "b").where("a <> b").distinct().write.parquet(path)
        out = spark.read.schema(schema).parquet(path)
        return out, path, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, at, sign = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(most_rounds):
        if not sign[0]:
            break
        new, there, new_sign = put(_small_star(_large_star(now)))
        removed(spark, at)
        done, now, at, sign = new_sign == sign, new, there, new_sign
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
