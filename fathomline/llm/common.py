"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 1_000

ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words (str or bytes); emptied when it has grown to its bound, and between tasks."""

    made: weakref.WeakValueDictionary[int, WordHashes] = weakref.WeakValueDictionary()

    def __init__(self):
        super().__init__()
        self.made[id(self)] = self

    @classmethod
    def forget(cls) -> None:
        for hashes in list(cls.made.values()):
            hashes.clear()

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word, 7)
        return h


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * ODD + words[k : k + n]
        h ^= h >> np.uint64(29)
    return h * ODD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only a session without that setting whose executor is the
    driver itself (master ``local`` or ``local[...]``) gets a temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="fathomline-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows for the actions inside; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Give heap that executors no longer use back to the system.

    A heap that has grown stays as large until a full collection, while what comes next may need that memory for Python
    workers. An executor that gets none of these short tasks keeps its heap; nothing else depends on it.
    """
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where(F.reflect(F.lit("java.lang.System"), F.lit("gc")).isNotNull()).count()


def removed(spark: SparkSession, path: str) -> None:
    """Delete what an operator wrote in the shared folder, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def located(name: str) -> str:
    """The path of a tokenizer file: a name without a folder is that of a public tokenizer, found where it is used."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_among(splitters: list[tuple], key: tuple[Column, ...], types: tuple[str, ...]) -> Column:
    """How many of the ascending ``splitters`` are at or below ``key``, by binary search inside the JVM.

    The splitters become one constant array for each key column (strings among them hold no comma); a row costs
    log2(len(splitters)) comparisons.
    """
    if not splitters:
        return F.lit(0)
    # One literal for each key column, folded by the optimiser, so that a plan's size doesn't depend on their number.
    parts = [F.split(F.lit(",".join(str(s[i]) for s in splitters)), ",").cast(f"array<{t}>") for i, t in enumerate(types)]

    def at_or_below(m: Column) -> Column:
        cond = F.get(parts[-1], m) <= key[-1]
        for a, k in reversed(list(zip(parts[:-1], key[:-1]))):
            x = F.get(a, m)
            cond = (x < k) | ((x == k) & cond)
        return cond

    steps = max(1, len(splitters).bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = ((acc.lo + acc.hi) / 2).cast("int")
        open_ = acc.lo < acc.hi
        right = at_or_below(mid)
        return F.struct(
            F.when(open_ & right, mid + 1).otherwise(acc.lo).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(acc.hi).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc.lo)
