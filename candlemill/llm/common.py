"""What the text operators share: table access, scratch folders, word rules, global ranks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: A word: digits, a-z (after lower-casing A-Z) and everything that is not ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Masters whose executors share the driver's folders.
LOCAL = re.compile(r"local(\[.*\])?")
#: Rows that one Arrow batch carries at most; whole texts can be long.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Sets a checkpoint folder in local mode where the session names none (elsewhere that is an error), and keeps Arrow batches small."""
    sc = spark.sparkContext
    # Python workers find this package where the driver found it, if their own path lacks it
    root = str(Path(__file__).resolve().parents[2])
    if root not in sc.environment.get("PYTHONPATH", "").split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, sc.environment.get("PYTHONPATH", "")]))
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not LOCAL.fullmatch(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="candlemill-"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def picked(df: DataFrame, **wanted: str) -> DataFrame:
    """Some columns under names of the operator's own. Columns are found by place, so names with dots, and names that
    differ from others in letter case alone, are no trouble."""
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{names.index(name)}").alias(own) for own, name in wanted.items()])


def aside(df: DataFrame, text: str, results: tuple[str, ...] = (), keep_text: bool = False, **wanted: str) -> tuple[DataFrame, list[Column]]:
    """The table with numbered names and its text as ``_text``, and the columns that give the other names back.

    ``wanted`` columns are also there under names of the operator's own. Columns that have the name of a result,
    letter case aside, are left out: the result replaces them.
    """
    names = df.columns
    gone = {x.lower() for x in results}
    kept = [i for i, n in enumerate(names) if n.lower() not in gone and (keep_text or n != text)]
    flat = df.toDF(*[f"_aside_{i}" for i in range(len(names))])
    own = {"_text": text, **wanted}
    inner = flat.select(*[f"_aside_{i}" for i in kept], *[F.col(f"_aside_{names.index(n)}").alias(c) for c, n in own.items()])
    return inner, [F.col(f"_aside_{i}").alias(names[i]) for i in kept]


def carried(inner: DataFrame, *without: str) -> list[str]:
    """Names of the columns that a Python stage passes on as they are."""
    return [c for c in inner.columns if c not in without]


def schema_with(inner: DataFrame, names: list[str], more: str) -> StructType:
    """Schema of some columns as they are, and of new ones."""
    return StructType([inner.schema[c] for c in names] + StructType.fromDDL(more).fields)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows, written as a table beside the checkpoints and read from there.

    Loops and branches start from such tables rather than from checkpoint(): a checkpointed plan keeps its estimated
    size, which is the product of the sizes of what was joined, so over the rounds of a loop the number itself grows
    until the optimiser does nothing but multiply. A table has its true size.
    """
    spark = df.sparkSession
    path = scratch(spark, "table") if folder is None else f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Number of partitions for a shuffle that an operator sizes itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_rank(df: DataFrame, keys: list, name: str = "rank") -> DataFrame:
    """Adds the row's place (from 0) in the order of ``keys``, without ever gathering rows in one task.

    Rows are range-partitioned on all keys and sorted; the sorted narrow rows are checkpointed so that
    later jobs see the same partitions, and each partition's row count (one row for each partition)
    is turned into its offset. The keys should make rows distinct where the order of ties matters.
    """
    n = parallelism(df.sparkSession)
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_mid", 33)
    # the window is over one row for each partition
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_offset", "_mid")
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of every k consecutive values, by doubling: O(n log k) vector steps."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    mask = (1 << 64) - 1
    power, width = values.astype(np.uint64), 1  # hashes of `width` values at each place
    out, done = None, 0
    step = base
    while True:
        if k & width:
            if out is None:
                out = power.copy()
            else:
                m = min(len(out), len(power) - done)
                out = out[:m] * np.uint64(step) + power[done : done + m]
            done += width
        if done == k:
            return mix64(out[: n - k + 1])
        m = len(power) - width
        power = power[:m] * np.uint64(step) + power[width:]
        width *= 2
        step = step * step & mask


def window_min_positions(hashes: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: the places, ascending and distinct, that hold the minimum of some window of w hashes,
    the rightmost at ties; one window if there are fewer than w hashes."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    best, at, width = hashes.copy(), np.arange(n, dtype=np.int32 if n < 2**31 else np.int64), 1
    out = out_at = None
    done = 0

    def smaller(a, a_at, b, b_at):
        right = b <= a
        return np.where(right, b, a), np.where(right, b_at, a_at)

    while True:
        if w & width:
            if out is None:
                out, out_at = best, at
            else:
                m = min(len(out), len(best) - done)
                out, out_at = smaller(out[:m], out_at[:m], best[done : done + m], at[done : done + m])
            done += width
        if done == w:
            out_at = out_at[: n - w + 1]
            break
        m = len(best) - width
        best, at = smaller(best[:m], at[:m], best[width:], at[width:])
        width *= 2
    keep = np.ones(len(out_at), bool)
    keep[1:] = out_at[1:] != out_at[:-1]
    return out_at[keep].astype(np.int64)
