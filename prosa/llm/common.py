"""What several operators share: words, stored intermediate tables, lower-case ASCII, connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these characters.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Only a local session without ``spark.checkpoint.dir`` gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="prosa-llm-")
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: the loss of an executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shipped(module: str) -> None:
    """Send the functions of this module to executors by value, as these need not have the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


shipped(__name__)


def small_batches(df: DataFrame, most: int = 2000) -> DataFrame:
    """``df``, with Arrow batches of at most ``most`` rows in its session: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= most:  # 0 and less: no limit
        df.sparkSession.conf.set(key, most)
    return df


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and, with glibc, the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def thinned(df: DataFrame, key: Column, wanted: int) -> DataFrame:
    """About half as many again as ``wanted`` rows of ``df``, those with small hashes of ``key``; all if there are fewer.

    A sorted limit makes every task send ``wanted`` rows to the driver. After this they send what is left, whatever
    the number of tasks.
    """
    share = 1.5 * wanted / max(df.count(), 1)
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key, F.lit("thin")), F.lit(1 << 30)) < int(share * (1 << 30)))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Which bytes stand between words, a random number for each byte, and how many bytes are hashed at a time.
IS_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE, PIECE = 0x9E3779B97F4A7C15, 1 << 20
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, up to ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        steps = np.full((2, max(2 * n, 1 << 16)), 1, np.uint64)
        steps[:, 1:] = [[BASE], [pow(BASE, -1, 1 << 64)]]
        _POWERS[:] = np.cumprod(steps, axis=1)
    return _POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 text, and where it starts. No word is looked up: hashes are differences of
    a running polynomial over the bytes, taken in pieces that end between words."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        b = np.frombuffer(b"\n%b\n" % data[at:end], np.uint8)
        gap = IS_GAP[b]
        start, stop = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        up, down = powers(len(b))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[b] * up[:len(b)], dtype=np.uint64)])
        x = (total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append((x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
        starts.append(start + (at - 1))
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps until no edge changes. Every step is a grouped
    minimum, combined before the shuffle, joined back to the edges; Spark can split a hub in that
    join. The number of rounds grows with the logarithm of the number of nodes, and nothing but
    two counts reaches the driver.
    """
    pairs = edges.where("a <> b")
    links = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.array("u", "m"), F.array("v", "m"))).alias("e"))
        links = settle(small.select(F.col("e")[0].alias("u"), F.col("e")[1].alias("v")).where("u <> v").distinct())
        row = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if row[0] == row[2] and tuple(row) == before:
            break
        before = tuple(row)
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
