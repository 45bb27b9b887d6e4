"""Data skipping: which batches of a table may hold some ids, told without reading them.

Beside each batch lie the bounds of its times and a bit filter of its ids. A filter has 32 bits for each id, in blocks of 256
as four longs; an id sets eight bits of one block, so about one absent id in 100,000 finds all of them set. Filters are made,
joined with ids and compared by Spark; what reaches the driver is the list of batches. A batch without a filter, as
after a crash between the two writes, counts as one that may hold every id.
"""

from __future__ import annotations

import json
import os
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from prosa.sources.tables import Tables

BITS, BLOCK, WORDS = 32, 256, 4
BLOCKS = "_blocks"
#: How many ids are looked up before all are: a load of much that is held mostly finds its batches by these.
FIRST = 4096


def folder(path: str) -> str:
    parent, leaf = os.path.split(path)
    return f"{parent}/.{leaf}-index"


def hashes(key: str) -> list[Column]:
    """An id's hash, which chooses the block, and the one its bits come from."""
    return [F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g")]


def bits_of(h: Column) -> list[Column]:
    """The bits that an id sets in the longs of its block."""
    def bit(k: int) -> Column:
        place = F.shiftright(h, 5 * k).bitwiseAND(F.lit(31)) + F.lit(32 * (k % 2))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(WORDS)]


def probe(key: str) -> list[Column]:
    """An id's hash and the bits it sets."""
    return [F.xxhash64(key).alias("h"), *[m.alias(f"m{i}") for i, m in enumerate(bits_of(F.xxhash64(key, F.lit(1))))]]


def describe(rows: DataFrame, path: str, writer: str, number: int, key: str, time: str) -> None:
    """Store filter and bounds of one batch."""
    spark, index = rows.sparkSession, folder(path)
    timed = dict(rows.dtypes)[time] == "timestamp"
    micros = F.unix_micros(time) if timed else F.lit(None).cast("long")
    n, first, last = rows.agg(F.count(F.lit(1)), F.min(micros), F.max(micros)).first()
    blocks = 1 << max(n * BITS // BLOCK, 1).bit_length()
    place = F.pmod("h", F.lit(blocks)).alias("block")
    bits = rows.select(*probe(key)).groupBy(place).agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
    bits.write.mode("overwrite").parquet(f"{index}/filters/_writer={writer}/_batch_id={number}/{BLOCKS}={blocks}")
    files, hadoop = _file(spark, f"{index}/bounds/{writer}-{number}.json")
    out = files.create(hadoop, True)
    out.writeBytes(json.dumps({"writer": writer, "batch": number, "rows": n, "first": first, "last": last}) + "\n")
    out.close()


def _file(spark, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def forget(spark, path: str, writer: str | None = None, number: int | None = None) -> None:
    """Remove what is known of a batch, or of all: before its rows change."""
    index = folder(path)
    gone = [index] if writer is None else [f"{index}/bounds/{writer}-{number}.json", f"{index}/filters/_writer={writer}/_batch_id={number}"]
    for target in gone:
        files, hadoop = _file(spark, target)
        files.delete(hadoop, True)


def bounds(tables: Tables, name: str) -> dict[tuple[str, int], tuple[int | None, int | None]]:
    """First and last time (microseconds) of every described batch that is still there."""
    index = f"{folder(tables.path(name))}/bounds"
    files, hadoop = _file(tables.spark, index)
    if not files.exists(hadoop):
        return {}
    rows = tables.spark.read.schema("writer string, batch long, rows long, first long, last long").json(index).collect()
    there = set(tables.batches(name))
    return {(r["writer"], r["batch"]): (r["first"], r["last"]) for r in rows if (r["writer"], r["batch"]) in there}


def of_batches(rows: DataFrame, batches: list[tuple[str, int]]) -> DataFrame:
    """The rows of these batches, by partition columns: other folders aren't read."""
    by_writer: dict[str, list[int]] = {}
    for writer, number in batches:
        by_writer.setdefault(writer, []).append(number)
    chosen = [(F.col("_writer") == w) & F.col("_batch_id").isin(*ns) for w, ns in sorted(by_writer.items())]
    return rows.where(reduce(lambda a, b: a | b, chosen) if chosen else F.lit(False))


def hits(ids: DataFrame, filters: DataFrame, key: str) -> DataFrame:
    """Writer and number of the batches whose filter has all bits of one of the ids."""
    sizes = [r[0] for r in filters.select(BLOCKS).distinct().collect()]  # powers of two
    probes = ids.select(*hashes(key)).withColumn(BLOCKS, F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("block", F.pmod("h", BLOCKS))
    # Bits are worked out after the join: an id moves as one hash and its block.
    met = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(bits_of(F.col("g")))])
    return probes.join(filters, [BLOCKS, "block"]).where(met).select("_writer", "_batch_id").distinct()


def possible(tables: Tables, name: str, ids: DataFrame, key: str) -> list[tuple[str, int]]:
    """The batches that may hold one of the ids."""
    known = bounds(tables, name)
    unknown = [b for b in tables.batches(name) if b not in known]
    if not known:
        return sorted(unknown)
    filters = tables.spark.read.parquet(f"{folder(tables.path(name))}/filters")
    found = {(r["_writer"], r["_batch_id"]) for r in hits(ids.limit(FIRST), filters, key).collect()}
    left = [b for b in known if b not in found]
    if left:  # these alone meet all ids
        found |= {(r["_writer"], r["_batch_id"]) for r in hits(ids, of_batches(filters, left), key).collect()}
    return sorted([*unknown, *[b for b in known if b in found]])


def newest(tables: Tables, name: str, time: str, leave: tuple[str, int] | None = None) -> int | None:
    """The latest time in a table (microseconds). Only batches without bounds are read for it."""
    known = bounds(tables, name)
    unknown = [b for b in tables.batches(name) if b not in known and b != leave]
    last = [b[1] for k, b in known.items() if b[1] is not None and k != leave]
    if unknown:
        read = of_batches(tables.read(name, origin=True), unknown).agg(F.max(F.unix_micros(time))).first()[0]
        last += [] if read is None else [read]
    return max(last, default=None)
