"""The same message tables kept up by Structured Streaming."""

from __future__ import annotations

import json
import time
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import types as T

from prosa.operators import bronze as B
from prosa.operators import conversations as C
from prosa.operators import silver as S
from prosa.operators import gold as G
from prosa.params import CANONICAL, Profile
from prosa.plans.medallion import build_gold, compared, gold_rules, gold_state, sum_rules, write_grouped
from prosa.schemas import SOURCE_MESSAGES
from prosa.sources.tables import BATCH, KEY, VERSION, WRITER, Tables, current

ORIGIN = "_arrived_from"


def arriving(spark: SparkSession, folder: str, schema: T.StructType = SOURCE_MESSAGES,
             files_per_batch: int = 1000) -> DataFrame:
    """Message files as they land in a folder, with the file each came from. The schema is given: a
    stream must not change it."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return files.select("*", F.col("_metadata.file_path").alias(ORIGIN))


def _start(stream: DataFrame, write: Callable[[DataFrame, int, str], None], checkpoint: str,
           every: str | None) -> StreamingQuery:
    """Run ``write`` with each micro-batch, its number and the name this stream writes under. The name is the
    stream's own id, which its checkpoint keeps: a new checkpoint is another writer."""
    def named(batch: DataFrame, number: int) -> None:
        state = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        write(batch, number, f"stream-{json.loads(state)['id']}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(named)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def stream_to_bronze(source: DataFrame, tables: Tables, checkpoint: str, every: str | None = None,
                     profile: Profile = CANONICAL) -> StreamingQuery:
    """Append arriving messages that are new to Bronze.

    A micro-batch is compared with the batches in Bronze that may hold one of its ids, but not itself, and goes to its own
    folder: batch jobs and other streams may write the same table, and a micro-batch repeated after a failure adds its rows once.
    ``every=None`` handles what is there and stops.
    """
    def write(batch: DataFrame, number: int, writer: str) -> None:
        typed = batch if profile.name == "notebook" else B.cast_timestamp(batch)
        release = None
        if tables.exists("bronze"):
            typed, release = compared(tables, typed, profile, leave=(writer, number))
        came = typed.withColumn("_from", F.col(ORIGIN)).drop(ORIGIN) if ORIGIN in typed.columns else typed.withColumn("_from", F.lit("stream"))
        stamped = B.stamp(B.parse_metadata(came, profile), "").withColumn("_source_file", F.col("_from")).drop("_from")
        try:
            tables.append(stamped, "bronze", batch=number, writer=writer)
        finally:
            if release:
                release()

    return _start(source, write, checkpoint, every)


def stream_messages(messages: DataFrame, tables: Tables, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream of typed messages to a table as they come. :func:`resolved` reads its current state."""
    def write(batch: DataFrame, number: int, writer: str) -> None:
        tables.append(batch.drop(ORIGIN), name, batch=number, writer=writer)

    return _start(messages, write, checkpoint, every)


def resolved(messages: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """One row per logical message, with its most advanced status so far. No row waits for a watermark, and a
    better status wins however late it comes."""
    return S.deduplicate(messages, profile)


def changes(tables: Tables, name: str = "bronze", files_per_batch: int = 1000) -> DataFrame:
    """A table's rows as writers add them."""
    schema = tables.read(name, versions=True).schema
    return (tables.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").parquet(tables.path(name)))


def rows_of(tables: Tables, name: str, keys: DataFrame) -> DataFrame:
    """The rows of some conversations. Of a clustered table only their buckets are read."""
    held = tables.read(name, versions=True, buckets=tables.buckets_of(name, keys))
    return held.join(keys, KEY, "left_semi")


def _batch(tables: Tables, name: str, writer: str, number: int, own: bool) -> DataFrame:
    """The rows of one batch of one writer, or all others, of a versioned table."""
    rows = tables.read(name, origin=True)
    mine = (F.col(WRITER) == writer) & (F.col(BATCH) == number)
    return rows.where(mine if own else ~mine).drop(WRITER, BATCH)


def refresh_touched(bronze_stream: DataFrame, tables: Tables, checkpoint: str, every: str | None = "60 seconds",
                    profile: Profile = CANONICAL, gold: bool = True, guard: bool = True) -> StreamingQuery:
    """Keep Silver and Gold current as Bronze grows.

    Each micro-batch names the conversations it touched. Their messages are read again from their buckets of Bronze and
    their Silver rows computed anew, so no partial average is ever merged. New versions are appended to Silver and to
    the Gold tables with a row for each conversation; reading a table gives the newest. What the touched
    conversations counted for before is taken out of the sums behind the grouped Gold tables, what they count for now
    is added, and those small tables are written from the sums. Where Gold is not there yet, or Silver was built
    anew, all of it is built first. One stream refreshes a folder of tables.

    A micro-batch repeated after a failure replaces its own versions and sums and compares with all others. One that would
    bring personal data into Gold stops the stream before any Gold table is changed (``guard``, see ``build_gold``).
    """
    def write(batch: DataFrame, number: int, writer: str) -> None:
        touched = batch.select(KEY).where(F.col(KEY).isNotNull()).distinct()
        version = F.lit(time.time_ns() // 1000).alias(VERSION)
        messages = S.silver_messages(rows_of(tables, "bronze", touched), profile)
        tables.append(messages.select("*", version), "silver_messages", batch=number, writer=writer)
        written = _batch(tables, "silver_messages", writer, number, own=True).drop(VERSION)
        tables.append(C.silver_conversations(written, profile).select("*", version), "silver_conversations", batch=number, writer=writer)
        if gold:
            refresh_gold(tables, writer, number, profile, guard=guard)
        else:
            tables.drop(gold_state(tables))

    return _start(bronze_stream, write, checkpoint, every)


def refresh_gold(tables: Tables, writer: str, number: int, profile: Profile = CANONICAL, fold: int = 32,
                 guard: bool = True) -> None:
    """Bring Gold from the state before one batch of Silver conversations to that after it. After ``fold`` batches the
    sums are added up into one."""
    state = gold_state(tables)
    if not tables.exists(state):
        build_gold(tables, profile, current(_batch(tables, "silver_conversations", writer, number, own=False)), grouped=False, guard=guard)
    elif len(tables.batches(state)) > fold:
        tables.overwrite(G.summed(_batch(tables, state, writer, number, own=False)), state)
    fresh = _batch(tables, "silver_conversations", writer, number, own=True)
    touched = fresh.select(KEY)
    buckets = tables.buckets_of("silver_conversations", touched)
    before = tables.read("silver_conversations", origin=True, buckets=buckets)
    before = before.where(~((F.col(WRITER) == writer) & (F.col(BATCH) == number))).join(touched, KEY, "left_semi")
    before = current(before.drop(WRITER, BATCH))
    columns = {name: (*chosen, VERSION) for name, chosen in G.row_columns(profile).items()}
    tagged = G.row_tables(fresh, profile, VERSION)
    tables.write_many(tagged, G.TABLE, columns, batch=number, writer=writer, rules=gold_rules(tagged) if guard else None)
    delta = G.summed(G.contributions(fresh, profile), G.contributions(before, profile, sign=-1))
    tables.append(delta, state, batch=number, writer=writer, rules=sum_rules(delta) if guard else None)
    write_grouped(tables, profile)


def latest_versions(conversations: DataFrame) -> DataFrame:
    """The newest version of every conversation, of rows read with all versions."""
    return current(conversations)


def latest_messages(messages: DataFrame) -> DataFrame:
    """The messages of the newest version of every conversation, of rows read with all versions."""
    return current(messages, single=False)
