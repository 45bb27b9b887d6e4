"""Named tables under a root folder: reading, appending, replacing safely, listing.

The format is a parameter: ``parquet`` (default) or ``delta`` where its package is installed.
With Parquet, each writer appends into folders of its own, ``_writer=NAME/_batch_id=N``. A ``Tables`` object
is a writer with a name of its own, a stream is another, so two jobs, or a job and a stream, never touch each other's
rows. Repeating a batch replaces that writer's folder N and nothing else. Replacing a table writes beside it first and
swaps the folders after success. The schema is kept beside the rows, by each writer what it added, so a read opens no
footers and no writer undoes another's columns.

Tables of conversations can be clustered (``buckets``): rows lie in folders by a hash of the conversation, so those of some
conversations are found without reading the rest. How many buckets a table has is kept with its schema.

Rows may carry a version (``_version``): then only those of the newest version of each conversation are the table.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosa.schemas import NOTEBOOK_RUNS
from prosa.sources import skipping
from prosa.sources.guard import Guard

BATCH, WRITER, BUCKET, VERSION, SCHEMA = "_batch_id", "_writer", "_bucket", "_version", "_schema"
#: What tables are clustered and versioned by.
KEY = "conversation_id"

# Logical names and where they live below the root.
LAYOUT = {
    "bronze": "bronze",
    "silver_messages": "silver/messages",
    "silver_conversations": "silver/conversations",
    "gold_sentiment": "gold/sentiment",
    "gold_personas": "gold/personas",
    "gold_segmentation": "gold/segmentation",
    "gold_analytics": "gold/analytics",
    "gold_vendor": "gold/vendor_analysis",
}

#: Tables of which each batch is described for data skipping, with the columns of id and time.
SKIPPING = {"bronze": ("message_id", "timestamp")}

LISTING = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("exists", T.BooleanType()), T.StructField("rows", T.LongType()),
    T.StructField("version", T.LongType()),
])


def read_source(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A source by suffix: ``.csv`` with header, anything else Parquet. A missing path raises.

    Give the schema for CSV where it is known: inferring it costs a pass over the file.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if path.endswith(".csv"):
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def nanos_to_timestamp(df: DataFrame, *columns: str) -> DataFrame:
    """Nanosecond Parquet timestamps, read as long with ``spark.sql.legacy.parquet.nanosAsLong``,
    to microsecond timestamps."""
    # Integer arithmetic: nanoseconds do not fit a double.
    return df.withColumns({
        c: F.timestamp_micros(F.expr(f"(`{c}` - pmod(`{c}`, 1000L)) div 1000L")) for c in columns})


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, on whatever file system it lies."""
    files, hadoop = _file_system(spark, path)
    if not files.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(hadoop)
                  if s.isDirectory() and not s.getPath().getName().startswith("."))


def _stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The fields that any writer has stored, in the order in which writers are named."""
    files, hadoop = _file_system(spark, path)
    if not files.exists(hadoop):
        return None
    fields: dict[str, T.StructField] = {}
    for status in sorted(files.listStatus(hadoop), key=lambda x: x.getPath().getName()):
        name = status.getPath().getName()
        if not (name.startswith(SCHEMA) and name.endswith(".json")):
            continue
        stream = files.open(status.getPath())
        try:
            stored = T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
        for f in stored.fields:
            fields.setdefault(f.name, f)
    return T.StructType(list(fields.values())) if fields else None


def _store_schema(spark: SparkSession, path: str, schema: T.StructType, writer: str, buckets: int | None = None) -> None:
    """Keep what this writer adds to the table's schema, all nullable, in a file of its own."""
    stored = _stored_schema(spark, path)
    known = {f.name: f for f in (stored.fields if stored else [])}
    for f in schema.fields:
        if f.name in known and known[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"{path}: column {f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    fresh = [T.StructField(f.name, f.dataType, True) for f in schema.fields if f.name not in known]
    if buckets and BUCKET not in known:
        fresh.append(T.StructField(BUCKET, T.IntegerType(), True, {"buckets": buckets}))
    if not fresh:
        return
    files, hadoop = _file_system(spark, f"{path}/{SCHEMA}-{writer}.json")
    out = files.create(hadoop, True)
    out.writeBytes(json.dumps(T.StructType([*known.values(), *fresh]).jsonValue()))
    out.close()


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def current(df: DataFrame, single: bool = True) -> DataFrame:
    """The rows of the newest version of each conversation, without the version. Rows that have none are the oldest.

    ``single``: a version is one row. Then the row number is limited before the shuffle as well; otherwise the newest
    versions are joined back, which Spark can split where one conversation has very many rows.
    """
    if VERSION not in df.columns:
        return df
    if single:
        window = Window.partitionBy(KEY).orderBy(F.desc_nulls_last(VERSION))
        return df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") == 1).drop("_nth", VERSION)
    newest = df.groupBy(F.col(KEY).alias("_c")).agg(F.coalesce(F.max(VERSION), F.lit(0)).alias("_v"))
    same = F.col(KEY).eqNullSafe(F.col("_c")) & (F.coalesce(VERSION, F.lit(0)) == F.col("_v"))
    return df.join(newest, same, "left_semi").drop(VERSION)


class Tables:
    """The tables of one data root."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet",
                 layout: Mapping[str, str] = LAYOUT, buckets: int | None = None):
        self.spark, self.root, self.fmt, self.layout, self.buckets = spark, root.rstrip("/"), fmt, dict(layout), buckets
        self.writer = f"job-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        """Path of a logical name; an unknown name is a path already."""
        return os.path.join(self.root, self.layout[name]) if name in self.layout else name

    def place(self, name: str) -> str:
        """Path of a logical name, or of a name below the root."""
        return os.path.join(self.root, self.layout.get(name, name))

    def read(self, name: str, as_of: int | None = None, origin: bool = False, versions: bool = False,
             buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as it is now, or (one writer's appends) its state after batch ``as_of``.

        ``versions`` gives all versions of rows instead of the current one, ``origin`` those with the columns that tell
        writer and batch. ``buckets`` limits a clustered table to these; no other folder is listed for the scan. A table
        folder, a single file and a folder of plain Parquet files read the same way.
        """
        path = self.path(name)
        if self.fmt == "delta":
            reader = self.spark.read.format("delta")
            if as_of is not None:
                reader = reader.option("versionAsOf", as_of)
            return reader.load(path)
        schema = _stored_schema(self.spark, path)
        if schema is None:
            return self.spark.read.parquet(path)
        parts = [T.StructField(WRITER, T.StringType()), T.StructField(BATCH, T.LongType())]
        fields = [f for f in schema.fields if f.name != BUCKET]
        clustered = [T.StructField(BUCKET, T.IntegerType())] if len(fields) < len(schema.fields) else []
        df = self.spark.read.schema(T.StructType([*fields, *parts, *clustered])).parquet(path)
        if as_of is not None:
            # A partition column: later batches are not even listed for the scan.
            df = df.where(F.col(BATCH) <= as_of)
        if buckets is not None and clustered:
            df = df.where(F.col(BUCKET).isin(*buckets))
        if origin:
            return df.drop(BUCKET)
        df = df.drop(WRITER, BATCH, BUCKET)
        return df if versions else current(df, single=path != self.place("silver_messages"))

    def bucket_count(self, name: str) -> int | None:
        """How many buckets a table is clustered into; of a table that isn't there, how many it will have."""
        schema = _stored_schema(self.spark, self.path(name))
        if schema is None:
            return self.buckets
        return schema[BUCKET].metadata["buckets"] if BUCKET in schema.names else None

    def buckets_of(self, name: str, keys: DataFrame) -> list[int] | None:
        """The buckets that these conversations are in: a short list, whatever the number of conversations."""
        count = self.bucket_count(name)
        if count is None:
            return None
        return [r[0] for r in keys.select(bucket_of(KEY, count)).distinct().collect()]

    def possible(self, name: str, ids: DataFrame, leave: tuple[str, int] | None = None) -> DataFrame:
        """The rows of the batches that may hold one of the ids; ``leave`` is a batch to leave out."""
        if self.fmt == "delta" or name not in SKIPPING or not self.batches(name):
            return self.read(name)
        found = [b for b in skipping.possible(self, name, ids, SKIPPING[name][0]) if b != leave]
        return skipping.of_batches(self.read(name, origin=True), found).drop(WRITER, BATCH)

    def exists(self, name: str) -> bool:
        files, hadoop = _file_system(self.spark, self.path(name))
        if not files.exists(hadoop):
            return False
        try:
            self.read(name).schema
            return True
        except PySparkException:
            return False

    def version(self, name: str) -> int:
        """Number of the last batch (Delta: version); -1 without one. Reads folder names only."""
        path = self.path(name)
        if self.fmt == "delta":
            if not self.exists(name):
                return -1
            history = self.spark.sql(f"DESCRIBE HISTORY delta.`{path}`")
            return history.agg(F.max("version")).first()[0]
        return max((n for w in _folders(self.spark, path) if w.startswith(f"{WRITER}=") for n in self._batches(path, w)), default=-1)

    def _batches(self, path: str, writer_folder: str) -> list[int]:
        return [int(f.split("=", 1)[1]) for f in _folders(self.spark, f"{path}/{writer_folder}") if f.startswith(f"{BATCH}=")]

    def count(self, name: str) -> int:
        """Row count, from Parquet footers."""
        return self.read(name).count()

    def _write(self, df: DataFrame, folder: str, buckets: int | None, *partitions: str) -> None:
        if buckets and KEY in df.columns:
            # Some files for each bucket: Spark splits the large ones and puts small ones together.
            df = df.withColumn(BUCKET, bucket_of(KEY, buckets)).hint("rebalance", F.col(BUCKET))
            partitions = (*partitions, BUCKET)
        df.write.mode("overwrite").partitionBy(*partitions).parquet(folder)

    def append(self, df: DataFrame, name: str, batch: int | None = None, writer: str | None = None,
               rules: Mapping[str, Column] | None = None) -> int:
        """Add rows as a new batch of this writer and return its number. New columns are allowed.

        Writing a given number again replaces that batch of the same writer, so a retried job adds
        its rows once. With ``rules`` (see ``Guard``) the batch is written beside the table and moved in if no row breaks one.
        """
        path, writer, guard = self.path(name), writer or self.writer, Guard(rules)
        if self.fmt == "delta":
            guard.stopping(df).write.format("delta").mode("append").option("mergeSchema", "true").save(path)
            return self.version(name)
        number = self.version(name) + 1 if batch is None else batch
        buckets = self.bucket_count(name) if KEY in df.columns else None
        home = f"{path}/{WRITER}={writer}"
        if rules:
            staged = self._beside(path, "new")
            try:
                self._write(guard.watch(df), staged, buckets)
                guard.check(name, self._rows_in(staged, df))
                self._forget(name, writer, number)
                self._move_in(staged, home, number)
            finally:
                files, hadoop = _file_system(self.spark, staged)
                files.delete(hadoop, True)
        else:
            self._forget(name, writer, number)
            self._write(df, f"{home}/{BATCH}={number}", buckets)
        _store_schema(self.spark, path, df.schema, writer, buckets)
        self._describe(name, writer, number)
        return number

    def _rows_in(self, folder: str, df: DataFrame) -> DataFrame:
        """What was written of ``df`` to a folder."""
        return self.spark.read.schema(df.schema).parquet(folder)

    def _forget(self, name: str, writer: str, number: int) -> None:
        if name in SKIPPING:
            skipping.forget(self.spark, self.path(name), writer, number)

    def _describe(self, name: str, writer: str, number: int) -> None:
        if name in SKIPPING:
            rows = self.read(name, origin=True)
            if set(SKIPPING[name]) <= set(rows.columns):
                mine = skipping.of_batches(rows, [(writer, number)]).select(*SKIPPING[name])
                skipping.describe(mine, self.path(name), writer, number, *SKIPPING[name])

    def overwrite(self, df: DataFrame, name: str, rules: Mapping[str, Column] | None = None) -> int:
        """Replace table and schema. The rows go to a folder beside the table, which takes its place
        when they are complete and none breaks one of the ``rules`` (see ``Guard``): a failed or refused job leaves the table
        as it was, and rows may come from it."""
        path, guard = self.path(name), Guard(rules)
        if self.fmt == "delta":
            guard.stopping(df).write.format("delta").mode("overwrite").option("overwriteSchema", "true").save(path)
            return self.version(name)
        fresh = self._beside(path, "new")
        buckets = self.buckets if KEY in df.columns else None
        try:
            self._write(guard.watch(df), f"{fresh}/{WRITER}=batch/{BATCH}=0", buckets)
            guard.check(name, self._rows_in(f"{fresh}/{WRITER}=batch/{BATCH}=0", df))
            _store_schema(self.spark, fresh, df.schema, "batch", buckets)
        except Exception:
            files, hadoop = _file_system(self.spark, fresh)
            files.delete(hadoop, True)
            raise
        if name in SKIPPING:
            skipping.forget(self.spark, path)
        self._swap(fresh, path)
        self._describe(name, "batch", 0)
        return 0

    def write_many(self, df: DataFrame, tag: str, columns: Mapping[str, Sequence[str]], batch: int | None = None,
                   writer: str | None = None, rules: Mapping[str, Column] | None = None) -> None:
        """Several tables in one job: the rows whose ``tag`` is a table's name are that table's, with its columns. The
        tables are replaced, or, with ``batch`` and ``writer``, get one more batch each. A row that breaks one of the ``rules``
        (see ``Guard``) stops all of them."""
        guard = Guard(rules)
        if self.fmt == "delta":
            df = guard.stopping(df)
            for name, chosen in columns.items():
                rows = df.where(F.col(tag) == name).select(*chosen)
                self.overwrite(rows, self.place(name)) if batch is None else self.append(rows, self.place(name))
            return
        staged = self._beside(f"{self.root}/tables", "new")
        names = {name.replace("/", "."): name for name in columns}
        sizes = {self.buckets if batch is None else self.bucket_count(self.place(n)) for n in columns}
        if len(sizes) > 1:
            raise ValueError("tables written together have the same number of buckets")
        buckets = sizes.pop()
        files, hadoop = _file_system(self.spark, staged)
        try:
            self._write(guard.watch(df).withColumn(tag, F.replace(F.col(tag), F.lit("/"), F.lit("."))), staged, buckets, tag)
            guard.check(", ".join(columns), self._rows_in(staged, df))
            for leaf, name in names.items():
                path, schema = self.place(name), df.select(*columns[name]).schema
                rows = f"{staged}/{tag}={leaf}"
                files.mkdirs(_file_system(self.spark, rows)[1])  # where there are no rows
                target = self._beside(path, "new") if batch is None else path
                self._move_in(rows, f"{target}/{WRITER}={'batch' if batch is None else writer}", 0 if batch is None else batch)
                _store_schema(self.spark, target, schema, "batch" if batch is None else writer, buckets)
                if batch is None:
                    self._swap(target, path)
        finally:
            files.delete(hadoop, True)

    def _beside(self, path: str, what: str) -> str:
        parent, leaf = os.path.split(path)
        return f"{parent}/.{leaf}-{what}-{uuid.uuid4().hex[:12]}"

    def _move_in(self, rows: str, home: str, number: int) -> None:
        """A complete folder of rows becomes a batch of the writer whose folder is ``home``."""
        files, place = _file_system(self.spark, f"{home}/{BATCH}={number}")
        files.mkdirs(_file_system(self.spark, home)[1])
        files.delete(place, True)
        if not files.rename(_file_system(self.spark, rows)[1], place):
            raise OSError(f"{place} can't be written")

    def _swap(self, fresh: str, path: str) -> None:
        """Put a complete folder in the place of a table."""
        files, there = _file_system(self.spark, path)
        beside, aside = (_file_system(self.spark, p)[1] for p in (fresh, self._beside(path, "old")))
        if files.exists(there) and not files.rename(there, aside):
            raise OSError(f"{path} can't be moved aside")
        if not files.rename(beside, there):
            files.rename(aside, there)
            raise OSError(f"{path} can't be replaced")
        files.delete(aside, True)

    def batches(self, name: str) -> list[tuple[str, int]]:
        """Writer and number of each batch."""
        path = self.path(name)
        return [(w.split("=", 1)[1], n) for w in _folders(self.spark, path) if w.startswith(f"{WRITER}=") for n in self._batches(path, w)]

    def drop(self, name: str) -> None:
        files, hadoop = _file_system(self.spark, self.path(name))
        files.delete(hadoop, True)

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> int:
        if mode not in ("overwrite", "append"):
            raise ValueError(f"mode {mode!r}")
        return self.overwrite(df, name) if mode == "overwrite" else self.append(df, name)

    def listing(self) -> DataFrame:
        """One row per known table: path, whether it exists, rows, version. An unreadable table
        counts as absent."""
        rows = []
        for name in self.layout:
            path, entry = self.path(name), (False, 0, -1)
            try:
                if self.exists(name):
                    entry = (True, self.count(name), self.version(name))
            except PySparkException:
                pass
            rows.append((name, path, *entry))
        return self.spark.createDataFrame(rows, LISTING)

    def gold_tables(self, folder: str = "gold") -> dict[str, DataFrame]:
        """Every readable, non-empty table found below the Gold folder."""
        found, base = {}, os.path.join(self.root, folder)
        for name in _folders(self.spark, base):
            path = os.path.join(base, name)
            if self.exists(path):
                df = self.read(path)
                if not df.isEmpty():
                    found[name] = df
        return found

    def register(self, **extra: DataFrame) -> list[str]:
        """Temp views for all existing tables and any frames given, for use in SQL."""
        names = []
        for name in self.layout:
            if self.exists(name):
                self.read(name).createOrReplaceTempView(name)
                names.append(name)
        for name, df in extra.items():
            df.createOrReplaceTempView(name)
            names.append(name)
        return names

    def sql(self, query: str, **frames: DataFrame) -> DataFrame:
        """A query over frames named in it as ``{name}``."""
        return self.spark.sql(query, **frames)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with header. Arrays and structs become JSON text, which CSV has no form for."""
    flat = [F.to_json(f.name).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_record(spark: SparkSession, tables: Tables, name: str, record: Mapping,
                  schema: T.StructType = NOTEBOOK_RUNS) -> int:
    """Append one log record. ``schema`` names and types its fields; a field without a value is null. Text
    fields that the schema lacks are added."""
    more = [T.StructField(k, T.StringType()) for k in record if k not in schema.names]
    whole = T.StructType([*schema.fields, *more])
    row = tuple(None if record.get(f.name) is None else float(record[f.name]) if isinstance(f.dataType, T.DoubleType)
                else str(record[f.name]) if isinstance(f.dataType, T.StringType) else record[f.name] for f in whole.fields)
    return tables.append(spark.createDataFrame([row], whole).coalesce(1), name)
