"""Source messages to the typed, stamped Bronze table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosa.operators.ordering import position
from prosa.params import CANONICAL, Profile
from prosa.schemas import METADATA

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


class SchemaValidationError(ValueError):
    """The source does not have the agreed columns, or has no rows."""


def schema_issues(df: DataFrame, profile: Profile = CANONICAL, check_rows: bool = True) -> list[str]:
    """What is wrong with a source; an empty list means it can be ingested."""
    issues = []
    missing = sorted(set(profile.required_columns) - set(df.columns))
    if missing:
        issues.append(f"Missing columns: {missing}")
    if check_rows and df.isEmpty():
        issues.append("DataFrame is empty")
    return issues


def extra_columns(df: DataFrame, profile: Profile = CANONICAL) -> list[str]:
    return sorted(set(df.columns) - set(profile.required_columns))


def require_valid(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    issues = schema_issues(df, profile)
    if issues:
        raise SchemaValidationError(f"Schema validation failed: {issues}")
    return df


def parse_metadata(df: DataFrame, profile: Profile = CANONICAL, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON text to typed ``meta_*`` columns; the text is kept.

    ``mode="FAILFAST"`` stops on malformed text instead of giving nulls.
    """
    if profile.metadata_keys:
        parsed = F.from_json("metadata", "map<string,string>", {"mode": mode})
        names = {f"meta_{key}": F.try_element_at(F.col("_meta"), F.lit(key))
                 for key in profile.metadata_keys}
    else:
        parsed = F.from_json("metadata", METADATA, {"mode": mode})
        names = {f"meta_{f.name}": F.col("_meta").getField(f.name) for f in METADATA.fields}
    return df.withColumn("_meta", parsed).withColumns(names).drop("_meta")


def bad_metadata(df: DataFrame) -> DataFrame:
    """Rows, and rows whose metadata text is not a JSON object of the agreed types."""
    checked = F.from_json(
        "metadata", METADATA.simpleString()[:-1] + ",_bad:string>",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.select(checked.alias("m")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("m._bad").alias("bad_rows"))


def cast_timestamp(df: DataFrame, strict: bool = True) -> DataFrame:
    """Text to timestamp. Strict stops on other formats (ANSI mode), lenient gives null."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    pattern = F.lit(TIMESTAMP_FORMAT) if not strict else TIMESTAMP_FORMAT
    return df.withColumn("timestamp", parse(F.col("timestamp"), pattern))


def stamp(df: DataFrame, source_file: str | None = None) -> DataFrame:
    """Ingestion time and origin; the file a row came from when no name is given."""
    origin = F.lit(source_file) if source_file is not None else F.input_file_name()
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source_file": origin})


def unseen_ids(incoming: DataFrame, existing: DataFrame, key: str = "message_id") -> DataFrame:
    """Incoming rows whose id the table does not hold.

    The large table is only scanned for its id column and semi-joined with the batch's ids, so
    what leaves it is at most one batch of ids, whatever the size of the table. The rows themselves
    pass a hash table of these ids: they are not sorted, which would hold whole messages in memory.
    Neither join minds an id that stands twice on its right, so no ids are made distinct.
    """
    held = existing.select(key).join(incoming.select(key), key, "left_semi")
    return incoming.join(held.hint("shuffle_hash"), key, "left_anti")


def new_rows(incoming: DataFrame, existing: DataFrame, latest: Column | None = None) -> DataFrame:
    """Rows later than everything held, or with an id not held yet.

    An old id with a later time passes on purpose. With an empty table everything passes. Where the ``latest`` time
    held is known, ``existing`` need hold only the rows that may have an id of the earlier incoming rows.
    """
    ids = incoming.select("message_id").distinct()
    held = (existing.select("message_id").join(ids, "message_id", "left_semi").distinct()
            .withColumn("_held", F.lit(True)))
    if latest is None:
        latest = existing.agg(F.max("timestamp").alias("latest")).scalar()
    return (
        incoming.join(held, "message_id", "left")
        .where((F.col("timestamp") > latest) | F.col("_held").isNull())
        .select(*incoming.columns)
    )


def compared_ids(incoming: DataFrame, existing: DataFrame, many: bool = False) -> DataFrame:
    """Each id of ``incoming`` once, and whether ``existing`` holds it (``_held``). Only ids are moved.

    ``many``: incoming ids are too many to be sent to every task. Then both sides are shuffled in any case, and one grouping
    of all ids tells what is held: no side is sorted. Few ids meet the table where it is.
    """
    ids = incoming.select("message_id").where(F.col("message_id").isNotNull())
    if many:
        both = ids.withColumn("_old", F.lit(False)).unionByName(existing.select("message_id", F.lit(True).alias("_old")))
        flags = both.groupBy("message_id").agg(F.min("_old").alias("_only"), F.max("_old").alias("_held"))
        return flags.where(~F.col("_only")).select("message_id", "_held")
    ids = ids.distinct()
    held = (existing.select("message_id").join(ids, "message_id", "left_semi").distinct()
            .withColumn("_held", F.lit(True)))
    return ids.join(held, "message_id", "left").select("message_id", F.col("_held").isNotNull().alias("_held"))


def rows_by_ids(incoming: DataFrame, ids: DataFrame, held: bool, latest: Column) -> DataFrame:
    """What :func:`new_rows` gives, where the ``ids`` of the earlier incoming rows that are held are known, or (``held``
    false) those that aren't. Ids stand once."""
    marked = incoming.join(ids.select("message_id", F.lit(True).alias("_listed")), "message_id", "left")
    listed = F.col("_listed").isNotNull()
    fresh = ~listed if held else listed | F.col("message_id").isNull()
    return marked.where((F.col("timestamp") > latest) | fresh).select(*incoming.columns)


def to_bronze(df: DataFrame, source_file: str | None = None, profile: Profile = CANONICAL) -> DataFrame:
    """Typed and stamped messages; ``df`` has passed :func:`require_valid`."""
    if dict(df.dtypes)["timestamp"] == "string":
        df = cast_timestamp(df)
    return stamp(parse_metadata(df, profile), source_file)


def split_batches(df: DataFrame, batches: int, order: tuple[str, ...] = ("timestamp", "message_id")) -> DataFrame:
    """Number the rows 0..batches-1 in time order, in near-equal parts; the last takes the rest.

    Write the result with ``partitionBy("batch")`` to get one folder per batch.
    """
    rows = df.count()
    size, last = rows // batches, F.lit(batches - 1)
    numbered = position(df, order, alias="_position")
    batch = F.least(F.floor((F.col("_position") - 1) / size), last) if size else last
    return numbered.withColumn("batch", batch.cast("int")).drop("_position")


def batch_summary(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )
