"""What moves when messages are compared with Bronze."""

from pyspark.sql import functions as F

from fixtures import message, source
from prosa.operators.bronze import cast_timestamp, new_rows
from prosa.plans.medallion import compared, ingest
from prosa.sources import skipping
from prosa.sources.tables import Tables


def load(spark, tmp_path, first, n):
    rows = source(spark, *[message(f"m{i}", f"c{i}", at=f"2026-02-01 10:00:{i % 60:02d}") for i in range(first, first + n)])
    rows.write.parquet(str(tmp_path / f"{first}-{n}"))
    return str(tmp_path / f"{first}-{n}")


def test_messages_of_a_load_are_not_shuffled(spark, tmp_path):
    """Of 40 messages 38 are held, then 2: ids are compared, messages stay where they are."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 200)
    try:
        tables = Tables(spark, str(tmp_path / "data"))
        ingest(tables, load(spark, tmp_path, 0, 40))
        for first, fresh in ((2, 2), (40, 38)):
            incoming = cast_timestamp(spark.read.parquet(load(spark, tmp_path, first, 40)))
            rows, release = compared(tables, incoming)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0]
            assert rows.count() == new_rows(incoming, tables.read("bronze")).count() >= fresh
            release()
            tables.append(rows.limit(0), "bronze")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_compared_rows_are_those_of_new_rows(spark, tmp_path):
    """Repeated and null ids, later and null times, whichever list is shorter."""
    tables = Tables(spark, str(tmp_path / "data"))
    ingest(tables, load(spark, tmp_path, 0, 20))
    times = F.when(F.col("k") == 0, F.lit("2026-01-01 00:00:00")).when(F.col("k") == 1, F.lit("2026-03-01 00:00:00"))
    for first in (2, 15):
        rows = spark.read.parquet(load(spark, tmp_path, first, 20)).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
        rows = cast_timestamp(rows.withColumn("timestamp", times).withColumn(
            "message_id", F.when(F.col("message_id") != "m16", F.col("message_id"))).drop("k"))
        got, release = compared(tables, rows)
        want = new_rows(rows, tables.read("bronze"))
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 20
        release()


def test_ids_move_as_one_hash(spark, tmp_path):
    """The bits an id sets are worked out where its block is, not sent there."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tables = Tables(spark, str(tmp_path / "data"))
        ingest(tables, load(spark, tmp_path, 0, 20))
        filters = spark.read.parquet(f"{skipping.folder(tables.path('bronze'))}/filters")
        plan = skipping.hits(spark.createDataFrame([("m3",), ("x",)], "message_id string"), filters, "message_id")._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate"):].split("+- Relation")[0] if "Generate" in plan else plan
        assert "shiftleft" not in below
        assert skipping.possible(tables, "bronze", spark.createDataFrame([("m3",)], "message_id string"), "message_id") == tables.batches("bronze")
        assert skipping.possible(tables, "bronze", spark.createDataFrame([("x",)], "message_id string"), "message_id") == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
