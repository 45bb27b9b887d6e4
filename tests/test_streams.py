
import pytest
from pyspark.sql import functions as F

from fixtures import by, later_batch, message, source, two_conversations
from prosa.operators.bronze import cast_timestamp
from prosa.plans.medallion import build_gold, build_silver, ingest, one_plan
from prosa.operators import gold as G
from prosa.sources import derived as D
from prosa.sources.tables import Tables
from prosa.streaming.messages import (
    arriving, changes, latest_messages, latest_versions, refresh_touched, resolved, rows_of, stream_messages, stream_to_bronze,
)


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_bronze_takes_new_messages_only(spark, tmp_path):
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))

    def run():
        stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "state")).awaitTermination()

    land(two_conversations(spark), folder)
    run()
    assert tables.count("bronze") == 4
    land(two_conversations(spark).unionByName(later_batch(spark)), folder)
    run()
    assert tables.count("bronze") == 6
    run()
    assert tables.count("bronze") == 6


def test_new_checkpoint_adds_nothing_twice(spark, tmp_path):
    """A stream that starts again without its state compares with all that is there."""
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))
    land(two_conversations(spark), folder)
    for state in ("lost", "again"):
        stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / state)).awaitTermination()
        assert tables.count("bronze") == 4


def test_batch_and_stream_write_one_table(spark, tmp_path):
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))
    two_conversations(spark).write.parquet(str(tmp_path / "one"))
    later_batch(spark).write.parquet(str(tmp_path / "two"))
    ingest(tables, str(tmp_path / "one"))
    land(two_conversations(spark).limit(1).unionByName(source(spark, message("s1", "c9", at="2026-03-01 10:00:00"))), folder)
    stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "state")).awaitTermination()
    assert tables.count("bronze") == 5
    ingest(tables, str(tmp_path / "two"))
    land(source(spark, message("s2", "c9", at="2026-05-01 10:00:00")), folder)
    stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "state")).awaitTermination()
    held = {r["message_id"]: r["_source_file"] for r in tables.read("bronze").collect()}
    assert len(held) == tables.count("bronze") == 8 and "/in/" in held["s1"]


def test_late_better_status_wins_at_any_time(spark, tmp_path):
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))

    def run():
        typed = cast_timestamp(arriving(spark, folder, files_per_batch=1))
        stream_messages(typed, tables, "bronze", str(tmp_path / "state")).awaitTermination()
        return by(resolved(tables.read("bronze")), "message_id")

    land(source(spark, message("a", status="sent"), message("b", status="sent", body="x")), folder)
    assert set(run()) == {"a", "b"}
    land(source(spark, message("a2", status="read"), message("n", at="2026-02-01 09:30:00")), folder)
    assert set(run()) == {"a2", "b", "n"}
    land(source(spark, message("z", at="2026-02-09 12:00:00")), folder)
    assert set(run()) == {"a2", "b", "n", "z"}
    land(source(spark, message("late", status="read", body="x")), folder)
    assert set(run()) == {"a2", "late", "n", "z"}


def test_refresh_after_batch_keeps_all(spark, tmp_path):
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))
    two_conversations(spark).write.parquet(str(tmp_path / "one"))
    ingest(tables, str(tmp_path / "one"))
    build_silver(tables)
    before = tables.count("silver_conversations")
    land(source(spark, message("s1", "c9", at="2026-03-01 10:00:00")), folder)
    stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "s1")).awaitTermination()
    changes = spark.readStream.schema(tables.read("bronze").schema).parquet(tables.path("bronze") + "/_writer=stream-*/*")
    refresh_touched(changes, tables, str(tmp_path / "s2"), every=None).awaitTermination()
    assert latest_versions(tables.read("silver_conversations")).count() == before + 1
    assert latest_messages(tables.read("silver_messages")).count() == tables.count("bronze")
    assert tables.count("gold_sentiment") == before + 1


def test_refresh_equals_batch(spark, tmp_path):
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))
    waves = [two_conversations(spark), later_batch(spark),
             source(spark, message("m7", "c1", at="2026-04-01 00:00:00", body="novo", direction="inbound"))]
    for wave in waves:
        land(wave, folder)
        stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "s1")).awaitTermination()
        schema = tables.read("bronze").schema
        changes = spark.readStream.schema(schema).parquet(tables.path("bronze") + "/*/*")
        refresh_touched(changes, tables, str(tmp_path / "s2"), every=None).awaitTermination()
    everything = waves[0].unionByName(waves[1]).unionByName(waves[2])
    names = ["conversation_id", "total_messages", "duration_minutes", "conversation_outcome"]
    expected = sorted(map(tuple, one_plan(everything).select(*names).collect()))
    state = latest_versions(tables.read("silver_conversations"))
    assert sorted(map(tuple, state.select(*names).collect())) == expected
    assert tables.read("silver_conversations").count() == 3
    assert tables.read("silver_conversations", versions=True).count() == 4  # c1 was computed twice, c2 and c3 once


def all_gold(tables):
    """Rows of all ten Gold tables."""
    names = [*G.row_columns(), *G.grouped_tables()]
    return {n: sorted(map(str, tables.read(tables.place(n)).collect())) for n in names}


def test_build_after_refresh_counts_once(spark, tmp_path):
    """A batch build that follows a refresh, and a refresh that follows a batch build."""
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))
    for wave in (two_conversations(spark), later_batch(spark)):
        land(wave, folder)
        stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "s1")).awaitTermination()
        refresh_touched(changes(tables), tables, str(tmp_path / "s2"), every=None).awaitTermination()
        n = tables.read("bronze").select("conversation_id").distinct().count()
        live = all_gold(tables)
        assert build_gold(tables)["gold_sentiment"] == n == tables.count("gold_sentiment") == tables.count("silver_conversations")
        assert all_gold(tables) == live
        assert tables.count("silver_messages") == tables.count("bronze")
    tables.register()
    assert spark.sql("SELECT count(*) FROM silver_conversations").first()[0] == n


def test_gold_by_deltas_equals_batch(spark, tmp_path):
    """Three waves over clustered tables: new conversations, more messages of old ones, better statuses."""
    data = "/root/testdata/sf0.001"
    source_rows = D.source_messages(spark, data)
    path = str(tmp_path / "messages")
    source_rows.write.parquet(path)
    source_rows = spark.read.parquet(path)
    live = Tables(spark, str(tmp_path / "live"), buckets=8)
    folder = str(tmp_path / "in")
    waves = [source_rows.where("pmod(xxhash64(message_id), 3) = 0"), source_rows.where("pmod(xxhash64(conversation_id), 20) = 1"), source_rows]
    for i, wave in enumerate(waves):
        wave.repartition(2).write.parquet(f"{folder}/{i}")
        arrived = arriving(spark, f"{folder}/*")
        stream_to_bronze(arrived, live, str(tmp_path / "s1")).awaitTermination()
        refresh_touched(changes(live), live, str(tmp_path / "s2"), every=None).awaitTermination()
    batch = Tables(spark, str(tmp_path / "batch"))
    ingest(batch, path)
    build_silver(batch)
    build_gold(batch)
    assert all_gold(live) == all_gold(batch)
    assert len(live.batches("gold_sentiment")) == 4  # the first build, and a batch for each wave: never written anew
    versions = live.read("gold_sentiment", versions=True).count()
    assert live.count("gold_sentiment") < versions < 3 * live.count("gold_sentiment")
    few = source_rows.select("conversation_id").distinct().orderBy("conversation_id").limit(1)
    plan = rows_of(live, "bronze", few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan, plan
    ids = [r[0] for r in few.collect()]
    assert rows_of(live, "bronze", few).count() == source_rows.where(source_rows.conversation_id.isin(ids)).count()


def test_a_leak_stops_gold(spark, tmp_path):
    """A CPF in a text column of Silver that Gold takes over: neither a build nor a refresh writes it; every table stays."""
    from prosa.sources.guard import BrokenRules
    from prosa.streaming.messages import refresh_gold
    tables = Tables(spark, str(tmp_path / "data"))
    path = str(tmp_path / "messages.parquet")
    two_conversations(spark).write.parquet(path)
    ingest(tables, path)
    build_silver(tables)
    build_gold(tables)
    before = all_gold(tables)
    clean = tables.read("silver_conversations")
    for column, planted in (("conversation_outcome", "cpf 383.182.856-01"), ("campaign_id", "a@b.com"), ("agent_id", "38318285601")):
        leaking = clean.withColumn(column, F.lit(planted))
        with pytest.raises(BrokenRules) as refused:
            build_gold(tables, convs=leaking)
        assert sum(refused.value.counts.values()) > 0
        assert all_gold(tables) == before
    build_gold(tables)
    tables.append(clean.withColumn("agent_id", F.lit("38318285601")).withColumn("_version", F.lit(1 << 60)), "silver_conversations", batch=1, writer="w")
    with pytest.raises(BrokenRules):
        refresh_gold(tables, "w", 1)
    assert all_gold(tables) == before
    refresh_gold(tables, "w", 1, guard=False)
    assert {r["agent_id"] for r in tables.read("gold_vendor").collect()} == {"38318285601"}


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    """The last micro-batch runs again, as after a failure before its commit, also when sums are folded."""
    from prosa.streaming.messages import refresh_gold
    folder, tables = str(tmp_path / "in"), Tables(spark, str(tmp_path / "data"))
    for wave in (two_conversations(spark), later_batch(spark)):
        land(wave, folder)
        stream_to_bronze(arriving(spark, folder), tables, str(tmp_path / "s1")).awaitTermination()
        refresh_touched(changes(tables), tables, str(tmp_path / "s2"), every=None).awaitTermination()
    once = all_gold(tables)
    writer, number = max(b for b in tables.batches("silver_conversations") if b[0].startswith("stream-"))
    for fold in (32, 0):
        refresh_gold(tables, writer, number, fold=fold)
        assert all_gold(tables) == once


def test_jobs_keep_apart(spark, tmp_path):
    """Two jobs that append at the same time keep all rows and all columns."""
    one, two = (Tables(spark, str(tmp_path / "data")) for _ in range(2))
    assert one.writer != two.writer
    one.append(spark.range(3).selectExpr("id", "'x' AS a"), "bronze", batch=0)
    two.append(spark.range(3, 5).selectExpr("id", "1 AS b"), "bronze", batch=0)
    held = Tables(spark, one.root).read("bronze")
    assert held.count() == 5 and set(held.columns) == {"id", "a", "b"}
