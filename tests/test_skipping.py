"""Loads compare with the batches that may hold an id, and give the same rows as a comparison with all."""

import pytest
from pyspark.sql import functions as F

from fixtures import message, source
from prosa.operators import bronze as B
from prosa.params import NOTEBOOK
from prosa.plans.medallion import ingest, unheld
from prosa.sources import derived as D
from prosa.sources import skipping
from prosa.sources.tables import Tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """Bronze in four batches by time, from two jobs."""
    root = tmp_path_factory.mktemp("skipping")
    path = str(root / "messages")
    B.split_batches(B.cast_timestamp(D.source_messages(spark, DATA)), 4).write.parquet(path)
    rows = spark.read.parquet(path)
    for k in range(4):
        tables = Tables(spark, str(root / "data"), buckets=2 if k else None)
        tables.append(rows.where(F.col("batch") == k).drop("batch"), "bronze")
    return tables, rows


def ids(df):
    return sorted(r[0] for r in df.select("message_id").collect())


def test_bounds_and_filters(spark, loaded):
    tables, rows = loaded
    known = skipping.bounds(tables, "bronze")
    assert sorted(n for _, n in known) == [0, 1, 2, 3] and set(known) == set(tables.batches("bronze"))
    times = sorted(known.values())
    assert all(a[1] <= b[0] for a, b in zip(times, times[1:]))
    assert skipping.newest(tables, "bronze", "timestamp") == rows.agg(F.unix_micros(F.max("timestamp"))).first()[0]
    for k in range(4):
        mine = rows.where(F.col("batch") == k).select("message_id")
        assert k in [n for _, n in skipping.possible(tables, "bronze", mine, "message_id")]  # never missed
        few = mine.orderBy("message_id").limit(3)
        held = set(ids(few))
        assert {n for _, n in skipping.possible(tables, "bronze", few, "message_id")} == {
            r[0] for r in rows.where(F.col("message_id").isin(*held)).select("batch").distinct().collect()}
    absent = spark.range(20_000).select(F.concat(F.lit("nowhere-"), "id").alias("message_id"))
    probes = absent.select(*skipping.probe("message_id"))
    assert probes.count() == 20_000
    assert len(skipping.possible(tables, "bronze", absent.limit(200), "message_id")) <= 1


def test_late_file_reads_one_batch(spark, loaded):
    tables, rows = loaded
    late = rows.where(F.col("batch") == 1).drop("batch").orderBy("message_id").limit(1)
    plan = tables.possible("bronze", late.select("message_id"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_batch_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ids(unheld(tables, late)) == []
    new = B.cast_timestamp(source(spark, message("brand new", "c1", at="1999-01-01 00:00:00")))
    assert skipping.possible(tables, "bronze", new.select("message_id"), "message_id") == []
    assert ids(unheld(tables, new)) == ["brand new"]


@pytest.mark.parametrize("profile", [None, NOTEBOOK])
def test_same_as_full_comparison(spark, loaded, profile):
    tables, rows = loaded
    later = rows.where(F.col("batch") == 3).limit(5).withColumn("timestamp", F.expr("timestamp + interval 400 days"))
    fresh = rows.where(F.col("batch") == 2).limit(4).withColumn("message_id", F.concat(F.lit("x"), "message_id"))
    untimed = rows.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))
    named = untimed.withColumn("message_id", F.concat(F.lit("y"), "message_id"))
    incoming = rows.where("pmod(xxhash64(message_id), 5) = 0").unionByName(later).unionByName(fresh).unionByName(untimed).unionByName(named).drop("batch")
    everything = tables.read("bronze")
    full = B.unseen_ids(incoming, everything) if profile else B.new_rows(incoming, everything)
    got = unheld(tables, incoming, profile) if profile else unheld(tables, incoming)
    assert ids(got) == ids(full) and len(ids(got)) >= 7


def test_batch_without_filter_is_compared(spark, loaded):
    tables, rows = loaded
    writer, number = tables.batches("bronze")[0]
    skipping.forget(spark, tables.path("bronze"), writer, number)
    old = rows.where(F.col("batch") == number).drop("batch").limit(5)
    assert (writer, number) in skipping.possible(tables, "bronze", old.select("message_id"), "message_id")
    assert ids(unheld(tables, old)) == []
    assert skipping.newest(tables, "bronze", "timestamp") == rows.agg(F.unix_micros(F.max("timestamp"))).first()[0]


def test_replaced_table_forgets(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "data"))
    for k in range(2):
        source(spark, message(f"m{k}", "c1")).write.parquet(str(tmp_path / f"in{k}"))
        ingest(tables, str(tmp_path / f"in{k}"), mode="full")
    assert set(skipping.bounds(tables, "bronze")) == {("batch", 0)}
    source(spark, message("m0", "c1"), message("m1", "c1")).write.parquet(str(tmp_path / "both"))
    assert ingest(tables, str(tmp_path / "both"))["rows_written"] == 1
    assert ids(tables.read("bronze")) == ["m0", "m1"]
