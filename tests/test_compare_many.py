"""Loads of many ids: what is compared isn't sorted, and not all of it is looked up or read where that tells nothing more."""

import pytest
from pyspark.sql import functions as F

from prosa.operators import bronze as B
from prosa.plans import medallion
from prosa.sources import skipping
from prosa.sources.tables import Tables

KINDS = "message_id string, n long"


def messages(spark, ids, day=1):
    made = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], KINDS)
    return made.withColumn("timestamp", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0)))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_ids_are_grouped(spark, no_broadcast):
    incoming, held = messages(spark, ["a", "a", "b", "c", None]), messages(spark, ["a", "d", "d", "c", "c", None])
    many, few = (B.compared_ids(incoming, held, kind) for kind in (True, False))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) == [("a", True), ("b", False), ("c", True)]
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_all_ids_meet_only_batches_that_the_first_did_not_find(spark, tmp_path, monkeypatch):
    tables, seen, hits = Tables(spark, str(tmp_path)), [], skipping.hits
    for k in range(3):
        tables.append(messages(spark, [f"{k}-{i}" for i in range(20)]), "bronze", batch=k, writer="w")

    def counted(ids, filters, key):
        seen.append((ids.count(), filters.select("_batch_id").distinct().count()))
        return hits(ids, filters, key)

    monkeypatch.setattr(skipping, "hits", counted)
    monkeypatch.setattr(skipping, "FIRST", 5)
    ids = spark.createDataFrame([(f"{k}-{i}",) for k in range(2) for i in range(20)], "message_id string").coalesce(1)
    found = skipping.possible(tables, "bronze", ids, "message_id")
    assert {("w", 0), ("w", 1)} <= set(found) and seen == [(5, 3), (40, 2)]
    seen.clear()
    monkeypatch.setattr(skipping, "FIRST", 1000)
    every = spark.createDataFrame([(f"{k}-7",) for k in range(3)], "message_id string")
    assert len(skipping.possible(tables, "bronze", every, "message_id")) == 3 and seen == [(3, 3)]


@pytest.mark.parametrize("many", [0, 1000])
def test_a_load_without_new_ids_reads_no_list(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(medallion, "MANY", many)
    tables = Tables(spark, str(tmp_path))
    tables.append(messages(spark, ["a", "b", "c"]), "bronze")

    def load(rows):
        fresh, release = medallion.compared(tables, rows)
        got = sorted(r["message_id"] or "" for r in fresh.collect())
        release()
        return got, fresh._jdf.queryExecution().optimizedPlan().toString()

    got, plan = load(messages(spark, ["a", "b", "b"]))
    assert got == [] and "Join" not in plan
    both = messages(spark, ["a", None]).unionByName(messages(spark, ["b"], day=2))
    assert load(both)[0] == ["", "b"]
    assert load(messages(spark, ["a", "x", "y", "y"]))[0] == ["x", "y", "y"]
