"""Comparing ids must not sort whole messages: the memory of a task would grow with them."""

import pytest
from pyspark.sql import functions as F

from prosa.operators import bronze as B


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(spark, ids):
    made = spark.createDataFrame([(i, f"body {i}") for i in ids], "message_id string, message_body string")
    return made.withColumn("timestamp", F.timestamp_micros(F.lit(0).cast("long")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unseen_ids_without_sort_of_messages(spark, no_broadcast):
    fresh = B.unseen_ids(rows(spark, ["a", "a", "b", "c", "c", None]), rows(spark, ["a", "a", "d", None]))
    assert sorted(r["message_id"] or "" for r in fresh.collect()) == ["", "b", "c", "c"]
    text = plan(fresh)
    assert "ShuffledHashJoin" in text and "HashAggregate" not in text
