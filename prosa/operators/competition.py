"""Mentions of competitors and their relation to outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import share_of


def _lost():
    return F.col("conversation_outcome").isin(*P.LOST)


def _mentioned(conversations: DataFrame) -> DataFrame:
    return (conversations.where(F.col("competitor_mentioned").isNotNull())
            .withColumnRenamed("competitor_mentioned", "concorrente"))


def mentions(conversations: DataFrame) -> DataFrame:
    """Conversations per competitor (first one mentioned)."""
    return (_mentioned(conversations).groupBy("concorrente")
            .agg(F.count(F.lit(1)).alias("mencoes")).orderBy(F.desc("mencoes"), "concorrente"))


def message_mentions(messages: DataFrame) -> DataFrame:
    """Messages per competitor, counting every one a message names."""
    named = messages.select(F.explode("extracted_competitors").alias("concorrente"))
    return named.groupBy("concorrente").agg(F.count(F.lit(1)).alias("mencoes"))


def loss_by_mention(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy(
        F.col("competitor_mentioned").isNotNull().alias("menciona_concorrente"),
    ).agg(F.count(F.lit(1)).alias("total_conversas"), share_of(_lost()).alias("taxa_perda_pct"))


def loss_by_competitor(conversations: DataFrame) -> DataFrame:
    return _mentioned(conversations).groupBy("concorrente").agg(
        F.count(F.lit(1)).alias("total_conversas"), share_of(_lost()).alias("taxa_perda_pct"))


def top_per_region(segmented: DataFrame) -> DataFrame:
    """Most cited competitor of each region. The window sees one row per region and name."""
    counted = _mentioned(segmented).groupBy("seg_regiao", "concorrente").agg(
        F.count(F.lit(1)).alias("mencoes"))
    order = Window.partitionBy("seg_regiao").orderBy(F.desc("mencoes"), "concorrente")
    return (counted.withColumn("_row", F.row_number().over(order))
            .where(F.col("_row") == 1).drop("_row"))


def outcome_cross(conversations: DataFrame) -> DataFrame:
    """Conversations per competitor and outcome: a column per known outcome, ``outros`` for all other
    and missing ones."""
    known = F.when(F.col("conversation_outcome").isin(*P.OUTCOMES), F.col("conversation_outcome")).otherwise("outros")
    return (_mentioned(conversations).withColumn("_known", known).groupBy("concorrente").pivot("_known", [*P.OUTCOMES, "outros"])
            .agg(F.count(F.lit(1))).na.fill(0))
