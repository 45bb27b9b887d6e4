"""Volumes and sales over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.functions.columns import percent
from prosa.params import SALE



def _counts(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("total_conversas"),
        F.count_if(F.col("conversation_outcome") == SALE).alias("vendas"),
    )


def daily_volume(conversations: DataFrame) -> DataFrame:
    """New conversations per day, in time order."""
    return _counts(conversations.groupBy(F.col("conversation_date").alias("data"))).orderBy("data")


def by_weekday(conversations: DataFrame) -> DataFrame:
    """Per weekday, Monday = 0."""
    counted = _counts(conversations.groupBy(F.weekday("first_message_at").alias("dia_semana")))
    return counted.withColumn("taxa_conversao_pct", percent("vendas", "total_conversas"))


def by_hour(conversations: DataFrame) -> DataFrame:
    counted = _counts(conversations.groupBy(F.hour("first_message_at").alias("hora")))
    return counted.withColumn("taxa_conversao_pct", percent("vendas", "total_conversas"))


def time_to_close(conversations: DataFrame) -> DataFrame:
    """Mean minutes from first to last message of sold conversations."""
    sold = F.col("conversation_outcome") == SALE
    return conversations.agg(
        F.count_if(sold).alias("vendas"),
        F.avg(F.when(sold, F.col("duration_minutes"))).alias("tempo_medio_fechamento_min"),
    )


def demand_peaks(messages: DataFrame, top: int = 10) -> DataFrame:
    """The days and hours with most inbound messages."""
    inbound = messages.where(F.col("direction") == "inbound")
    slots = inbound.groupBy(
        F.to_date("timestamp").alias("data"), F.hour("timestamp").alias("hora"),
    ).agg(F.count(F.lit(1)).alias("mensagens_inbound"))
    return slots.orderBy(F.desc("mensagens_inbound"), "data", "hora").limit(top)
