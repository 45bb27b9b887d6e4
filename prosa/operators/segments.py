"""Segmentation of conversations, and crossings of segments."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import at_least, below, group_of, percent
from prosa.params import CANONICAL, SALE, Profile

DIMENSIONS = (
    "seg_engajamento", "seg_velocidade_resposta", "seg_veiculo", "seg_regiao", "seg_origem",
    "seg_duracao", "seg_qualificacao_lead",
)
COLUMNS = (
    "conversation_id", "conversation_outcome", *DIMENSIONS, "total_messages", "agent_id",
    "campaign_id", "lead_source", "lead_state", "lead_city", "conversation_date",
)
NOTEBOOK_COLUMNS = ("conversation_id", *DIMENSIONS, "agent_id", "campaign_id")
PII = ("has_cpf", "has_email", "has_phone")


def with_segments(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    state = F.upper("lead_state") if profile.upper_state else F.col("lead_state")
    source = F.col("lead_source")
    origin = F.when(source.isNull(), profile.origin_null)
    for name, pattern in profile.origin_segments:
        origin = origin.when(source.rlike(pattern), name)
    with_plate = profile.name != "notebook" and "lead_plate" in df.columns

    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in PII if c in df.columns]
    high, middle, low = profile.quality_segments
    if flags:
        known = sum(flags[1:], flags[0])
        quality = F.when(known >= 2, high).when(known == 1, middle).otherwise(low)
    else:
        quality = F.lit("desconhecido")

    return df.withColumns({
        "seg_engajamento": at_least("total_messages", profile.depth_segments, profile.depth_segment_last),
        "seg_velocidade_resposta": below(
            "avg_response_time_sec", profile.speed_segments, profile.speed_segment_last,
            profile.speed_segment_null),
        "seg_veiculo": F.when(F.col("lead_plate").isNotNull(), "com_veiculo").otherwise("sem_veiculo")
        if with_plate else F.lit("sem_veiculo"),
        "seg_regiao": group_of(state, P.REGIONS, "desconhecido"),
        "seg_origem": origin.otherwise("outros"),
        "seg_duracao": below(
            "duration_minutes", profile.duration_segments, profile.duration_segment_last,
            profile.duration_segment_null),
        "seg_qualificacao_lead": quality,
    })


def gold_segmentation(conversations: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    columns = NOTEBOOK_COLUMNS if profile.name == "notebook" else COLUMNS
    return with_segments(conversations, profile).select(*columns)


def with_hours_segment(df: DataFrame, share: str = "proporcao_horario_comercial") -> DataFrame:
    """Business hours when at least half of the messages are; unknown counts as outside."""
    return df.withColumn(
        "seg_horario", F.when(F.col(share) >= 0.5, "comercial").otherwise("fora_horario"))


def distribution(gold: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows per value of every dimension, in one pass over the table."""
    long = gold.select(*dimensions).unpivot([], list(dimensions), "dimension", "value")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("conversas"))


def crossing(gold: DataFrame, dimensions: Sequence[str], totals: bool = False) -> DataFrame:
    """Conversion per combination of segments; with ``totals`` also per part of it (cube)."""
    grouped = gold.cube(*dimensions) if totals else gold.groupBy(*dimensions)
    counted = grouped.agg(
        F.count(F.lit(1)).alias("conversas"),
        F.count_if(F.col("conversation_outcome") == SALE).alias("vendas"),
    )
    return counted.withColumn("taxa_conversao_pct", percent("vendas", "conversas"))
