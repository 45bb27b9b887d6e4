"""Lead score, conversion funnel and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import at_least, below, clip, mean_to, percent, ratio, round_to, share_of
from prosa.operators.ordering import rank_by
from prosa.params import CANONICAL, Profile

PARTS = ("score_engajamento", "score_resposta", "score_pii", "score_duracao", "score_veiculo")
COLUMNS = (
    "conversation_id", "conversation_outcome", "lead_score", "total_messages",
    "inbound_messages", "outbound_messages", "avg_response_time_sec", "duration_minutes",
    "agent_id", "campaign_id", "lead_source", "lead_state", "conversation_date",
)
NOTEBOOK_COLUMNS = (
    "conversation_id", "lead_score", "conversation_outcome", "total_messages",
    "inbound_messages", "avg_response_time_sec", "has_cpf", "has_email", "has_phone", "agent_id",
    "campaign_id", "lead_source", "conversation_date",
)
PII = ("has_cpf", "has_email", "has_phone")


def with_lead_score(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Score 0..100 and its five parts, kept as columns."""
    flags = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in PII if c in df.columns]
    pii = sum(flags[1:], flags[0]) / len(flags) * 20 if flags else F.lit(0.0)
    engagement = ratio("inbound_messages", "total_messages") * 30
    if profile.score_cap is None:
        engagement = clip(engagement, 0.0, 30.0)
    vehicle = F.lit(0.0)
    if profile.name != "notebook" and "lead_plate" in df.columns:
        vehicle = F.when(F.col("lead_plate").isNotNull(), 10.0).otherwise(0.0)
    parts = df.withColumns({
        "score_engajamento": engagement,
        "score_resposta": below("avg_response_time_sec", profile.score_response,
                                profile.score_response_last, profile.score_response_null),
        "score_pii": pii,
        "score_duracao": at_least("total_messages", profile.score_depth, 0.0),
        "score_veiculo": vehicle,
    })
    total = (F.col("score_engajamento") + F.col("score_resposta") + F.col("score_pii")
             + F.col("score_duracao") + F.col("score_veiculo"))
    if profile.score_cap is not None:
        total = F.least(total, F.lit(profile.score_cap))
    return parts.withColumn("lead_score", round_to(total, 1))


def gold_analytics(conversations: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    columns = NOTEBOOK_COLUMNS if profile.name == "notebook" else COLUMNS
    return with_lead_score(conversations, profile).select(*columns)


def gold_score_parts(conversations: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Per conversation: the five parts and the score, for drill-down and charts."""
    return with_lead_score(conversations, profile).select(
        "conversation_id", "conversation_outcome", *PARTS, "lead_score")


def funnel(conversations: DataFrame) -> DataFrame:
    """Conversations and percent per outcome, largest first; no rows for no input."""
    counted = conversations.groupBy("conversation_outcome").agg(F.count(F.lit(1)).alias("contagem"))
    total = counted.agg(F.sum("contagem")).scalar()
    return counted.select(
        "conversation_outcome", "contagem",
        round_to(F.col("contagem") / total * 100, 2).alias("percentual"),
    ).orderBy(F.desc("contagem"), "conversation_outcome")


def overall_rates(conversations: DataFrame) -> DataFrame:
    """Conversion, proposal and loss rate in percent."""
    outcome = F.col("conversation_outcome")
    return conversations.agg(
        F.count(F.lit(1)).alias("total_conversas"),
        share_of(outcome == P.SALE).alias("taxa_conversao_pct"),
        share_of(outcome == P.PROPOSAL).alias("taxa_propostas_pct"),
        share_of(outcome.isin(*P.LOST)).alias("taxa_perda_pct"),
    )


def campaign_performance(scored: DataFrame) -> DataFrame:
    """Metrics per campaign; the mean lead score too when the column is there."""
    metrics = [
        F.count(F.lit(1)).alias("total_conversas"),
        F.count_if(F.col("conversation_outcome") == P.SALE).alias("vendas"),
        mean_to("total_messages", 1).alias("media_mensagens"),
        mean_to("avg_response_time_sec", 1).alias("media_tempo_resposta"),
    ]
    if "lead_score" in scored.columns:
        metrics.append(mean_to("lead_score", 1).alias("media_lead_score"))
    grouped = scored.groupBy("campaign_id").agg(*metrics)
    return (grouped.withColumn("taxa_conversao_pct", percent("vendas", "total_conversas"))
            .orderBy(F.desc("total_conversas"), "campaign_id"))


def campaign_ranking(campaigns: DataFrame) -> DataFrame:
    return rank_by(campaigns, "taxa_conversao_pct", "posicao")


def score_stats(scored: DataFrame) -> DataFrame:
    """Mean and exact median. Scores have one decimal in 0..100, so the exact percentile keeps at
    most 1,001 counts per task."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_conversas"),
        F.coalesce(mean_to("lead_score", 1), F.lit(0.0)).alias("lead_score_medio"),
        F.coalesce(round_to(F.median("lead_score"), 1), F.lit(0.0)).alias("lead_score_mediano"),
        F.count_distinct("campaign_id").alias("campanhas"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, stddev, min and max of one column, as one row."""
    return df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("stddev"), F.min(column).alias("min"), F.max(column).alias("max"),
    )
