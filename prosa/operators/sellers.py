"""Metrics, scores and rankings per seller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import below, clip, mean_to, percent, round_to
from prosa.operators.ordering import rank_by
from prosa.params import CANONICAL, Profile


def seller_metrics(conversations: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    return _notebook(conversations, profile) if profile.name == "notebook" else _canonical(conversations, profile)


def _outcomes(name: str, alias: str):
    return F.count_if(F.col("conversation_outcome") == name).alias(alias)


def _canonical(conversations: DataFrame, profile: Profile) -> DataFrame:
    grouped = conversations.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_conversas"),
        _outcomes(P.SALE, "vendas_fechadas"),
        _outcomes(P.GHOSTING, "ghosting"),
        _outcomes(P.LOST_PRICE, "perdido_preco"),
        _outcomes(P.LOST_COMPETITOR, "perdido_concorrente"),
        _outcomes(P.PROPOSAL, "propostas_enviadas"),
        _outcomes(P.NEGOTIATING, "em_negociacao"),
        mean_to("total_messages", 1).alias("media_mensagens"),
        mean_to("avg_response_time_sec", 1).alias("media_tempo_resposta_sec"),
        mean_to("duration_minutes", 1).alias("media_duracao_minutos"),
        mean_to("inbound_messages", 1).alias("media_msgs_lead"),
        F.count("competitor_mentioned").alias("conversas_com_concorrente"),
    )
    return rated(grouped, profile)


def rated(grouped: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Rates and score from the sums of each seller."""
    rates = grouped.withColumns({
        "taxa_conversao_pct": percent("vendas_fechadas", "total_conversas"),
        "taxa_ghosting_pct": percent("ghosting", "total_conversas"),
    })
    # The band as a whole carries the 0.3, so 79 is the highest score reachable.
    speed = below("media_tempo_resposta_sec", profile.seller_speed, profile.seller_speed_last,
                  profile.seller_speed_null)
    score = (F.col("taxa_conversao_pct") * 0.5
             + (100 - clip(F.col("taxa_ghosting_pct"), 0.0, 100.0)) * 0.2 + speed * 0.3)
    return (rates.withColumn("score_vendedor", round_to(score, 1))
            .orderBy(F.desc("total_conversas"), "agent_id"))


def _notebook(conversations: DataFrame, profile: Profile) -> DataFrame:
    grouped = conversations.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_conversas"),
        _outcomes(P.SALE, "vendas_fechadas"),
        _outcomes(P.GHOSTING, "ghosting_count"),
        F.avg("total_messages").alias("media_mensagens"),
        F.avg("avg_response_time_sec").alias("media_tempo_resposta_sec"),
        F.avg("duration_minutes").alias("media_duracao_min"),
    )
    return rated_notebook(grouped, profile)


def rated_notebook(grouped: DataFrame, profile: Profile) -> DataFrame:
    rates = grouped.withColumns({
        "taxa_conversao": percent("vendas_fechadas", "total_conversas"),
        "taxa_ghosting": percent("ghosting_count", "total_conversas"),
    })
    speed = below("media_tempo_resposta_sec", profile.seller_speed, profile.seller_speed_last,
                  profile.seller_speed_null)
    score = F.col("taxa_conversao") * 0.50 + (100.0 - F.col("taxa_ghosting")) * 0.20 + speed * 0.30
    return rates.withColumn("score_vendedor", round_to(score, 1))


def seller_stats(sellers: DataFrame) -> DataFrame:
    rate = "taxa_conversao_pct"
    return sellers.agg(
        F.count(F.lit(1)).alias("total_vendedores"),
        F.coalesce(round_to(F.max(rate), 2), F.lit(0.0)).alias("melhor_taxa_conversao"),
        F.coalesce(round_to(F.min(rate), 2), F.lit(0.0)).alias("pior_taxa_conversao"),
        F.coalesce(mean_to(rate, 2), F.lit(0.0)).alias("media_taxa_conversao"),
    )


def seller_ranking(sellers: DataFrame) -> DataFrame:
    """Efficiency and ranks. The KPI text names conversion and mean duration without a formula;
    conversion divided by one plus the mean hours is this library's choice."""
    hours = F.coalesce(F.col("media_duracao_minutos"), F.lit(0.0)) / 60.0
    rated = sellers.select(
        "agent_id", "total_conversas", "taxa_conversao_pct", "media_duracao_minutos", "score_vendedor",
        round_to(F.col("taxa_conversao_pct") / (1.0 + hours), 2).alias("score_eficiencia"))
    ranked = rank_by(rated, "score_eficiencia", "posicao_eficiencia")
    return rank_by(ranked, "score_vendedor", "posicao_geral")
