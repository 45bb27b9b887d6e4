"""Sentiment of a conversation from outcome, engagement, response time and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import at_least, below, clip, lookup, mean_to, ratio, round_to
from prosa.params import CANONICAL, Profile

COLUMNS = (
    "conversation_id", "conversation_outcome", "sentimento_score", "sentimento",
    "sentimento_fatores", "total_messages", "avg_response_time_sec", "agent_id", "campaign_id",
    "conversation_date",
)


def sentiment_parts(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """The four parts, each in -1..1, as columns."""
    return df.withColumns({
        "s_outcome": lookup("conversation_outcome", P.OUTCOME_SCORE, 0.0),
        "s_engagement": clip((ratio("inbound_messages", "total_messages") - 0.3) * 2.0, -1.0, 1.0),
        "s_response": below("avg_response_time_sec", profile.sentiment_response,
                            profile.sentiment_response_last, profile.sentiment_response_null),
        "s_depth": at_least("total_messages", profile.sentiment_depth, profile.sentiment_depth_last),
    })


def sentiment_label(score, cut: float = CANONICAL.sentiment_cut):
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score > cut, "positivo").when(score < -cut, "negativo").otherwise("neutro")


def with_sentiment(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    w_outcome, w_engagement, w_response, w_depth = profile.sentiment_weights
    score = (F.col("s_outcome") * w_outcome + F.col("s_engagement") * w_engagement
             + F.col("s_response") * w_response + F.col("s_depth") * w_depth)

    def text(name: str):
        return round_to(F.col(name), 2).cast("string")

    scored = sentiment_parts(df, profile).withColumn("sentimento_score", round_to(score, 3))
    return scored.withColumns({
        "sentimento": sentiment_label("sentimento_score", profile.sentiment_cut),
        "sentimento_fatores": F.concat(
            F.lit("outcome="), text("s_outcome"), F.lit(" eng="), text("s_engagement"),
            F.lit(" resp="), text("s_response"), F.lit(" dur="), text("s_depth")),
    })


def gold_sentiment(conversations: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    return with_sentiment(conversations, profile).select(*COLUMNS)


def sentiment_stats(gold: DataFrame) -> DataFrame:
    label = F.col("sentimento")
    return gold.agg(
        F.count(F.lit(1)).alias("total_conversas"),
        F.count_if(label == "positivo").alias("positivo"),
        F.count_if(label == "neutro").alias("neutro"),
        F.count_if(label == "negativo").alias("negativo"),
        F.coalesce(mean_to("sentimento_score", 3), F.lit(0.0)).alias("score_medio"),
    ).withColumn("rows_written", F.col("total_conversas"))
