"""Lead personas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import clip, points, round_to
from prosa.params import CANONICAL, Profile

# Names in the order that decides ties, and their short forms.
PERSONAS = ("Fantasma", "Decidido", "Negociador", "Pesquisador", "Indeciso")
SHORT = ("fan", "dec", "neg", "pes", "ind")

COLUMNS = (
    "conversation_id", "persona", "persona_confianca", "persona_fatores",
    "conversation_outcome", "total_messages", "inbound_messages", "outbound_messages",
    "competitor_mentioned", "agent_id", "campaign_id", "lead_source", "conversation_date",
)
NOTEBOOK_COLUMNS = (
    "conversation_id", "persona", "persona_confianca", "persona_fatores", "total_messages",
    "conversation_outcome", "agent_id", "campaign_id",
)


def persona_scores(df: DataFrame) -> DataFrame:
    """One score per persona, 0..1, columns ``p_fan`` to ``p_ind``. The order of the additions
    is part of the rule: 0.4+0.2+0.3 is not 0.9 in double arithmetic, and ties depend on it."""
    outcome, total, inbound = (F.col(c) for c in ("conversation_outcome", "total_messages", "inbound_messages"))
    open_deal = outcome.isin(P.PROPOSAL, P.NEGOTIATING)
    return df.withColumns({
        "p_fan": F.when((outcome == P.GHOSTING) & (inbound <= 3), 0.9)
                  .when(outcome == P.GHOSTING, 0.7)
                  .when((inbound <= 1) & (total >= 3), 0.6)
                  .otherwise(0.0),
        "p_dec": F.when((outcome == P.SALE) & (total <= 12), 0.9)
                  .when(outcome == P.SALE, 0.6)
                  .otherwise(0.0),
        "p_neg": clip(
            points(total > 20, 0.4) + points(total > 15, 0.2)
            + points(F.col("competitor_mentioned").isNotNull(), 0.3)
            + points(outcome == P.LOST_PRICE, 0.2) + points(outcome == P.LOST_COMPETITOR, 0.2),
            0.0, 1.0),
        "p_pes": clip(
            points(total.between(8, 20), 0.4)
            + points(outcome.isin(P.PROPOSAL, P.NEGOTIATING, P.GAVE_UP), 0.3)
            + points(inbound >= 4, 0.2),
            0.0, 1.0),
        "p_ind": F.when(open_deal & (total >= 5), 0.5).otherwise(0.2),
    })


def with_persona(df: DataFrame) -> DataFrame:
    """Highest score wins, the earlier persona on ties; confidence is that score."""
    columns = [f"p_{short}" for short in SHORT]
    best = F.greatest(*columns)
    parts = []
    for short in SHORT:
        parts += [F.lit(f"{' ' if parts else ''}{short}="), round_to(F.col(f"p_{short}"), 2).cast("string")]
    (first, name), *rest = zip(columns, PERSONAS)
    confidence = F.col("persona_confianca")
    winner = F.when(F.col(first) == confidence, name)
    for column, name in rest:
        winner = winner.when(F.col(column) == confidence, name)
    return (persona_scores(df).withColumn("persona_confianca", best)
            .withColumns({"persona": winner, "persona_fatores": F.concat(*parts)}))


def with_persona_rules(df: DataFrame) -> DataFrame:
    """The notebook variant: first matching rule, fixed confidences, competitor always unknown."""
    outcome, total, inbound = (
        F.col("conversation_outcome"), F.coalesce("total_messages", F.lit(0)),
        F.coalesce("inbound_messages", F.lit(0)))
    not_sold = outcome.isNull() | (outcome != P.SALE)
    persona = (
        F.when((outcome == P.GHOSTING) & (inbound <= 3), "fantasma")
        .when((outcome == P.SALE) & (total <= 12), "decidido")
        .when(total > 15, "negociador")
        .when(total.between(8, 20) & not_sold, "pesquisador")
        .otherwise("indeciso"))
    named = F.col("persona")
    confidence = (
        F.when((named == "fantasma") & (outcome == P.GHOSTING), 0.9)
        .when((named == "decidido") & (outcome == P.SALE), 0.9)
        .when((named == "negociador") & (total > 20), 0.7)
        .when((named == "pesquisador") & total.between(10, 18), 0.6)
        .otherwise(0.4))
    return (df.withColumn("persona", persona)
            .withColumns({"persona_confianca": confidence, "persona_fatores": F.lit("heuristic_v1")}))


def gold_personas(conversations: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    if profile.name == "notebook":
        return with_persona_rules(conversations).select(*NOTEBOOK_COLUMNS)
    return with_persona(conversations).select(*COLUMNS)


def persona_stats(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count(F.lit(1)).alias("total_conversas"),
        *[F.count_if(F.lower("persona") == name.lower()).alias(name.lower()) for name in PERSONAS],
    ).withColumn("rows_written", F.col("total_conversas"))
