"""The Gold tables together: one wide row for each conversation, and one table of sums for all groups.

Tables with a row for each conversation are columns of one projection. Those with a row for each seller, outcome, campaign,
day or competitor come from one long table of whole-number and decimal sums. Such sums can be taken back exactly: when a
conversation changes, what it counted for before is subtracted and what it counts for now is added, and the rates
and means are worked out anew from the sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import percent, round_to
from prosa.operators import leads, personas, segments, sellers, sentiment
from prosa.params import CANONICAL, Profile

TABLE = "_table"
#: Grouped tables and the column of conversations they are grouped by.
GROUPED = {
    "gold_vendor": "agent_id",
    "gold/funil_conversao": "conversation_outcome",
    "gold/performance_campanha": "campaign_id",
    "gold/analise_temporal": "conversation_date",
    "gold/analise_concorrencia": "competitor_mentioned",
}
#: Counted outcomes, and columns of which sum and number are kept. Doubles are summed as decimals: exact, in any order.
OUTCOMES = {
    "vendas": P.SALE, "ghosting": P.GHOSTING, "perdido_preco": P.LOST_PRICE, "perdido_concorrente": P.LOST_COMPETITOR,
    "propostas": P.PROPOSAL, "negociacao": P.NEGOTIATING,
}
SUMMED = {"msgs": "total_messages", "lead": "inbound_messages", "resp": "avg_response_time_sec", "dur": "duration_minutes", "score": "lead_score"}
MEASURES = ("n", *OUTCOMES, "concorrente", *[f"{s}_{what}" for s in SUMMED for what in ("sum", "n")])


def grouped_tables(profile: Profile = CANONICAL) -> list[str]:
    return ["gold_vendor"] if profile.name == "notebook" else list(GROUPED)


def row_columns(profile: Profile = CANONICAL) -> dict[str, tuple[str, ...]]:
    """The tables with a row for each conversation, and their columns."""
    if profile.name == "notebook":
        return {"gold_sentiment": sentiment.COLUMNS, "gold_personas": personas.NOTEBOOK_COLUMNS,
                "gold_segmentation": segments.NOTEBOOK_COLUMNS, "gold_analytics": leads.NOTEBOOK_COLUMNS}
    return {"gold_sentiment": sentiment.COLUMNS, "gold_personas": personas.COLUMNS, "gold_segmentation": segments.COLUMNS,
            "gold_analytics": leads.COLUMNS, "gold/lead_scoring": ("conversation_id", "conversation_outcome", *leads.PARTS, "lead_score")}


def wide(convs: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Conversations with sentiment, persona, segments and lead score."""
    scored = segments.with_segments(leads.with_lead_score(sentiment.with_sentiment(convs, profile), profile), profile)
    return personas.with_persona_rules(scored) if profile.name == "notebook" else personas.with_persona(scored)


def row_tables(convs: DataFrame, profile: Profile = CANONICAL, *more: str) -> DataFrame:
    """All tables with a row for each conversation as one: ``_table`` names the table, columns of others are null."""
    tables = row_columns(profile)
    members: dict[str, list[str]] = {}
    for name, chosen in tables.items():
        for c in chosen:
            members.setdefault(c, []).append(name)
    tagged = wide(convs, profile).withColumn(TABLE, F.explode(F.array(*[F.lit(name) for name in tables])))
    return tagged.select(TABLE, *[F.col(c) if len(m) == len(tables) else F.when(F.col(TABLE).isin(*m), F.col(c)).alias(c) for c, m in members.items()], *more)


def contributions(convs: DataFrame, profile: Profile = CANONICAL, sign: int = 1) -> DataFrame:
    """What each conversation counts for in each of its groups; ``sign`` -1 takes it back."""
    def whole(condition: Column) -> Column:
        return F.when(condition, F.lit(sign)).otherwise(F.lit(0)).cast("long")

    scored = leads.with_lead_score(convs, profile)
    if "competitor_mentioned" not in scored.columns:
        scored = scored.withColumn("competitor_mentioned", F.lit(None).cast("string"))
    sums = [F.lit(sign).cast("long").alias("n"),
            *[whole(F.col("conversation_outcome") == value).alias(name) for name, value in OUTCOMES.items()],
            whole(F.col("competitor_mentioned").isNotNull()).alias("concorrente")]
    for name, column in SUMMED.items():
        value = F.coalesce(F.col(column).cast("decimal(28,12)"), F.lit(0).cast("decimal(28,12)")) * F.lit(sign)
        sums += [value.cast("decimal(28,12)").alias(f"{name}_sum"), whole(F.col(column).isNotNull()).alias(f"{name}_n")]
    groups = [F.struct(F.lit(name).alias("gold_table"), F.col(GROUPED[name]).cast("string").alias("group_key")) for name in grouped_tables(profile)]
    # A conversation without a competitor is in no competitor's group; other groups may have a null key.
    rows = scored.select(F.explode(F.array(*groups)).alias("_g"), *sums).select("_g.*", *MEASURES)
    return rows.where((F.col("gold_table") != "gold/analise_concorrencia") | F.col("group_key").isNotNull())


def summed(*parts: DataFrame) -> DataFrame:
    """Contributions, or sums of them, added up by group; groups that are left as they were have no row."""
    rows = reduce(DataFrame.unionByName, parts)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    total = rows.groupBy("gold_table", "group_key").agg(*[
        F.sum(m).cast("decimal(38,12)" if kind[m].startswith("decimal") else "long").alias(m) for m in MEASURES])
    return total.where(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in MEASURES]))


def cut(sums: DataFrame, name: str, profile: Profile = CANONICAL) -> DataFrame:
    """A grouped Gold table from the sums of all."""
    key = F.col("group_key")
    rows = sums.where((F.col("gold_table") == name) & (F.col("n") > 0))

    def mean(which: str, places: int | None) -> Column:
        value = F.try_divide(F.col(f"{which}_sum").cast("double"), F.col(f"{which}_n").cast("double"))
        return value if places is None else round_to(round_to(value, 6), places)

    total = F.col("n").alias("total_conversas")
    if name == "gold_vendor" and profile.name == "notebook":
        return sellers.rated_notebook(rows.select(
            key.alias("agent_id"), total, F.col("vendas").alias("vendas_fechadas"), F.col("ghosting").alias("ghosting_count"),
            mean("msgs", None).alias("media_mensagens"), mean("resp", None).alias("media_tempo_resposta_sec"),
            mean("dur", None).alias("media_duracao_min")), profile)
    if name == "gold_vendor":
        return sellers.rated(rows.select(
            key.alias("agent_id"), total, F.col("vendas").alias("vendas_fechadas"), "ghosting", "perdido_preco", "perdido_concorrente",
            F.col("propostas").alias("propostas_enviadas"), F.col("negociacao").alias("em_negociacao"),
            mean("msgs", 1).alias("media_mensagens"), mean("resp", 1).alias("media_tempo_resposta_sec"),
            mean("dur", 1).alias("media_duracao_minutos"), mean("lead", 1).alias("media_msgs_lead"),
            F.col("concorrente").alias("conversas_com_concorrente")), profile)
    if name == "gold/funil_conversao":
        counted = rows.select(key.alias("conversation_outcome"), F.col("n").alias("contagem"))
        everything = counted.agg(F.sum("contagem")).scalar()
        return counted.withColumn("percentual", round_to(F.col("contagem") / everything * 100, 2)).orderBy(F.desc("contagem"), "conversation_outcome")
    if name == "gold/performance_campanha":
        return rows.select(
            key.alias("campaign_id"), total, "vendas", mean("msgs", 1).alias("media_mensagens"), mean("resp", 1).alias("media_tempo_resposta"),
            mean("score", 1).alias("media_lead_score"), percent("vendas", "n").alias("taxa_conversao_pct"),
        ).orderBy(F.desc("total_conversas"), "campaign_id")
    if name == "gold/analise_temporal":
        return rows.select(F.to_date(key).alias("data"), total, "vendas").orderBy("data")
    if name == "gold/analise_concorrencia":
        lost = F.col("perdido_preco") + F.col("perdido_concorrente")
        return rows.select(key.alias("concorrente"), total, round_to(F.try_divide(lost, F.col("n")) * 100, 2).alias("taxa_perda_pct"))
    raise ValueError(f"{name} is no grouped Gold table")
