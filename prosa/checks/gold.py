"""Queries over Gold tables, KPIs and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosa.checks.base import (
    ORACLE,
    CAMPAIGNS, PERSONAS, SCORES, SEGMENTS, SELLERS, SENTIMENT, conversations_of, messages_of,
    notebook_messages, over_conversations, over_silver, query, scored_of,
    segmented_of, stored,
)
from prosa.operators import charts, competition, leads, personas, segments, sellers, sentiment, timing
from prosa.operators.conversations import conversation_extras
from prosa.params import NOTEBOOK, OUTCOMES, SENTIMENT_BINS
from prosa.sources import derived as D

# --- sentiment -------------------------------------------------------------------------------


@query("gold_sentiment", over_conversations(f"SELECT {', '.join(sentiment.COLUMNS)} FROM gold_sentiment", SENTIMENT))
def _(spark, d):
    return sentiment.gold_sentiment(conversations_of(spark, d))


@query("sentiment_parts", over_conversations(
    "SELECT conversation_id, s_outcome, s_engagement, s_response, s_depth FROM sent_parts", SENTIMENT))
def _(spark, d):
    return sentiment.sentiment_parts(conversations_of(spark, d)).select(
        "conversation_id", "s_outcome", "s_engagement", "s_response", "s_depth")


@query("sentiment_stats", over_conversations("""
    SELECT count(*) AS total_conversas, count(*) FILTER (sentimento = 'positivo') AS positivo,
           count(*) FILTER (sentimento = 'neutro') AS neutro, count(*) FILTER (sentimento = 'negativo') AS negativo,
           round(round(avg(sentimento_score), 6), 3) AS score_medio, count(*) AS rows_written FROM gold_sentiment""", SENTIMENT))
def _(spark, d):
    return sentiment.sentiment_stats(sentiment.gold_sentiment(conversations_of(spark, d)))


# --- personas ----------------------------------------------------------------------------------

@query("gold_personas", over_conversations(f"SELECT {', '.join(personas.COLUMNS)} FROM gold_personas", PERSONAS))
def _(spark, d):
    return personas.gold_personas(conversations_of(spark, d))


@query("persona_scores", over_conversations(
    "SELECT conversation_id, fan AS p_fan, dec AS p_dec, neg AS p_neg, pes AS p_pes, ind AS p_ind FROM persona_scores",
    PERSONAS))
def _(spark, d):
    return personas.persona_scores(conversations_of(spark, d)).select(
        "conversation_id", "p_fan", "p_dec", "p_neg", "p_pes", "p_ind")


@query("persona_stats", over_conversations("""
    SELECT count(*) AS total_conversas, count(*) FILTER (persona = 'Fantasma') AS fantasma,
           count(*) FILTER (persona = 'Decidido') AS decidido, count(*) FILTER (persona = 'Negociador') AS negociador,
           count(*) FILTER (persona = 'Pesquisador') AS pesquisador, count(*) FILTER (persona = 'Indeciso') AS indeciso,
           count(*) AS rows_written FROM gold_personas""", PERSONAS))
def _(spark, d):
    return personas.persona_stats(personas.gold_personas(conversations_of(spark, d)))


@query("persona_rules", over_conversations("""
    , p AS (SELECT conversation_id, total_messages, conversation_outcome,
        CASE WHEN conversation_outcome = 'ghosting' AND inbound_messages <= 3 THEN 'fantasma'
             WHEN conversation_outcome = 'venda_fechada' AND total_messages <= 12 THEN 'decidido'
             WHEN total_messages > 15 THEN 'negociador'
             WHEN total_messages BETWEEN 8 AND 20 AND conversation_outcome <> 'venda_fechada' THEN 'pesquisador'
             ELSE 'indeciso' END AS persona FROM convs)
    SELECT conversation_id, persona, CASE WHEN persona IN ('fantasma', 'decidido') THEN 0.9::DOUBLE
           WHEN persona = 'negociador' AND total_messages > 20 THEN 0.7::DOUBLE
           WHEN persona = 'pesquisador' AND total_messages BETWEEN 10 AND 18 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE
           END AS persona_confianca, 'heuristic_v1' AS persona_fatores FROM p"""))
def _(spark, d):
    return personas.gold_personas(conversations_of(spark, d), NOTEBOOK).select(
        "conversation_id", "persona", "persona_confianca", "persona_fatores")


# --- segments ------------------------------------------------------------------------------------

@query("gold_segmentation", over_conversations(f"SELECT {', '.join(segments.COLUMNS)} FROM gold_segments", SEGMENTS))
def _(spark, d):
    return segments.gold_segmentation(conversations_of(spark, d))


@query("segment_distribution", over_conversations(" UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {dim} AS value, count(*) AS conversas FROM gold_segments GROUP BY 2"
    for dim in segments.DIMENSIONS), SEGMENTS))
def _(spark, d):
    return segments.distribution(segments.gold_segmentation(conversations_of(spark, d)))


@query("segment_hours", over_silver("""
    SELECT conversation_id, CASE WHEN avg(meta_is_business_hours::INT) >= 0.5 THEN 'comercial' ELSE 'fora_horario'
           END AS seg_horario FROM silver GROUP BY conversation_id"""))
def _(spark, d):
    return segments.with_hours_segment(conversation_extras(messages_of(spark, d))).select(
        "conversation_id", "seg_horario")


@query("segment_crossing", over_conversations("""
    SELECT seg_regiao, seg_engajamento, count(*) AS conversas,
           count(*) FILTER (conversation_outcome = 'venda_fechada') AS vendas,
           round(count(*) FILTER (conversation_outcome = 'venda_fechada')::DOUBLE / count(*) * 100, 2)
             AS taxa_conversao_pct
    FROM gold_segments GROUP BY seg_regiao, seg_engajamento""", SEGMENTS))
def _(spark, d):
    return segments.crossing(segmented_of(spark, d), ["seg_regiao", "seg_engajamento"])


@query("segment_cube", over_conversations("""
    SELECT seg_regiao, seg_origem, count(*) AS conversas,
           count(*) FILTER (conversation_outcome = 'venda_fechada') AS vendas,
           round(count(*) FILTER (conversation_outcome = 'venda_fechada')::DOUBLE / count(*) * 100, 2)
             AS taxa_conversao_pct
    FROM gold_segments GROUP BY CUBE (seg_regiao, seg_origem)""", SEGMENTS))
def _(spark, d):
    return segments.crossing(segmented_of(spark, d), ["seg_regiao", "seg_origem"], totals=True)


@query("segment_labels_notebook", over_conversations("""
    SELECT conversation_id,
      CASE WHEN total_messages >= 15 THEN 'alto' WHEN total_messages >= 6 THEN 'medio' ELSE 'baixo' END AS seg_engajamento,
      CASE WHEN avg_response_time_sec IS NULL THEN 'desconhecido' WHEN avg_response_time_sec < 120 THEN 'rapido'
           WHEN avg_response_time_sec < 600 THEN 'moderado' ELSE 'lento' END AS seg_velocidade_resposta,
      'sem_veiculo' AS seg_veiculo, seg_regiao,
      CASE WHEN lower(lead_source) LIKE '%google%' THEN 'google' WHEN lower(lead_source) LIKE '%facebook%' THEN 'facebook'
           WHEN lower(lead_source) LIKE '%instagram%' THEN 'instagram' WHEN lower(lead_source) LIKE '%indica%'
           THEN 'indicacao' ELSE 'outros' END AS seg_origem,
      CASE WHEN duration_minutes IS NULL THEN 'desconhecido' WHEN duration_minutes < 1 THEN 'instantanea'
           WHEN duration_minutes < 5 THEN 'flash' WHEN duration_minutes < 60 THEN 'curta'
           WHEN duration_minutes < 1440 THEN 'media' ELSE 'longa' END AS seg_duracao,
      CASE has_cpf::INT + has_email::INT + has_phone::INT WHEN 0 THEN 'baixa' WHEN 1 THEN 'media' ELSE 'alta'
      END AS seg_qualificacao_lead, agent_id, campaign_id FROM gold_segments""", SEGMENTS))
def _(spark, d):
    return segments.gold_segmentation(conversations_of(spark, d), NOTEBOOK)


# --- leads and campaigns ------------------------------------------------------------------------

@query("outcome_funnel", over_conversations("""
    SELECT conversation_outcome, count(*) AS contagem,
           round(count(*)::DOUBLE / (SELECT count(*) FROM convs) * 100, 2) AS percentual
    FROM convs GROUP BY conversation_outcome"""))
def _(spark, d):
    return leads.funnel(conversations_of(spark, d))


@query("overall_rates", over_conversations("""
    SELECT count(*) AS total_conversas,
      round(count(*) FILTER (conversation_outcome = 'venda_fechada')::DOUBLE / count(*) * 100, 2) AS taxa_conversao_pct,
      round(count(*) FILTER (conversation_outcome = 'proposta_enviada')::DOUBLE / count(*) * 100, 2) AS taxa_propostas_pct,
      round(count(*) FILTER (conversation_outcome IN ('perdido_preco', 'perdido_concorrente'))::DOUBLE / count(*) * 100, 2)
        AS taxa_perda_pct FROM convs"""))
def _(spark, d):
    return leads.overall_rates(conversations_of(spark, d))


@query("gold_lead_score", over_conversations(f"SELECT {', '.join(leads.COLUMNS)} FROM scored", SCORES))
def _(spark, d):
    return leads.gold_analytics(conversations_of(spark, d))


@query("lead_score_parts", over_conversations(
    f"SELECT conversation_id, conversation_outcome, {', '.join(leads.PARTS)}, lead_score FROM scored", SCORES))
def _(spark, d):
    return leads.gold_score_parts(conversations_of(spark, d))


@query("lead_score_notebook", over_conversations("""
    SELECT conversation_id, round(least(inbound_messages::DOUBLE / total_messages * 30
      + CASE WHEN avg_response_time_sec IS NULL THEN 5.0::DOUBLE WHEN avg_response_time_sec < 60 THEN 25.0::DOUBLE
             WHEN avg_response_time_sec < 180 THEN 18.0::DOUBLE WHEN avg_response_time_sec < 600 THEN 10.0::DOUBLE
             ELSE 5.0::DOUBLE END
      + (has_cpf::INT + has_email::INT + has_phone::INT)::DOUBLE / 3 * 20
      + CASE WHEN total_messages >= 15 THEN 15.0::DOUBLE WHEN total_messages >= 8 THEN 10.0::DOUBLE
             WHEN total_messages >= 4 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END, 100.0::DOUBLE), 1) AS lead_score
    FROM convs"""))
def _(spark, d):
    return leads.gold_analytics(conversations_of(spark, d), NOTEBOOK).select("conversation_id", "lead_score")


@query("lead_score_stats", over_conversations("""
    SELECT count(*) AS total_conversas, round(round(avg(lead_score), 6), 1) AS lead_score_medio,
           round(median(lead_score), 1) AS lead_score_mediano, count(DISTINCT campaign_id) AS campanhas FROM scored""",
    SCORES))
def _(spark, d):
    return leads.score_stats(scored_of(spark, d))


@query("lead_score_describe", over_conversations("""
    SELECT count(lead_score) AS count, round(avg(lead_score), 6) AS mean, round(stddev_samp(lead_score), 6) AS stddev,
           min(lead_score) AS min, max(lead_score) AS max FROM scored""", SCORES))
def _(spark, d):
    return leads.describe(scored_of(spark, d), "lead_score").select(
        "count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "min", "max")


@query("campaign_performance", over_conversations("SELECT * FROM campaigns", SCORES, CAMPAIGNS))
def _(spark, d):
    return leads.campaign_performance(scored_of(spark, d))


@query("campaign_ranking", over_conversations(
    "SELECT *, rank() OVER (ORDER BY taxa_conversao_pct DESC) AS posicao FROM campaigns", SCORES, CAMPAIGNS))
def _(spark, d):
    return leads.campaign_ranking(stored(spark, leads.campaign_performance(scored_of(spark, d))))


# --- sellers ----------------------------------------------------------------------------------------

@query("seller_metrics", over_conversations("SELECT * FROM sellers", SELLERS))
def _(spark, d):
    return sellers.seller_metrics(conversations_of(spark, d))


@query("seller_stats", over_conversations("""
    SELECT count(*) AS total_vendedores, max(taxa_conversao_pct) AS melhor_taxa_conversao,
           min(taxa_conversao_pct) AS pior_taxa_conversao, round(round(avg(taxa_conversao_pct), 6), 2) AS media_taxa_conversao
    FROM sellers""", SELLERS))
def _(spark, d):
    return sellers.seller_stats(sellers.seller_metrics(conversations_of(spark, d)))


@query("seller_ranking", over_conversations("""
    , rated AS (SELECT agent_id, total_conversas, taxa_conversao_pct, media_duracao_minutos, score_vendedor,
        round(taxa_conversao_pct / (1.0::DOUBLE + media_duracao_minutos / 60.0::DOUBLE), 2) AS score_eficiencia FROM sellers)
    SELECT *, rank() OVER (ORDER BY score_eficiencia DESC) AS posicao_eficiencia,
           rank() OVER (ORDER BY score_vendedor DESC) AS posicao_geral FROM rated""", SELLERS))
def _(spark, d):
    return sellers.seller_ranking(stored(spark, sellers.seller_metrics(conversations_of(spark, d))))


@query("seller_metrics_notebook", over_conversations("""
    , s AS (SELECT agent_id, count(*) AS total_conversas,
        count(*) FILTER (conversation_outcome = 'venda_fechada') AS vendas_fechadas,
        count(*) FILTER (conversation_outcome = 'ghosting') AS ghosting_count,
        avg(avg_response_time_sec) AS t FROM convs GROUP BY agent_id),
    r AS (SELECT *, round(vendas_fechadas::DOUBLE / total_conversas * 100, 2) AS taxa_conversao,
                 round(ghosting_count::DOUBLE / total_conversas * 100, 2) AS taxa_ghosting FROM s)
    SELECT agent_id, total_conversas, vendas_fechadas, ghosting_count, taxa_conversao, taxa_ghosting,
      round(taxa_conversao * 0.5::DOUBLE + (100.0::DOUBLE - taxa_ghosting) * 0.2::DOUBLE
        + CASE WHEN t IS NULL THEN 50.0::DOUBLE WHEN t < 120 THEN 100.0::DOUBLE WHEN t < 300 THEN 75.0::DOUBLE
               WHEN t < 600 THEN 50.0::DOUBLE ELSE 25.0::DOUBLE END * 0.3::DOUBLE, 1) AS score_vendedor FROM r"""))
def _(spark, d):
    return sellers.seller_metrics(conversations_of(spark, d), NOTEBOOK).select(
        "agent_id", "total_conversas", "vendas_fechadas", "ghosting_count", "taxa_conversao", "taxa_ghosting",
        "score_vendedor")


# --- time ----------------------------------------------------------------------------------------------

_SALES = "count(*) FILTER (conversation_outcome = 'venda_fechada')"


@query("daily_volume", over_conversations(
    f"SELECT conversation_date AS data, count(*) AS total_conversas, {_SALES} AS vendas FROM convs GROUP BY 1"))
def _(spark, d):
    return timing.daily_volume(conversations_of(spark, d))


@query("sales_by_weekday", over_conversations(f"""
    SELECT CAST(isodow(first_message_at) - 1 AS INT) AS dia_semana, count(*) AS total_conversas, {_SALES} AS vendas,
           round({_SALES}::DOUBLE / count(*) * 100, 2) AS taxa_conversao_pct FROM convs GROUP BY 1"""))
def _(spark, d):
    return timing.by_weekday(conversations_of(spark, d))


@query("sales_by_hour", over_conversations(f"""
    SELECT CAST(hour(first_message_at) AS INT) AS hora, count(*) AS total_conversas, {_SALES} AS vendas,
           round({_SALES}::DOUBLE / count(*) * 100, 2) AS taxa_conversao_pct FROM convs GROUP BY 1"""))
def _(spark, d):
    return timing.by_hour(conversations_of(spark, d))


@query("time_to_close", over_conversations(f"""
    SELECT {_SALES} AS vendas, round(avg(duration_minutes) FILTER (conversation_outcome = 'venda_fechada'), 6)
      AS tempo_medio_fechamento_min FROM convs"""))
def _(spark, d):
    return timing.time_to_close(conversations_of(spark, d)).select(
        "vendas", F.round("tempo_medio_fechamento_min", 6).alias("tempo_medio_fechamento_min"))


@query("demand_peaks", over_silver("""
    SELECT CAST(timestamp AS DATE) AS data, CAST(hour(timestamp) AS INT) AS hora, count(*) AS mensagens_inbound
    FROM silver WHERE direction = 'inbound' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""))
def _(spark, d):
    return timing.demand_peaks(messages_of(spark, d))


# --- competition ------------------------------------------------------------------------------------------

_LOST = "round(count(*) FILTER (conversation_outcome IN ('perdido_preco', 'perdido_concorrente'))::DOUBLE / count(*) * 100, 2)"
_NAMED = "WHERE competitor_mentioned IS NOT NULL"


@query("competitor_mentions", over_conversations(
    f"SELECT competitor_mentioned AS concorrente, count(*) AS mencoes FROM convs {_NAMED} GROUP BY 1"))
def _(spark, d):
    return competition.mentions(conversations_of(spark, d))


@query("competitor_message_mentions", f"""
    WITH {D.MESSAGES}
    SELECT c.concorrente, count(*) AS mencoes FROM messages
    JOIN (VALUES ('porto seguro'), ('bradesco seguros'), ('bradesco'), ('allianz'), ('azul seguros'), ('hdi'), ('liberty'),
      ('mapfre'), ('suhai'), ('tokio marine'), ('sompo'), ('zurich')) c(concorrente)
      ON contains(lower(message_body), c.concorrente) GROUP BY 1""")
def _(spark, d):
    return competition.message_mentions(notebook_messages(spark, d))


@query("competitor_loss_with_without", over_conversations(f"""
    SELECT competitor_mentioned IS NOT NULL AS menciona_concorrente, count(*) AS total_conversas,
           {_LOST} AS taxa_perda_pct FROM convs GROUP BY 1"""))
def _(spark, d):
    return competition.loss_by_mention(conversations_of(spark, d))


@query("competitor_loss", over_conversations(f"""
    SELECT competitor_mentioned AS concorrente, count(*) AS total_conversas, {_LOST} AS taxa_perda_pct
    FROM convs {_NAMED} GROUP BY 1"""))
def _(spark, d):
    return competition.loss_by_competitor(conversations_of(spark, d))


@query("competitor_by_region", over_conversations(f"""
    SELECT seg_regiao, concorrente, mencoes FROM (
      SELECT seg_regiao, competitor_mentioned AS concorrente, count(*) AS mencoes,
             row_number() OVER (PARTITION BY seg_regiao ORDER BY count(*) DESC, competitor_mentioned) AS rn
      FROM gold_segments {_NAMED} GROUP BY 1, 2) WHERE rn = 1""", SEGMENTS))
def _(spark, d):
    return competition.top_per_region(segmented_of(spark, d))


@query("competitor_outcomes", over_conversations(
    "SELECT competitor_mentioned AS concorrente, " + ", ".join(
        f"count(*) FILTER (conversation_outcome = '{o}') AS {o}" for o in OUTCOMES) + ", count(*) FILTER (conversation_outcome IS NULL OR conversation_outcome NOT IN ("
    + ", ".join(f"'{o}'" for o in OUTCOMES) + f")) AS outros FROM convs {_NAMED} GROUP BY 1"))
def _(spark, d):
    return competition.outcome_cross(conversations_of(spark, d))


# --- charts ---------------------------------------------------------------------------------------------------

_TITLE = ("array_to_string(list_transform(string_split({}, '_'), lambda w: concat(upper(substr(w, 1, 1)), "
          "lower(substr(w, 2)))), ' ')")


def _counts_sql(table: str, column: str) -> str:
    return (f"SELECT {column} AS categoria, count(*) AS quantidade, "
            f"round(count(*)::DOUBLE / (SELECT count(*) FROM {table}) * 100, 1) AS pct, "
            f"{_TITLE.format(column)} AS rotulo FROM {table} GROUP BY {column}")


@query("chart_outcome_counts", over_conversations(_counts_sql("convs", "conversation_outcome")))
def _(spark, d):
    return charts.category_counts(conversations_of(spark, d), "conversation_outcome")


@query("chart_conversion_rate", over_conversations(
    f"SELECT round({_SALES}::DOUBLE / count(*) * 100, 2) AS taxa_conversao_pct FROM convs"))
def _(spark, d):
    return charts.conversion_rate(conversations_of(spark, d))


@query("chart_waterfall", over_conversations("""
    , o AS (SELECT * FROM (VALUES (1, 'proposta_enviada', 'Proposta Enviada'), (2, 'venda_fechada', 'Venda Fechada'),
      (3, 'ghosting', 'Ghosting'), (4, 'perdido_preco', 'Perdido Preco'), (5, 'perdido_concorrente', 'Perdido Concorrente'),
      (6, 'sem_interesse', 'Sem Interesse')) o(ordem, nome, rotulo))
    SELECT 0 AS ordem, 'Total de Leads' AS rotulo, count(*) AS valor, 'absolute' AS medida FROM convs
    UNION ALL
    SELECT ordem, rotulo, CASE WHEN nome = 'venda_fechada' THEN count(*) ELSE -count(*) END,
           CASE WHEN nome = 'venda_fechada' THEN 'absolute' ELSE 'relative' END
    FROM o JOIN convs ON conversation_outcome = nome GROUP BY ordem, nome, rotulo"""))
def _(spark, d):
    return charts.waterfall(conversations_of(spark, d))


@query("chart_waterfall_stored", ORACLE["chart_waterfall"])
def _(spark, d):
    """The same from the funnel, which is counted already."""
    funnel = leads.funnel(conversations_of(spark, d))
    return charts.waterfall(funnel, "contagem")


@query("chart_score_histogram", over_conversations("""
    SELECT CAST(least(floor(lead_score / 5.0::DOUBLE), 19) AS INT) AS faixa,
           least(floor(lead_score / 5.0::DOUBLE), 19) * 5.0::DOUBLE AS inicio, count(*) AS quantidade
    FROM scored GROUP BY 1, 2""", SCORES))
def _(spark, d):
    return charts.histogram(scored_of(spark, d), "lead_score")


@query("chart_sentiment_histogram", over_conversations("""
    , b AS (SELECT CAST(least(floor((sentimento_score + 1.0::DOUBLE) / (2.0::DOUBLE / 30)), 29) AS INT) AS faixa
            FROM gold_sentiment)
    SELECT faixa, faixa * (2.0::DOUBLE / 30) - 1.0::DOUBLE AS inicio, count(*) AS quantidade FROM b GROUP BY faixa""",
    SENTIMENT))
def _(spark, d):
    return charts.histogram(sentiment.with_sentiment(conversations_of(spark, d)), "sentimento_score", SENTIMENT_BINS)


def _box_sql(table: str, group: str, column: str) -> str:
    q = ", ".join(f"round(quantile_cont({column}, {p}), 6) AS {name}" for p, name in
                  ((0, "minimo"), (0.25, "q1"), (0.5, "mediana"), (0.75, "q3"), (1, "maximo")))
    return f"SELECT {group}, count({column}) AS n, {q} FROM {table} GROUP BY {group}"


def _box(df, group, column):
    box = charts.box_statistics(df, group, column)
    return box.select(group, "n", *[F.round(c, 6).alias(c) for c in ("minimo", "q1", "mediana", "q3", "maximo")])


@query("chart_score_box", over_conversations(_box_sql("scored", "conversation_outcome", "lead_score"), SCORES))
def _(spark, d):
    return _box(scored_of(spark, d), "conversation_outcome", "lead_score")


@query("chart_confidence_box", over_conversations(_box_sql("gold_personas", "persona", "persona_confianca"), PERSONAS))
def _(spark, d):
    return _box(personas.with_persona(conversations_of(spark, d)), "persona", "persona_confianca")


@query("chart_score_components", over_conversations(" UNION ALL ".join(
    f"SELECT '{p}' AS componente, round(avg({p}), 6) AS media FROM scored" for p in leads.PARTS), SCORES))
def _(spark, d):
    return charts.mean_components(scored_of(spark, d), leads.PARTS).withColumn("media", F.round("media", 6))


@query("chart_top_campaigns", over_conversations(
    "SELECT * FROM campaigns ORDER BY taxa_conversao_pct DESC, campaign_id LIMIT 15", SCORES, CAMPAIGNS))
def _(spark, d):
    return charts.top_rows(leads.campaign_performance(scored_of(spark, d)), "taxa_conversao_pct", "campaign_id")


@query("chart_campaign_volume", over_conversations(
    "SELECT campaign_id, total_conversas, vendas FROM campaigns ORDER BY total_conversas DESC, campaign_id LIMIT 15",
    SCORES, CAMPAIGNS))
def _(spark, d):
    return charts.top_rows(leads.campaign_performance(scored_of(spark, d)), "total_conversas", "campaign_id").select(
        "campaign_id", "total_conversas", "vendas")


@query("chart_top_sellers", over_conversations("""
    SELECT agent_id, taxa_conversao_pct, taxa_ghosting_pct FROM sellers
    ORDER BY taxa_conversao_pct DESC, agent_id LIMIT 15""", SELLERS))
def _(spark, d):
    return charts.top_rows(sellers.seller_metrics(conversations_of(spark, d)), "taxa_conversao_pct", "agent_id").select(
        "agent_id", "taxa_conversao_pct", "taxa_ghosting_pct")


@query("chart_persona_shares", over_conversations(_counts_sql("gold_personas", "persona"), PERSONAS))
def _(spark, d):
    return charts.category_counts(personas.with_persona(conversations_of(spark, d)), "persona")


@query("chart_sentiment_shares", over_conversations(_counts_sql("gold_sentiment", "sentimento"), SENTIMENT))
def _(spark, d):
    scored = sentiment.gold_sentiment(conversations_of(spark, d)).drop("sentimento")
    return charts.sentiment_shares(scored)


@query("chart_segment_cross", over_conversations("""
    SELECT seg_regiao AS linha, seg_origem AS coluna, count(*) AS quantidade FROM gold_segments GROUP BY 1, 2""", SEGMENTS))
def _(spark, d):
    return charts.cross_counts(segmented_of(spark, d), "seg_regiao", "seg_origem")


@query("chart_fallback_counts", _counts_sql("orders", "o_orderstatus"))
def _(spark, d):
    return charts.fallback_counts(D.table(spark, d, "orders"))


@query("chart_numeric_means", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, round(avg({c}), 6) AS media FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")))
def _(spark, d):
    return charts.numeric_means(D.table(spark, d, "lineitem")).withColumn("media", F.round("media", 6))


@query("chart_kpi_kinds", """
    WITH t AS (SELECT DISTINCT concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Lead-Scoring_' WHEN '2-HIGH' THEN 'funil_de_conversao_'
               WHEN '5-LOW' THEN 'analise_temporal_' ELSE 'tabela_' END, lower(o_orderstatus)) AS name FROM orders)
    SELECT name, CASE WHEN lower(name) LIKE 'lead_scor%' THEN 'lead_scoring' WHEN name LIKE 'funil%' THEN 'funil_conversao'
                      WHEN name LIKE '%temporal%' THEN 'temporal' END AS kpi FROM t""")
def _(spark, d):
    prefix = (F.when(F.col("o_orderpriority") == "1-URGENT", "Lead-Scoring_")
              .when(F.col("o_orderpriority") == "2-HIGH", "funil_de_conversao_")
              .when(F.col("o_orderpriority") == "5-LOW", "analise_temporal_").otherwise("tabela_"))
    names = D.table(spark, d, "orders").select(F.concat(prefix, F.lower("o_orderstatus")).alias("name")).distinct()
    return charts.kpi_kinds(names)


@query("kpi_module_names", """
    SELECT p_partkey, 0 AS ordem, concat('Análise de ', p_name) AS titulo,
           regexp_replace(concat('analise_de_', replace(lower(p_name), ' ', '_')), '[^a-z0-9_]', '', 'g') AS modulo
    FROM part""")
def _(spark, d):
    text = D.table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("# KPIs\n\n## "), F.col("p_partkey").cast("string"), F.lit(". Análise de "), F.col("p_name"),
        F.lit("\n\ntexto\n\n## Notas de Implementação\n")).alias("text"))
    return charts.kpi_modules(text).select("p_partkey", "ordem", "titulo", "modulo")
