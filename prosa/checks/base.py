"""Registry of the queries and of the SQL another engine checks them with."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosa.operators import bronze, conversations, leads, segments, silver
from prosa.params import NOTEBOOK
from prosa.session import scratch_dir
from prosa.sources import derived as D
from prosa.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# --- inputs shared by the queries ---------------------------------------------------------

def bronze_of(spark: SparkSession, d: str) -> DataFrame:
    return bronze.to_bronze(D.source_messages(spark, d), "events.parquet")


def messages_of(spark: SparkSession, d: str) -> DataFrame:
    return silver.silver_messages(bronze_of(spark, d))


def conversations_of(spark: SparkSession, d: str) -> DataFrame:
    return conversations.aggregate(messages_of(spark, d))


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    return leads.with_lead_score(conversations_of(spark, d))


def segmented_of(spark: SparkSession, d: str) -> DataFrame:
    return segments.with_segments(conversations_of(spark, d))


def notebook_source(spark: SparkSession, d: str) -> DataFrame:
    """The message source in the notebook variant's layout."""
    df = D.source_messages(spark, d)
    return df.withColumnRenamed("status", "message_status").withColumn(
        "lead_source", F.get_json_object("metadata", "$.lead_source")).drop("conversation_outcome")


def notebook_messages(spark: SparkSession, d: str) -> DataFrame:
    typed = bronze.stamp(bronze.parse_metadata(notebook_source(spark, d), NOTEBOOK), "events.parquet")
    return silver.silver_messages(typed, NOTEBOOK)


def notebook_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.aggregate_notebook(notebook_messages(spark, d))


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table written to the shared scratch folder and read back, as Gold tables are before they
    are ranked: what built it then runs once."""
    tables = Tables(spark, scratch_dir(spark, "stored"))
    tables.overwrite(df, f"{tables.root}/table")
    return tables.read(f"{tables.root}/table")


# --- the same inputs in SQL ------------------------------------------------------------------

BRONZE = """
bronze AS (
  SELECT message_id, conversation_id, ts AS timestamp, direction, sender_phone, sender_name, message_type,
         message_body, status, channel, campaign_id, agent_id, conversation_outcome, metadata,
         json_extract_string(metadata, '$.device') AS meta_device,
         json_extract_string(metadata, '$.city') AS meta_city,
         json_extract_string(metadata, '$.state') AS meta_state,
         CAST(json_extract_string(metadata, '$.response_time_sec') AS BIGINT) AS meta_response_time_sec,
         CAST(json_extract_string(metadata, '$.is_business_hours') AS BOOLEAN) AS meta_is_business_hours,
         json_extract_string(metadata, '$.lead_source') AS meta_lead_source
  FROM messages)
"""

CLEAN = """
ranked AS (
  SELECT *, row_number() OVER (
           PARTITION BY conversation_id, sender_phone, message_body, direction, timestamp
           ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2
                                WHEN 'read' THEN 3 ELSE 0 END DESC, message_id) AS rn
  FROM bronze),
cleaned AS (
  SELECT * EXCLUDE (rn), starts_with(message_body, '[audio transcrito]') AS is_audio_transcription,
         CASE WHEN starts_with(message_body, '[audio transcrito]')
              THEN trim(substr(message_body, length('[audio transcrito]') + 1)) ELSE message_body
         END AS message_body_normalized
  FROM ranked WHERE rn = 1)
"""

# RE2's \b is ASCII, so word edges are spelled out as a neighbour that is not a letter or number.
_PRE, _POST = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
CPF_CORE = r"\p{Nd}{3}\.?\p{Nd}{3}\.?\p{Nd}{3}-?\p{Nd}{2}"
CEP_CORE = r"\p{Nd}{5}-?\p{Nd}{3}"
EMAIL_CORE = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}"
PLATE_CORE = r"[A-Za-z]{3}\p{Nd}[A-Za-z0-9]\p{Nd}{2}"
PHONE_CORE = r"\(?\p{Nd}{2}\)?[\s\p{Z}]?\p{Nd}{4,5}-?\p{Nd}{4}"
NAMES_CORE = ("(?i:porto seguro|bradesco seguros|bradesco seguro|itaú seguros|itau seguros|allianz|hdi seguros|"
              "hdi seguro|mapfre|tokio marine|suhai|azul seguros|azul seguro)")


def _first(body: str, core: str) -> str:
    return f"nullif(regexp_extract({body}, '{_PRE}({core}){_POST}', 1), '')"


def entity_columns(body: str) -> str:
    """SQL for the first entities and flags of a text column."""
    hashed = "substr(sha256({}), 1, 16)"
    cpf, email, cep = _first(body, CPF_CORE), _first(body, EMAIL_CORE), _first(body, CEP_CORE)
    return f"""
      {hashed.format(cpf)} AS extracted_cpf_hash,
      {hashed.format(f'lower({email})')} AS extracted_email_hash,
      regexp_replace({cep}, '[^0-9]', '', 'g') AS extracted_cep,
      upper({_first(body, PLATE_CORE)}) AS extracted_plate,
      lower({_first(body, NAMES_CORE)}) AS extracted_competitor,
      coalesce({cpf} IS NOT NULL, false) AS pii_cpf_found,
      coalesce({email} IS NOT NULL, false) AS pii_email_found,
      coalesce({cep} IS NOT NULL, false) AS pii_cep_found,
      coalesce(regexp_matches({body}, '{PHONE_CORE}{_POST}'), false) AS pii_phone_found"""


def masked(body: str) -> str:
    """SQL for the masked text. Each edge is consumed by the match and put back; every step runs
    twice, since neighbours share an edge."""
    text = body
    for core, tag in ((CPF_CORE, "CPF"), (EMAIL_CORE, "EMAIL"), (CEP_CORE, "CEP")):
        for _ in range(2):
            text = (rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}_]){core}($|[^\p{{L}}\p{{N}}_])', "
                    rf"'\1[{tag}_MASKED]\2', 'g')")
    for _ in range(2):
        text = (rf"regexp_replace({text}, '{PHONE_CORE}($|[^\p{{L}}\p{{N}}_])', "
                rf"'[PHONE_MASKED]\1', 'g')")
    return text


SILVER = f"""
silver AS (
  SELECT *, {masked('message_body_normalized')} AS message_body_masked,
         {entity_columns('message_body_normalized')}
  FROM cleaned)
"""

CONVERSATIONS = """
starts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, message_id) AS rn
                 FROM silver) WHERE rn = 1),
leads AS (
  SELECT conversation_id, sender_phone AS lead_phone, sender_name AS lead_name
  FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, message_id) AS rn
        FROM silver WHERE direction = 'inbound') WHERE rn = 1),
sums AS (
  SELECT conversation_id, min(timestamp) AS first_message_at, max(timestamp) AS last_message_at,
         count(*) AS total_messages,
         count(*) FILTER (direction = 'inbound') AS inbound_messages,
         count(*) FILTER (direction = 'outbound') AS outbound_messages,
         count(*) FILTER (message_type = 'audio') AS audio_messages,
         count(*) FILTER (message_type = 'image') AS image_messages,
         count(*) FILTER (is_audio_transcription) AS audio_transcriptions,
         bool_or(pii_cpf_found) AS has_cpf, bool_or(pii_email_found) AS has_email,
         bool_or(pii_cep_found) AS has_cep, bool_or(pii_phone_found) AS has_phone,
         first(extracted_plate ORDER BY timestamp, message_id) FILTER (extracted_plate IS NOT NULL) AS lead_plate,
         first(extracted_cep ORDER BY timestamp, message_id) FILTER (extracted_cep IS NOT NULL) AS lead_cep,
         first(extracted_competitor ORDER BY timestamp, message_id)
           FILTER (extracted_competitor IS NOT NULL) AS competitor_mentioned,
         avg(meta_response_time_sec) AS avg_response_time_sec
  FROM silver GROUP BY conversation_id),
convs AS (
  SELECT s.*, f.conversation_outcome, f.agent_id, f.campaign_id, f.channel, f.meta_lead_source AS lead_source,
         f.meta_city AS lead_city, f.meta_state AS lead_state, f.meta_device AS lead_device,
         l.lead_phone, l.lead_name,
         CAST(date_diff('second', first_message_at, last_message_at) AS DOUBLE) / 60.0::DOUBLE AS duration_minutes,
         CAST(first_message_at AS DATE) AS conversation_date
  FROM sums s JOIN starts f USING (conversation_id) LEFT JOIN leads l USING (conversation_id))
"""

SENTIMENT = """
sent_parts AS (
  SELECT *,
    CASE conversation_outcome WHEN 'venda_fechada' THEN 0.9::DOUBLE WHEN 'em_negociacao' THEN 0.5::DOUBLE
      WHEN 'proposta_enviada' THEN 0.4::DOUBLE WHEN 'perdido_preco' THEN -0.3::DOUBLE
      WHEN 'perdido_concorrente' THEN -0.4::DOUBLE WHEN 'desistencia_lead' THEN -0.6::DOUBLE
      WHEN 'ghosting' THEN -0.7::DOUBLE ELSE 0.0::DOUBLE END AS s_outcome,
    least(greatest((inbound_messages::DOUBLE / total_messages - 0.3::DOUBLE) * 2.0::DOUBLE, -1.0::DOUBLE), 1.0::DOUBLE)
      AS s_engagement,
    CASE WHEN avg_response_time_sec IS NULL THEN 0.0::DOUBLE WHEN avg_response_time_sec < 60 THEN 0.8::DOUBLE
      WHEN avg_response_time_sec < 180 THEN 0.4::DOUBLE WHEN avg_response_time_sec < 600 THEN 0.0::DOUBLE
      WHEN avg_response_time_sec < 1800 THEN -0.3::DOUBLE ELSE -0.6::DOUBLE END AS s_response,
    CASE WHEN total_messages >= 15 THEN 0.6::DOUBLE WHEN total_messages >= 8 THEN 0.3::DOUBLE
      WHEN total_messages >= 4 THEN 0.0::DOUBLE ELSE -0.4::DOUBLE END AS s_depth
  FROM convs),
sent_scored AS (
  SELECT *, round(s_outcome * 0.5::DOUBLE + s_engagement * 0.2::DOUBLE + s_response * 0.15::DOUBLE
                  + s_depth * 0.15::DOUBLE, 3) AS sentimento_score
  FROM sent_parts),
gold_sentiment AS (
  SELECT *, CASE WHEN sentimento_score > 0.2::DOUBLE THEN 'positivo'
                 WHEN sentimento_score < -0.2::DOUBLE THEN 'negativo' ELSE 'neutro' END AS sentimento,
         concat('outcome=', CAST(round(s_outcome, 2) AS VARCHAR), ' eng=', CAST(round(s_engagement, 2) AS VARCHAR),
                ' resp=', CAST(round(s_response, 2) AS VARCHAR), ' dur=', CAST(round(s_depth, 2) AS VARCHAR))
           AS sentimento_fatores
  FROM sent_scored)
"""

PERSONAS = """
persona_scores AS (
  SELECT *,
    CASE WHEN conversation_outcome = 'ghosting' AND inbound_messages <= 3 THEN 0.9::DOUBLE
         WHEN conversation_outcome = 'ghosting' THEN 0.7::DOUBLE
         WHEN inbound_messages <= 1 AND total_messages >= 3 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS fan,
    CASE WHEN conversation_outcome = 'venda_fechada' AND total_messages <= 12 THEN 0.9::DOUBLE
         WHEN conversation_outcome = 'venda_fechada' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS dec,
    least(CASE WHEN total_messages > 20 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN total_messages > 15 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN competitor_mentioned IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN conversation_outcome = 'perdido_preco' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN conversation_outcome = 'perdido_concorrente' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END,
        1.0::DOUBLE) AS neg,
    least(CASE WHEN total_messages BETWEEN 8 AND 20 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN conversation_outcome IN ('proposta_enviada', 'em_negociacao', 'desistencia_lead')
               THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN inbound_messages >= 4 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS pes,
    CASE WHEN conversation_outcome IN ('proposta_enviada', 'em_negociacao') AND total_messages >= 5
         THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS ind
  FROM convs),
gold_personas AS (
  SELECT *, greatest(fan, dec, neg, pes, ind) AS persona_confianca,
    CASE greatest(fan, dec, neg, pes, ind) WHEN fan THEN 'Fantasma' WHEN dec THEN 'Decidido'
         WHEN neg THEN 'Negociador' WHEN pes THEN 'Pesquisador' ELSE 'Indeciso' END AS persona,
    concat('fan=', CAST(round(fan, 2) AS VARCHAR), ' dec=', CAST(round(dec, 2) AS VARCHAR),
           ' neg=', CAST(round(neg, 2) AS VARCHAR), ' pes=', CAST(round(pes, 2) AS VARCHAR),
           ' ind=', CAST(round(ind, 2) AS VARCHAR)) AS persona_fatores
  FROM persona_scores)
"""

SEGMENTS = """
gold_segments AS (
  SELECT *,
    CASE WHEN total_messages >= 15 THEN 'alto' WHEN total_messages >= 6 THEN 'medio' ELSE 'baixo' END AS seg_engajamento,
    CASE WHEN avg_response_time_sec IS NULL THEN 'sem_dados' WHEN avg_response_time_sec < 120 THEN 'rapido'
         WHEN avg_response_time_sec < 600 THEN 'moderado' ELSE 'lento' END AS seg_velocidade_resposta,
    CASE WHEN lead_plate IS NOT NULL THEN 'com_veiculo' ELSE 'sem_veiculo' END AS seg_veiculo,
    CASE WHEN lead_state IN ('SP','RJ','MG','ES') THEN 'sudeste' WHEN lead_state IN ('PR','SC','RS') THEN 'sul'
         WHEN lead_state IN ('BA','PE','CE','MA','PB','RN','AL','SE','PI') THEN 'nordeste'
         WHEN lead_state IN ('DF','GO','MT','MS') THEN 'centro_oeste'
         WHEN lead_state IN ('AM','PA','AC','RO','RR','AP','TO') THEN 'norte' ELSE 'desconhecido' END AS seg_regiao,
    CASE WHEN lead_source IS NULL THEN 'desconhecido' WHEN lead_source ILIKE '%google%' THEN 'google'
         WHEN lead_source ILIKE '%facebook%' OR lead_source ILIKE '%meta%' THEN 'facebook'
         WHEN lead_source ILIKE '%instagram%' THEN 'instagram'
         WHEN lead_source ILIKE '%indicacao%' OR lead_source ILIKE '%referral%' THEN 'indicacao'
         ELSE 'outros' END AS seg_origem,
    CASE WHEN duration_minutes IS NULL THEN 'instantanea' WHEN duration_minutes < 5 THEN 'flash'
         WHEN duration_minutes < 60 THEN 'curta' WHEN duration_minutes < 1440 THEN 'media' ELSE 'longa' END AS seg_duracao,
    CASE has_cpf::INT + has_email::INT + has_phone::INT WHEN 0 THEN 'baixa_qualificacao'
         WHEN 1 THEN 'media_qualificacao' ELSE 'alta_qualificacao' END AS seg_qualificacao_lead
  FROM convs)
"""

SCORES = """
score_parts AS (
  SELECT *, inbound_messages::DOUBLE / total_messages * 30 AS score_engajamento,
    CASE WHEN avg_response_time_sec IS NULL THEN 5.0::DOUBLE WHEN avg_response_time_sec < 60 THEN 25.0::DOUBLE
         WHEN avg_response_time_sec < 180 THEN 20.0::DOUBLE WHEN avg_response_time_sec < 600 THEN 12.0::DOUBLE
         WHEN avg_response_time_sec < 1800 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS score_resposta,
    (has_cpf::INT + has_email::INT + has_phone::INT)::DOUBLE / 3 * 20 AS score_pii,
    CASE WHEN total_messages >= 15 THEN 15.0::DOUBLE WHEN total_messages >= 10 THEN 12.0::DOUBLE
         WHEN total_messages >= 6 THEN 8.0::DOUBLE WHEN total_messages >= 3 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE
    END AS score_duracao,
    CASE WHEN lead_plate IS NOT NULL THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score_veiculo
  FROM convs),
scored AS (
  SELECT *, round(score_engajamento + score_resposta + score_pii + score_duracao + score_veiculo, 1) AS lead_score
  FROM score_parts)
"""

CAMPAIGNS = """
campaigns AS (
  SELECT campaign_id, count(*) AS total_conversas,
         count(*) FILTER (conversation_outcome = 'venda_fechada') AS vendas,
         round(round(avg(total_messages), 6), 1) AS media_mensagens,
         round(round(avg(avg_response_time_sec), 6), 1) AS media_tempo_resposta,
         round(round(avg(lead_score), 6), 1) AS media_lead_score,
         round(count(*) FILTER (conversation_outcome = 'venda_fechada')::DOUBLE / count(*) * 100, 2) AS taxa_conversao_pct
  FROM scored GROUP BY campaign_id)
"""

SELLERS = """
seller_sums AS (
  SELECT agent_id, count(*) AS total_conversas,
         count(*) FILTER (conversation_outcome = 'venda_fechada') AS vendas_fechadas,
         count(*) FILTER (conversation_outcome = 'ghosting') AS ghosting,
         count(*) FILTER (conversation_outcome = 'perdido_preco') AS perdido_preco,
         count(*) FILTER (conversation_outcome = 'perdido_concorrente') AS perdido_concorrente,
         count(*) FILTER (conversation_outcome = 'proposta_enviada') AS propostas_enviadas,
         count(*) FILTER (conversation_outcome = 'em_negociacao') AS em_negociacao,
         round(round(avg(total_messages), 6), 1) AS media_mensagens,
         round(round(avg(avg_response_time_sec), 6), 1) AS media_tempo_resposta_sec,
         round(round(avg(duration_minutes), 6), 1) AS media_duracao_minutos,
         round(round(avg(inbound_messages), 6), 1) AS media_msgs_lead,
         count(competitor_mentioned) AS conversas_com_concorrente
  FROM convs GROUP BY agent_id),
seller_rates AS (
  SELECT *, round(vendas_fechadas::DOUBLE / total_conversas * 100, 2) AS taxa_conversao_pct,
         round(ghosting::DOUBLE / total_conversas * 100, 2) AS taxa_ghosting_pct
  FROM seller_sums),
sellers AS (
  SELECT *, round(taxa_conversao_pct * 0.5::DOUBLE + (100 - taxa_ghosting_pct) * 0.2::DOUBLE
                  + CASE WHEN media_tempo_resposta_sec IS NULL THEN 10.0::DOUBLE
                         WHEN media_tempo_resposta_sec < 120 THEN 30.0::DOUBLE
                         WHEN media_tempo_resposta_sec < 300 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END * 0.3::DOUBLE,
                  1) AS score_vendedor
  FROM seller_rates)
"""

TO_CLEAN = ",".join((D.MESSAGES, BRONZE, CLEAN))
TO_SILVER = ",".join((TO_CLEAN, SILVER))
TO_CONVERSATIONS = ",".join((TO_SILVER, CONVERSATIONS))


def over_messages(select: str) -> str:
    return f"WITH {D.MESSAGES}, {BRONZE} {select}"


def over_cleaned(select: str) -> str:
    return f"WITH {TO_CLEAN} {select}"


def over_silver(select: str) -> str:
    return f"WITH {TO_SILVER} {select}"


def over_conversations(select: str, *more: str) -> str:
    return f"WITH {','.join((TO_CONVERSATIONS, *more))} {select}"
