"""Clean messages to one row per conversation, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.functions.columns import earliest, hash16
from prosa.params import CANONICAL, GHOSTING, NEGOTIATING, SALE, Profile

COLUMNS = (
    "conversation_id", "first_message_at", "last_message_at", "total_messages",
    "inbound_messages", "outbound_messages", "audio_messages", "image_messages",
    "audio_transcriptions", "has_cpf", "has_email", "has_cep", "has_phone", "lead_plate",
    "lead_cep", "competitor_mentioned", "conversation_outcome", "agent_id", "campaign_id",
    "channel", "lead_source", "lead_city", "lead_state", "lead_device", "avg_response_time_sec",
    "lead_phone", "lead_name", "duration_minutes", "conversation_date",
)

# Columns a message hands to its conversation unchanged: target name and source name.
_FROM_FIRST = {
    "conversation_outcome": "conversation_outcome", "agent_id": "agent_id",
    "campaign_id": "campaign_id", "channel": "channel", "lead_source": "meta_lead_source",
    "lead_city": "meta_city", "lead_state": "meta_state", "lead_device": "meta_device",
}


def aggregate(messages: DataFrame) -> DataFrame:
    """One row per conversation.

    "First" means by time, then message id. The first message's columns travel as one struct,
    the lead's identity is taken in the same aggregation (no join), and partial aggregation
    before the shuffle keeps a very long conversation from landing in one task.
    """
    order = F.struct("timestamp", "message_id")
    inbound = F.col("direction") == "inbound"
    start = F.struct(*[F.col(source).alias(name) for name, source in _FROM_FIRST.items()])
    lead = F.struct(F.col("sender_phone").alias("lead_phone"), F.col("sender_name").alias("lead_name"))

    def first_known(name: str):
        return earliest(name, order, F.col(name).isNotNull())

    grouped = messages.groupBy("conversation_id").agg(
        F.min("timestamp").alias("first_message_at"),
        F.max("timestamp").alias("last_message_at"),
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(inbound).alias("inbound_messages"),
        F.count_if(F.col("direction") == "outbound").alias("outbound_messages"),
        F.count_if(F.col("message_type") == "audio").alias("audio_messages"),
        F.count_if(F.col("message_type") == "image").alias("image_messages"),
        F.count_if("is_audio_transcription").alias("audio_transcriptions"),
        F.bool_or("pii_cpf_found").alias("has_cpf"),
        F.bool_or("pii_email_found").alias("has_email"),
        F.bool_or("pii_cep_found").alias("has_cep"),
        F.bool_or("pii_phone_found").alias("has_phone"),
        first_known("extracted_plate").alias("lead_plate"),
        first_known("extracted_cep").alias("lead_cep"),
        first_known("extracted_competitor").alias("competitor_mentioned"),
        F.avg("meta_response_time_sec").alias("avg_response_time_sec"),
        earliest(start, order).alias("_start"),
        earliest(lead, order, inbound).alias("_lead"),
    )
    return grouped.select("*", "_start.*", "_lead.*").withColumns({
        "duration_minutes":
            F.timestamp_diff("SECOND", F.col("first_message_at"), F.col("last_message_at")) / F.lit(60.0),
        "conversation_date": F.to_date("first_message_at"),
    }).select(*COLUMNS)


def aggregate_notebook(messages: DataFrame) -> DataFrame:
    """The notebook variant: first non-null attributes, outcome guessed from the message count."""
    order = F.struct("timestamp", "message_id")
    # ``timestamp`` may still be text here: the notebook variant stores it unparsed.
    at = F.to_timestamp("timestamp")

    def first_known(name: str):
        return earliest(name, order, F.col(name).isNotNull())

    grouped = messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("direction") == "inbound").alias("inbound_messages"),
        F.count_if(F.col("direction") == "outbound").alias("outbound_messages"),
        F.count_if(F.col("message_type") == "audio").alias("audio_messages"),
        F.count_if(F.col("message_type") == "image").alias("image_messages"),
        F.min(at).alias("first_message_at"),
        F.max(at).alias("last_message_at"),
        F.bool_or("pii_cpf_found").alias("has_cpf"),
        F.bool_or("pii_email_found").alias("has_email"),
        F.bool_or("pii_phone_found").alias("has_phone"),
        F.bool_or("pii_cep_found").alias("has_cep"),
        first_known("agent_id").alias("agent_id"),
        first_known("campaign_id").alias("campaign_id"),
        first_known("lead_source").alias("lead_source"),
        first_known("channel").alias("channel"),
        first_known("meta_city").alias("lead_city"),
        first_known("meta_state").alias("lead_state"),
    )
    total = F.col("total_messages")
    return grouped.withColumns({
        "duration_minutes":
            (F.unix_timestamp("last_message_at") - F.unix_timestamp("first_message_at")) / F.lit(60.0),
        "conversation_date": F.to_date("first_message_at"),
        "conversation_outcome":
            F.when(total >= 15, NEGOTIATING).when(total <= 2, GHOSTING).otherwise("contato_inicial"),
        "avg_response_time_sec": F.lit(None).cast("double"),
    })


def silver_conversations(messages: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    return aggregate_notebook(messages) if profile.name == "notebook" else aggregate(messages)


def conversation_extras(messages: DataFrame) -> DataFrame:
    """Columns the KPI contract asks for beyond the canonical 29, one row per conversation.

    The set of names is bounded by the competitor list; the median keeps a count per distinct
    second, combined before the shuffle.
    """
    order = F.struct("timestamp", "message_id")

    def first_known(name: str):
        return earliest(name, order, F.col(name).isNotNull())

    waited = F.col("meta_response_time_sec")
    return messages.groupBy("conversation_id").agg(
        F.percentile(waited, F.lit(0.5)).alias("response_time_sec_mediana"),
        F.min(waited).alias("response_time_sec_min"),
        F.coalesce(F.bool_or(F.col("conversation_outcome") == SALE), F.lit(False)).alias("venda_fechada"),
        F.bool_or(F.col("extracted_competitor").isNotNull()).alias("menciona_concorrente"),
        F.array_join(F.array_sort(F.collect_set("extracted_competitor")), ", ")
        .alias("concorrentes_mencionados"),
        F.avg(F.col("meta_is_business_hours").cast("int")).alias("proporcao_horario_comercial"),
        hash16(first_known("extracted_plate")).alias("veiculo_placa_hash"),
        first_known("extracted_cpf_hash").alias("pii_cpf_hash"),
        first_known("extracted_email_hash").alias("pii_email_hash"),
        F.count_if(F.col("message_type") == "document").alias("total_document"),
    )


def vehicle_mentions(messages: DataFrame, brands: tuple[str, ...], body: str = "message_body_masked") -> DataFrame:
    """First brand of the caller's list and first model year 19xx/20xx named in a conversation."""
    order = F.struct("timestamp", "message_id")
    pattern = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(brands) + r")(?![\p{L}\p{N}_])"
    brand = F.nullif(F.lower(F.regexp_extract(body, pattern, 0)), F.lit(""))
    year = F.nullif(F.regexp_extract(body, r"(?<![\p{L}\p{N}_])(?:19|20)[0-9]{2}(?![\p{L}\p{N}_])", 0), F.lit(""))
    found = messages.select("conversation_id", "timestamp", "message_id",
                            brand.alias("brand"), year.alias("year"))
    return found.groupBy("conversation_id").agg(
        earliest("brand", order, F.col("brand").isNotNull()).alias("veiculo_marca"),
        earliest("year", order, F.col("year").isNotNull()).alias("veiculo_ano"),
    )


def conversation_stats(conversations: DataFrame) -> DataFrame:
    return conversations.agg(
        F.count(F.lit(1)).alias("total_conversations"),
        F.count_if(F.col("conversation_outcome") == SALE).alias("conversations_with_sale"),
        F.count("competitor_mentioned").alias("conversations_with_competitor"),
        F.count("lead_plate").alias("conversations_with_plate"),
    ).withColumn("rows_written", F.col("total_conversations"))


def conversation_summary(conversations: DataFrame) -> DataFrame:
    return conversations.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg("total_messages").alias("media_mensagens"),
        F.avg("duration_minutes").alias("media_duracao_min"),
    )
