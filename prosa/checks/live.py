"""Queries over tables that are kept up, and over messages with repeated ids, changing attributes and broken metadata."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from prosa.checks.base import (
    _POST, _PRE, CAMPAIGNS, CEP_CORE, CPF_CORE, EMAIL_CORE, PHONE_CORE, PLATE_CORE, SCORES, SELLERS, messages_of,
    over_conversations, over_silver, query,
)
from prosa.operators import bronze as B
from prosa.operators import conversations as C
from prosa.operators import silver
from prosa.params import NOTEBOOK
from prosa.plans.medallion import unheld
from prosa.session import scratch_dir
from prosa.sources import derived as D
from prosa.sources.guard import BrokenRules
from prosa.sources.tables import Tables
from prosa.streaming.messages import arriving, changes, refresh_touched, stream_to_bronze


# --- Gold by deltas -------------------------------------------------------------------------------

def live(spark, d) -> Tables:
    """Clustered tables brought up by two waves of arrivals: first arrivals, then everything with better statuses."""
    root = scratch_dir(spark, "live")
    tables = Tables(spark, root, buckets=8)
    for i, wave in enumerate((D.first_arrivals(spark, d), D.source_messages(spark, d))):
        wave.write.parquet(os.path.join(root, "in", str(i)))
        stream_to_bronze(arriving(spark, os.path.join(root, "in", "*")), tables, os.path.join(root, "s1")).awaitTermination()
        refresh_touched(changes(tables), tables, os.path.join(root, "s2"), every=None).awaitTermination()
    return tables


@query("gold_by_deltas", over_conversations("""
    SELECT 'gold_vendor' AS tabela, agent_id AS chave, total_conversas, vendas_fechadas AS vendas, media_mensagens,
           media_tempo_resposta_sec AS media_tempo_resposta, taxa_conversao_pct, score_vendedor AS score FROM sellers
    UNION ALL
    SELECT 'gold/performance_campanha', campaign_id, total_conversas, vendas, media_mensagens, media_tempo_resposta,
           taxa_conversao_pct, media_lead_score FROM campaigns""", SCORES, CAMPAIGNS, SELLERS))
def _(spark, d):
    """Sellers and campaigns after conversations that were counted before have changed."""
    tables = live(spark, d)
    sellers = tables.read("gold_vendor").select(
        F.lit("gold_vendor").alias("tabela"), F.col("agent_id").alias("chave"), "total_conversas", F.col("vendas_fechadas").alias("vendas"),
        "media_mensagens", F.col("media_tempo_resposta_sec").alias("media_tempo_resposta"), "taxa_conversao_pct", F.col("score_vendedor").alias("score"))
    return sellers.unionByName(tables.read(tables.place("gold/performance_campanha")).select(
        F.lit("gold/performance_campanha").alias("tabela"), F.col("campaign_id").alias("chave"), "total_conversas", "vendas", "media_mensagens",
        "media_tempo_resposta", "taxa_conversao_pct", F.col("media_lead_score").alias("score")))


@query("gold_rows_by_deltas", over_conversations("SELECT conversation_id, conversation_outcome, total_messages, lead_score FROM scored", SCORES))
def _(spark, d):
    return live(spark, d).read("gold_analytics").select("conversation_id", "conversation_outcome", "total_messages", "lead_score")


# --- loads that read few batches -----------------------------------------------------------------------

@query("bronze_late_load", f"""
    WITH {D.MESSAGES}, held AS (SELECT * FROM messages WHERE ts < (SELECT max(ts) FROM messages) - INTERVAL 3 DAY AND message_id NOT LIKE '%7')
    SELECT message_id, status FROM messages WHERE message_id NOT IN (SELECT message_id FROM held) OR ts > (SELECT max(ts) FROM held)""")
def _(spark, d):
    """Bronze in batches by time without some messages and the last days; then all messages come, most of them again."""
    tables = Tables(spark, scratch_dir(spark, "late"))
    rows = B.cast_timestamp(D.source_messages(spark, d))
    end = rows.agg(F.max("timestamp").alias("t")).scalar()
    held = rows.where((F.col("timestamp") < end - F.expr("INTERVAL 3 DAYS")) & ~F.col("message_id").like("%7"))
    for half in ("dayofmonth(timestamp) < 15", "dayofmonth(timestamp) >= 15"):
        tables.append(held.where(half), "bronze")
    return unheld(tables, rows).select("message_id", "status")


# --- data in which the rules can fail --------------------------------------------------------------------

KEYED = """
keyed AS (
  SELECT message_id, ts, CASE user_id % 6 WHEN 0 THEN concat('{"device_type":"d', CAST(k AS STRING), '","os":"android","browser":null,"city":"c1"}')
         WHEN 1 THEN concat('{"os":"ios","browser":"b', CAST(k AS STRING), '","state":"SP","country":"BR"}')
         WHEN 2 THEN concat('{"country":"PT","city":"', CAST(k AS STRING), '"}') WHEN 3 THEN '{"device_type":"tablet","os":' WHEN 4 THEN '{}'
         ELSE CAST(NULL AS STRING) END AS metadata
  FROM (SELECT concat('msg', CAST(event_id AS STRING)) AS message_id, ts, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e)
"""
_KEYS = ", ".join(f"CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{k}') END AS meta_{k}" for k in NOTEBOOK.metadata_keys)


@query("bronze_metadata_keys", f"WITH {KEYED} SELECT message_id, {_KEYS} FROM keyed WHERE metadata IS NULL OR json_valid(metadata)")
def _(spark, d):
    """All keys of the notebook variant, some of them absent in each message."""
    rows = D.derived(spark, d, KEYED, "keyed", "events").where("metadata IS NULL OR metadata LIKE '%}'")
    return B.parse_metadata(rows, NOTEBOOK).select("message_id", *[f"meta_{k}" for k in NOTEBOOK.metadata_keys])


@query("bronze_malformed_metadata", f"""
    WITH {KEYED} SELECT count(*) AS rows, count(*) FILTER (metadata IS NOT NULL AND NOT json_valid(metadata)) AS bad_rows FROM keyed""")
def _(spark, d):
    return B.bad_metadata(D.derived(spark, d, KEYED, "keyed", "events"))


REPEATED = f"""
{D.MESSAGES},
repeated AS (
  SELECT * EXCEPT_ (message_id, status), regexp_replace(message_id, 'd$', '') AS message_id,
         CASE WHEN message_id LIKE '%3' THEN 'failed' WHEN message_id LIKE '%5' THEN 'unknown' ELSE status END AS message_status
  FROM messages
  UNION ALL
  SELECT * EXCEPT_ (message_id, status), message_id, CASE WHEN message_id LIKE '%3' THEN 'sent' ELSE 'read' END FROM messages
  WHERE message_id LIKE '%3' OR message_id LIKE '%5')
"""


@query("silver_dedup_repeated_ids", f"""
    WITH {REPEATED.replace("EXCEPT_", "EXCLUDE")},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY CASE message_status WHEN 'failed' THEN 1 WHEN 'sent' THEN 2
                 WHEN 'delivered' THEN 3 WHEN 'read' THEN 4 ELSE 0 END DESC) AS rn FROM repeated)
    SELECT message_id, message_status FROM ranked WHERE rn = 1""")
def _(spark, d):
    """Ids that stand two or three times with different statuses."""
    rows = D.derived(spark, d, REPEATED.replace("EXCEPT_", "EXCEPT"), "repeated", "events").withColumnRenamed("ts", "timestamp")
    return silver.deduplicate(rows, NOTEBOOK).select("message_id", "message_status")


CHANGING = f"""
{D.MESSAGES},
changing AS (
  SELECT message_id, conversation_id, ts AS timestamp, direction, message_type, channel,
         CASE WHEN message_id LIKE '%1' OR message_id LIKE '%2' OR message_id LIKE '%8' THEN NULL ELSE concat(agent_id, '_', direction) END AS agent_id,
         CASE WHEN message_id LIKE '%4' THEN NULL ELSE concat(campaign_id, message_type) END AS campaign_id,
         CASE WHEN direction = 'inbound' THEN status END AS lead_source, CAST(NULL AS STRING) AS meta_city, sender_phone AS meta_state,
         false AS pii_cpf_found, false AS pii_email_found, false AS pii_phone_found, false AS pii_cep_found
  FROM messages)
"""


@query("conversations_changing_attributes", f"""
    WITH {CHANGING}
    SELECT conversation_id, count(*) AS total_messages,
           first(agent_id ORDER BY timestamp, message_id) FILTER (agent_id IS NOT NULL) AS agent_id,
           first(campaign_id ORDER BY timestamp, message_id) FILTER (campaign_id IS NOT NULL) AS campaign_id,
           first(lead_source ORDER BY timestamp, message_id) FILTER (lead_source IS NOT NULL) AS lead_source
    FROM changing GROUP BY conversation_id""")
def _(spark, d):
    """First known attributes where they change from message to message and are often missing."""
    rows = D.derived(spark, d, CHANGING, "changing", "events")
    return C.aggregate_notebook(rows).select("conversation_id", "total_messages", "agent_id", "campaign_id", "lead_source")


_KINDS = {"cpf": f"{_PRE}{CPF_CORE}{_POST}", "email": f"{_PRE}{EMAIL_CORE}{_POST}", "telefone": f"{PHONE_CORE}{_POST}", "cep": f"{_PRE}{CEP_CORE}{_POST}",
          "placa": f"{_PRE}{PLATE_CORE}{_POST}"}


@query("silver_leaks_by_kind", over_silver(" UNION ALL ".join(
    f"SELECT '{table}' AS tabela, '{kind}' AS tipo, count(*) FILTER (regexp_matches({column}, '{pattern}')) AS linhas FROM silver"
    for table, column in (("corpo", "message_body_normalized"), ("mascarado", "message_body_masked")) for kind, pattern in _KINDS.items())))
def _(spark, d):
    """The leak check on texts that do leak, before and after masking."""
    messages = messages_of(spark, d)
    return silver.leak_table({"corpo": messages.select("message_body_normalized"), "mascarado": messages.select("message_body_masked")})


@query("gold_write_guard", over_silver(" UNION ALL ".join(
    f"SELECT '{table}' AS tabela, '{kind}' AS tipo, count(*) FILTER (regexp_matches({column}, '{pattern}')) AS linhas, count(*) AS linhas_na_tabela FROM silver"
    for table, column in (("corpo", "message_body_normalized"), ("mascarado", "message_body_masked"))
    for kind, pattern in _KINDS.items() if kind in ("cpf", "email"))))
def _(spark, d):
    """A table of masked texts is written under the leak rules; one of the texts as they came is refused, with what the write
    itself counted, and the table stays."""
    tables, messages = Tables(spark, scratch_dir(spark, "guard")), messages_of(spark, d)
    seen, guarded = {}, tables.place("guarded")
    for label, column in (("mascarado", "message_body_masked"), ("corpo", "message_body_normalized")):
        rows = messages.select("message_id", F.col(column).alias("texto"))
        try:
            tables.overwrite(rows, guarded, rules=silver.leak_rules(rows, ("cpf", "email"), leave=("message_id",)))
            seen[label] = {"cpf": 0, "email": 0}
        except BrokenRules as refused:
            seen[label] = refused.counts
    held = tables.read(guarded)
    if held.where(F.col("texto").contains("@")).count():
        raise AssertionError("refused rows are in the table")
    counts = [(table, kind, n, held.count()) for table, kinds in seen.items() for kind, n in kinds.items()]
    return spark.createDataFrame(counts, "tabela string, tipo string, linhas long, linhas_na_tabela long")
