"""Message and log tables derived from the generic tables of a test-data folder.

The SQL runs unchanged on Spark and on the engine used for checking, over all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGES = """
ev AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(date_trunc('week', ts) AS DATE) AS wk,
         CAST(event_id % 10 AS INT) AS b,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
one AS (
  SELECT concat('msg', CAST(event_id AS STRING)) AS message_id,
         concat('conv_', CAST(user_id AS STRING), '_', CAST(wk AS STRING)) AS conversation_id,
         CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'inbound' ELSE 'outbound' END AS direction,
         concat('+55119', lpad(CAST(user_id AS STRING), 8, '0')) AS sender_phone,
         CASE user_id % 3 WHEN 0 THEN concat(' Lead ', CAST(user_id AS STRING), ' ')
                          WHEN 1 THEN concat('lead ', CAST(user_id AS STRING)) ELSE '' END AS sender_name,
         CASE event_type WHEN 'click' THEN 'image' WHEN 'error' THEN 'audio' WHEN 'signup' THEN 'document'
                         ELSE 'text' END AS message_type,
         CASE b WHEN 0 THEN concat('meu cpf eh 383.182.856-', lpad(CAST(user_id % 100 AS STRING), 2, '0'))
                WHEN 1 THEN concat('email Lead', CAST(user_id AS STRING), '@example.com')
                WHEN 2 THEN concat('[audio transcrito] placa abc', CAST(user_id % 10 AS STRING), 'd23')
                WHEN 3 THEN CASE WHEN user_id % 4 = 0 THEN 'pago hoje na Porto Seguro'
                                 WHEN user_id % 4 = 1 THEN 'cotei HDI Seguros' ELSE 'quanto fica?' END
                WHEN 4 THEN concat('fone (11) 98', lpad(CAST(user_id % 1000 AS STRING), 3, '0'), '-4012')
                WHEN 5 THEN 'cep 08617-986' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE 'bom dia' END AS message_body,
         CASE event_id % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'read' WHEN 2 THEN 'delivered' ELSE 'failed' END AS status,
         'whatsapp' AS channel,
         concat('camp_', CAST(user_id % 9 AS STRING)) AS campaign_id,
         concat('agent_', CAST(user_id % 17 AS STRING)) AS agent_id,
         CASE (user_id + CAST(floor(EXTRACT(day FROM wk) / 7) AS INT)) % 7
              WHEN 0 THEN 'venda_fechada' WHEN 1 THEN 'ghosting' WHEN 2 THEN 'perdido_preco'
              WHEN 3 THEN 'perdido_concorrente' WHEN 4 THEN 'proposta_enviada'
              WHEN 5 THEN 'em_negociacao' ELSE 'desistencia_lead' END AS conversation_outcome,
         concat('{"device":"android","city":"c', CAST(user_id % 40 AS STRING), '","state":"',
                CASE user_id % 8 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'PR' WHEN 3 THEN 'BA' WHEN 4 THEN 'GO'
                                 WHEN 5 THEN 'AM' WHEN 6 THEN 'XX' ELSE 'MG' END,
                '","response_time_sec":',
                CASE WHEN event_type IN ('error', 'signup') THEN 'null' ELSE CAST(k * (1 + user_id % 20) AS STRING) END,
                ',"is_business_hours":', CASE WHEN EXTRACT(hour FROM ts) BETWEEN 8 AND 17 THEN 'true' ELSE 'false' END,
                ',"lead_source":"', CASE user_id % 5 WHEN 0 THEN 'google_ads' WHEN 1 THEN 'facebook'
                                    WHEN 2 THEN 'instagram' WHEN 3 THEN 'referral' ELSE 'tv' END, '"}') AS metadata
  FROM ev),
messages AS (
  SELECT * FROM one
  UNION ALL
  SELECT concat(message_id, 'd'), conversation_id, ts, direction, sender_phone, sender_name, message_type,
         message_body, 'sent', channel, campaign_id, agent_id, conversation_outcome, metadata
  FROM one WHERE status = 'delivered' AND message_id LIKE '%4')
"""

RUNS = """
runs AS (
  SELECT concat('run', CAST(o_orderkey AS STRING)) AS run_id,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS started_at,
         CASE WHEN o_orderstatus <> 'P'
              THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(o_custkey % 3600 AS INT) END AS completed_at,
         'bronze,silver,gold' AS layers,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'monitor_agent' WHEN o_orderpriority = '2-HIGH' THEN 'schedule'
              ELSE 'manual' END AS trigger
  FROM orders)
"""

STEPS = """
step_versions AS (
  SELECT concat('step', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS step_id,
         concat('run', CAST(l_orderkey AS STRING)) AS run_id,
         CASE l_linenumber % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS step_name,
         CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END AS status,
         CAST(l_shipdate AS TIMESTAMP) AS started_at,
         CASE WHEN l_linestatus <> 'O'
              THEN CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(l_suppkey AS INT) END AS completed_at,
         l_partkey AS rows_input,
         CAST(l_quantity AS BIGINT) AS rows_output,
         CASE WHEN l_returnflag = 'R' THEN concat('erro ', CAST(l_suppkey AS STRING)) END AS error_message,
         concat(lpad(CAST(l_partkey AS STRING), 12, '0'), '_', lpad(CAST(l_suppkey AS STRING), 12, '0'), '_',
                CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS written
  FROM lineitem)
"""

ACTIONS = """
calls AS (
  SELECT concat('act', lpad(CAST(event_id AS STRING), 12, '0')) AS action_id,
         concat('agente_', CAST(user_id % 7 AS STRING)) AS agent_name,
         event_type AS action,
         CAST(ts AS TIMESTAMP) AS timestamp,
         '' AS input_summary,
         '' AS output_summary,
         CASE user_id % 5 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gemini/gemini-1.5-flash'
                          WHEN 3 THEN 'modelo-local' ELSE '' END AS model_used,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 64 AS input_tokens,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 8 + user_id AS output_tokens,
         event_type <> 'error' AS success,
         CASE WHEN event_type = 'error' THEN 'falha' END AS error_message
  FROM events)
"""

ALERTS = """
alerts AS (
  SELECT concat('al', lpad(CAST(event_id AS STRING), 12, '0')) AS alert_id,
         CASE WHEN value > 20 THEN 'critical' WHEN value > 5 THEN 'warning' ELSE 'info' END AS severity,
         concat('alerta ', event_type) AS title,
         props AS message,
         CAST(ts AS TIMESTAMP) AS timestamp,
         event_type <> 'error' AS resolved,
         'monitor_agent' AS source
  FROM events)
"""

TURNS = """
turns AS (
  SELECT concat('t', CAST(conv_id AS STRING), '_', lpad(CAST(turn AS STRING), 6, '0')) AS message_id,
         CAST(conv_id AS STRING) AS conversation_id, turn,
         CASE WHEN role = 'user' THEN 'inbound' ELSE 'outbound' END AS direction, text AS message_body
  FROM conversations)
"""

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, ctes: str, result: str, *tables: str) -> DataFrame:
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(f"WITH {ctes} SELECT * FROM {result}")


def source_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the layout of the source files: all text, timestamps formatted."""
    df = derived(spark, sf_dir, MESSAGES, "messages", "events")
    return _as_source(df)


def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the later status repeats."""
    return _as_source(derived(spark, sf_dir, MESSAGES, "one", "events"))


def _as_source(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    from prosa.schemas import SOURCE_COLUMNS
    return df.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).select(*SOURCE_COLUMNS)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RUNS, "runs", "orders")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, STEPS, "step_versions", "lineitem")


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ACTIONS, "calls", "events")


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ALERTS, "alerts", "events")


def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, TURNS, "turns", "conversations")
