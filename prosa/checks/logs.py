"""Queries over data quality, run logs, usage and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from prosa.checks.base import (
    ORACLE,
    bronze_of, conversations_of, messages_of, over_cleaned, over_conversations,
    over_silver, query,
)
from prosa.operators import quality as Q
from prosa.operators import runlog, silver, usage
from prosa.params import CANONICAL
from prosa.schemas import SOURCE_COLUMNS
from prosa.session import scratch_dir
from prosa.sources import derived as D
from prosa.sources.tables import Tables

# --- data quality --------------------------------------------------------------------------------

_SOURCE = ", ".join("strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp" if c == "timestamp" else c for c in SOURCE_COLUMNS)
SOURCE = f"source AS (SELECT {_SOURCE} FROM messages)"


@query("quality_nulls", f"WITH {D.MESSAGES}, {SOURCE}" + " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos, "
    f"round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS percentual, count(*) AS total_linhas FROM source"
    for c in SOURCE_COLUMNS))
def _(spark, d):
    return Q.null_counts(D.source_messages(spark, d))


@query("quality_duplicates", f"""
    WITH {D.MESSAGES}, {SOURCE}, g AS (SELECT {', '.join(CANONICAL.dedup_keys)}, count(*) AS n FROM source GROUP BY ALL)
    SELECT sum(n)::BIGINT AS total_linhas, count(*) AS linhas_unicas, (sum(n) - count(*))::BIGINT AS duplicatas,
           round((sum(n) - count(*))::DOUBLE / sum(n)::DOUBLE * 100, 2) AS percentual_duplicatas FROM g""")
def _(spark, d):
    return Q.duplicates(D.source_messages(spark, d), CANONICAL.dedup_keys)


@query("quality_schema_comparison", f"""
    WITH {D.MESSAGES}, {SOURCE}
    SELECT name AS coluna, 'string' AS tipo_a, CASE WHEN name <> 'metadata' THEN CASE WHEN name = 'timestamp' THEN 'timestamp'
           ELSE 'string' END END AS tipo_b, name NOT IN ('timestamp', 'metadata') AS igual, n.linhas
    FROM (SELECT unnest([{', '.join(f"'{c}'" for c in SOURCE_COLUMNS)}]) AS name), (SELECT count(*) AS linhas FROM source) n""")
def _(spark, d):
    a = D.source_messages(spark, d)
    b = bronze_of(spark, d).select(*[c for c in SOURCE_COLUMNS if c != "metadata"])
    rows = a.agg(F.count(F.lit(1))).scalar()
    return Q.schema_table(a, b).withColumn("linhas", rows)


def _integrity_sql(table: str, columns: tuple[str, ...], label: str) -> str:
    nulls = [f"(count(*) - count({c}))" for c in columns]
    critical = " + ".join(f"CASE WHEN {n} * 2 > count(*) THEN 1 ELSE 0 END" for n in nulls)
    return f"""
      SELECT '{label}' AS tabela, total_linhas, total_colunas, total_nulos, colunas_criticas, percentual_nulos, score_saude,
        CASE WHEN score_saude >= 70 THEN 'saudavel' WHEN score_saude >= 40 THEN 'atencao' ELSE 'critico' END AS status
      FROM (SELECT *, round(greatest(0.0::DOUBLE, 100.0::DOUBLE - least(percentual_nulos * 2, 40.0::DOUBLE)
                        - least(colunas_criticas * 10.0::DOUBLE, 30.0::DOUBLE)), 1) AS score_saude
            FROM (SELECT *, round(total_nulos::DOUBLE / (total_linhas * total_colunas) * 100, 2) AS percentual_nulos
                  FROM (SELECT count(*) AS total_linhas, {len(columns)}::BIGINT AS total_colunas,
                               ({' + '.join(nulls)})::BIGINT AS total_nulos, ({critical})::BIGINT AS colunas_criticas
                        FROM {table})))"""


_ENTITY_COLUMNS = ("message_id", "message_body", "extracted_cpf_hash", "extracted_email_hash", "extracted_cep",
                   "extracted_plate", "extracted_competitor", "meta_response_time_sec")


@query("quality_integrity", over_silver(_integrity_sql("silver", _ENTITY_COLUMNS, "silver_messages")))
def _(spark, d):
    return Q.integrity(messages_of(spark, d).select(*_ENTITY_COLUMNS), "silver_messages")


@query("quality_allowed_values", f"""
    WITH {D.MESSAGES}, e AS (SELECT unnest(['sent', 'delivered', 'queued']) AS v),
    g AS (SELECT status AS v, count(*) AS n FROM messages WHERE status IS NOT NULL GROUP BY 1)
    SELECT g.v AS valor, 'inesperado' AS problema, n AS linhas FROM g WHERE v NOT IN (SELECT v FROM e)
    UNION ALL SELECT e.v, 'ausente', 0 FROM e WHERE v NOT IN (SELECT v FROM g)""")
def _(spark, d):
    return Q.allowed_values(D.source_messages(spark, d), "status", ["sent", "delivered", "queued"])


_PROFILED = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


@query("quality_profile", "WITH t AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d "
       "LEFT JOIN labels l ON d.doc_id = l.doc_id) " + " UNION ALL ".join(
           f"SELECT '{c}' AS coluna, '{t}' AS tipo, count(*) - count({c}) AS nulos, "
           f"round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS nulos_pct, "
           f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS valores_unicos, "
           f"coalesce(min(substr(CAST({c} AS VARCHAR), 1, 100)), '') AS exemplo FROM t" for c, t in _PROFILED.items()))
def _(spark, d):
    docs = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left")
    return Q.profile(docs.select(*_PROFILED))


_STATS = {"o_orderkey": ("bigint", True), "o_orderstatus": ("string", False), "o_totalprice": ("double", True),
          "o_orderpriority": ("string", False)}


@query("quality_column_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, '{t}' AS tipo, count(*) - count({c}) AS nulos, count(DISTINCT {c}) AS unicos, "
    + (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS media" if n else
       "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS media") + " FROM orders"
    for c, (t, n) in _STATS.items()))
def _(spark, d):
    return Q.column_statistics(D.table(spark, d, "orders").select(*_STATS)).withColumn("media", F.round("media", 4))


@query("quality_column_classes", """
    SELECT 'p_partkey' AS coluna, 'numerica' AS classe, NULL::BIGINT AS valores_unicos, false AS agrupavel
    UNION ALL SELECT 'p_name', 'categorica', count(DISTINCT p_name), count(DISTINCT p_name) BETWEEN 2 AND 15 FROM part
    UNION ALL SELECT 'p_brand', 'categorica', count(DISTINCT p_brand), count(DISTINCT p_brand) BETWEEN 2 AND 15 FROM part
    UNION ALL SELECT 'p_type', 'categorica', count(DISTINCT p_type), count(DISTINCT p_type) BETWEEN 2 AND 15 FROM part
    UNION ALL SELECT 'p_size', 'numerica', NULL, false UNION ALL SELECT 'p_retailprice', 'numerica', NULL, false""")
def _(spark, d):
    return Q.column_classes(D.table(spark, d, "part"))


@query("quality_random_rows", """
    SELECT doc_id, lang, n_chars FROM documents ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id LIMIT 20""")
def _(spark, d):
    return Q.sample_rows(D.table(spark, d, "documents"), 20, ["doc_id"]).select("doc_id", "lang", "n_chars")


@query("quality_preview", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def _(spark, d):
    return Q.preview(D.table(spark, d, "customer").orderBy("c_custkey"), 5).select("c_custkey", "c_name")


@query("quality_json_records", """
    SELECT concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_mktsegment":"', c_mktsegment, '"}') AS json
    FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)""")
def _(spark, d):
    customers = D.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey")
    return Q.first_records_json(customers, 3)


@query("quality_missing_tables", f"""
    WITH {D.MESSAGES}
    SELECT 'silver_messages' AS name, CASE WHEN count(*) FILTER (channel IS NULL) = 0 THEN 'vazia' END AS problema FROM messages
    UNION ALL SELECT 'gold_vendor', 'nao encontrada' FROM (SELECT count(*) AS n FROM messages) WHERE n > 0
    UNION ALL SELECT 'gold', 'nenhuma' FROM (SELECT count(*) AS n FROM messages) WHERE n > 0""")
def _(spark, d):
    tables = Tables(spark, scratch_dir(spark, "expected"))
    source = D.source_messages(spark, d)
    tables.overwrite(source, "bronze")
    tables.overwrite(source.where("channel IS NULL"), "silver_messages")
    return Q.missing_tables(tables.listing(), ["bronze", "silver_messages", "gold_vendor"], any_of="gold")


@query("quality_pending_messages", over_cleaned("""
    , held AS (SELECT DISTINCT conversation_id, sender_phone, message_body, direction, timestamp FROM cleaned
               WHERE status <> 'read')
    SELECT b.conversation_id, b.sender_phone, b.message_body, b.direction, b.timestamp
    FROM (SELECT DISTINCT conversation_id, sender_phone, message_body, direction, timestamp FROM bronze) b
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.conversation_id IS NOT DISTINCT FROM b.conversation_id
      AND h.sender_phone IS NOT DISTINCT FROM b.sender_phone AND h.message_body IS NOT DISTINCT FROM b.message_body
      AND h.direction IS NOT DISTINCT FROM b.direction AND h.timestamp IS NOT DISTINCT FROM b.timestamp)"""))
def _(spark, d):
    source = bronze_of(spark, d)
    held = silver.clean(source).where("status <> 'read'")
    return Q.pending_keys(source, held, CANONICAL.dedup_keys)


@query("quality_health_sweep", over_conversations(" UNION ALL ".join((
    _integrity_sql("bronze", ("message_id", "message_body", "meta_response_time_sec"), "bronze"),
    _integrity_sql("silver", _ENTITY_COLUMNS, "silver_messages"),
    _integrity_sql("convs", ("conversation_id", "lead_plate", "competitor_mentioned"), "silver_conversations")))))
def _(spark, d):
    return Q.health_sweep({
        "bronze": bronze_of(spark, d).select("message_id", "message_body", "meta_response_time_sec"),
        "silver_messages": messages_of(spark, d).select(*_ENTITY_COLUMNS),
        "silver_conversations": conversations_of(spark, d).select("conversation_id", "lead_plate", "competitor_mentioned"),
    })


@query("quality_health_alerts", over_silver(f"""
    , bad AS ({_integrity_sql("silver", ("extracted_cpf_hash", "extracted_email_hash", "extracted_plate",
                                           "extracted_competitor"), "entidades")})
    SELECT 'warning' AS severity, 'Problemas de saúde detectados' AS title,
           concat(tabela, ': score ', CAST(score_saude AS VARCHAR)) AS message, false AS resolved FROM bad
    WHERE status = 'critico'"""))
def _(spark, d):
    columns = ("extracted_cpf_hash", "extracted_email_hash", "extracted_plate", "extracted_competitor")
    sweep = Q.health_sweep({"entidades": messages_of(spark, d).select(*columns)})
    return Q.health_alerts(sweep).select("severity", "title", "message", "resolved")


# --- run logs ----------------------------------------------------------------------------------------

CURRENT_STEPS = """
steps AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY started_at DESC, written DESC) AS rn
                 FROM step_versions) WHERE rn = 1)
"""


def _newest():
    return [F.desc("started_at"), F.desc("written")]


def _steps(spark, d):
    return runlog.current(D.step_log(spark, d), "step_id", _newest())


def over_logs(select: str) -> str:
    return f"WITH {D.RUNS}, {D.STEPS}, {CURRENT_STEPS} {select}"


@query("runs_current_steps", over_logs("SELECT step_id, run_id, step_name, status, rows_input, rows_output, written FROM steps"))
def _(spark, d):
    return _steps(spark, d).select("step_id", "run_id", "step_name", "status", "rows_input", "rows_output", "written")


@query("runs_latest_with_steps", over_logs("""
    , newest AS (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 25)
    SELECT n.run_id, n.status AS run_status, n.started_at AS run_started_at,
           date_diff('microsecond', n.started_at, n.completed_at)::DOUBLE / 1000000 AS run_duration_sec, layers, trigger,
           step_id, step_name, s.status AS step_status, rows_output, s.started_at AS step_started_at,
           date_diff('microsecond', s.started_at, s.completed_at)::DOUBLE / 1000000 AS step_duration_sec, error_message
    FROM newest n LEFT JOIN steps s ON n.run_id = s.run_id"""))
def _(spark, d):
    runs = runlog.latest_runs(D.run_log(spark, d), 25)
    return runlog.runs_with_steps(runs, runlog.steps_of(runs, D.step_log(spark, d), _newest()), 25)


@query("runs_steps_from_json", over_logs(
    "SELECT run_id, step_id, step_name, status, rows_output FROM steps WHERE run_id IN (SELECT run_id FROM runs)"))
def _(spark, d):
    # One JSON document per record of the log: a log line of a run with its step nested in it.
    nested = _steps(spark, d).join(D.run_log(spark, d).select("run_id"), "run_id", "left_semi").select(
        "run_id", F.to_json(F.array(F.struct("step_id", "run_id", "step_name", "status", "rows_output")))
        .alias("steps_json"))
    return runlog.steps_from_json(nested).select("run_id", "step_id", "step_name", "status", "rows_output")


@query("runs_summary", over_logs("""
    , per_run AS (SELECT run_id, count(*) FILTER (status = 'completed') AS ok, count(*) AS n, sum(rows_output)::BIGINT AS r,
        first(error_message ORDER BY started_at, step_id) FILTER (error_message IS NOT NULL) AS e FROM steps GROUP BY run_id)
    SELECT r.run_id, status, trigger, layers, coalesce(ok, 0) AS steps_ok, coalesce(n, 0) AS steps_total,
           coalesce(p.r, 0) AS total_rows, e AS first_error,
           date_diff('microsecond', started_at, completed_at)::DOUBLE / 1000000 AS duration_sec
    FROM runs r LEFT JOIN per_run p ON r.run_id = p.run_id WHERE status IN ('completed', 'failed')
      AND trigger IN ('manual', 'schedule')"""))
def _(spark, d):
    runs = D.run_log(spark, d).where("status IN ('completed', 'failed') AND trigger IN ('manual', 'schedule')")
    return runlog.run_summary(runs, runlog.steps_of(runs, D.step_log(spark, d), _newest()))


@query("runs_summary_all", ORACLE["runs_summary"].replace("""WHERE status IN ('completed', 'failed')
      AND trigger IN ('manual', 'schedule')""", ""))
def _(spark, d):
    return runlog.run_summary(D.run_log(spark, d), _steps(spark, d))


@query("runs_by_status", f"WITH {D.RUNS} SELECT status, trigger, count(*) AS runs FROM runs GROUP BY status, trigger")
def _(spark, d):
    return runlog.run_counts(D.run_log(spark, d))


@query("runs_totals", f"""
    WITH {D.RUNS} SELECT count(*) AS total_runs, count(*) FILTER (status = 'completed') AS runs_completas,
    count(*) FILTER (status = 'failed') AS runs_com_falha FROM runs""")
def _(spark, d):
    return runlog.run_totals(D.run_log(spark, d))


@query("runs_durations", f"""
    WITH {D.RUNS} SELECT run_id, status, date_diff('microsecond', started_at, completed_at)::DOUBLE / 1000000 AS duration_sec
    FROM runs""")
def _(spark, d):
    return runlog.durations(D.run_log(spark, d), "run_id")


@query("runs_step_result_totals", over_logs("""
    , r AS (SELECT step_name, round(sum(date_diff('microsecond', started_at, completed_at)::DOUBLE / 1000000), 3) AS s,
                   sum(rows_output)::BIGINT AS n FROM steps GROUP BY step_name)
    SELECT count(*) AS notebooks, round(sum(s), 3) AS duracao_total_sec, sum(n)::BIGINT AS total_rows, 0::BIGINT AS falhas FROM r"""))
def _(spark, d):
    per_step = _steps(spark, d).groupBy("step_name").agg(
        F.round(F.sum(runlog.duration_sec()), 3).alias("s"), F.sum("rows_output").alias("n"))
    results = runlog.step_results(spark, [
        (r["step_name"], "sucesso", r["s"], r["n"], None, None) for r in per_step.collect()])  # one per layer
    return runlog.step_result_totals(results).withColumn("duracao_total_sec", F.round("duracao_total_sec", 3))


@query("alerts_recent_open", f"""
    WITH {D.ALERTS} SELECT alert_id, severity, title, resolved FROM alerts WHERE NOT resolved
    ORDER BY timestamp DESC, alert_id LIMIT 20""")
def _(spark, d):
    return runlog.recent_alerts(D.alert_log(spark, d), 20, unresolved_only=True).select(
        "alert_id", "severity", "title", "resolved")


# --- usage ---------------------------------------------------------------------------------------------

PRICES = """
prices AS (SELECT * FROM (VALUES ('gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE), ('gpt-4o', 0.0025::DOUBLE, 0.01::DOUBLE),
  ('gemini/gemini-1.5-flash', 0.000075::DOUBLE, 0.0003::DOUBLE)) p(model, price_in, price_out)),
actions AS (
  SELECT c.*, coalesce(input_tokens::DOUBLE / 1000 * price_in + output_tokens::DOUBLE / 1000 * price_out, 0.0::DOUBLE) AS cost
  FROM calls c LEFT JOIN prices p ON c.model_used = p.model)
"""


def over_actions(select: str) -> str:
    return f"WITH {D.ACTIONS}, {PRICES} {select}"


def _actions(spark, d):
    return usage.with_cost(D.action_log(spark, d))


@query("usage_call_cost", over_actions("SELECT action_id, model_used, cost FROM actions"))
def _(spark, d):
    return _actions(spark, d).select("action_id", "model_used", "cost")


@query("usage_totals", over_actions("""
    SELECT round(sum(cost), 9) AS custo_total_usd, sum(input_tokens)::BIGINT AS input_tokens,
           sum(output_tokens)::BIGINT AS output_tokens FROM actions"""))
def _(spark, d):
    return usage.usage_totals(_actions(spark, d)).withColumn("custo_total_usd", F.round("custo_total_usd", 9))


@query("usage_recent_actions", over_actions("""
    SELECT action_id, agent_name, action, success FROM actions WHERE agent_name = 'agente_3'
    ORDER BY timestamp DESC, action_id LIMIT 50"""))
def _(spark, d):
    return runlog.recent_actions(_actions(spark, d), 50, "agente_3").select("action_id", "agent_name", "action", "success")


@query("usage_by_agent", over_actions("""
    SELECT agent_name, count(*) AS total_acoes, count(*) FILTER (success) AS acoes_sucesso,
           count(*) FILTER (NOT success) AS acoes_falha, round(sum(cost), 9) AS custo,
           sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
           array_to_string(list_sort(list(DISTINCT model_used) FILTER (model_used <> '')), ', ') AS modelos,
           round(count(*) FILTER (success)::DOUBLE / count(*) * 100, 0) AS taxa_sucesso_pct
    FROM actions GROUP BY agent_name"""))
def _(spark, d):
    return runlog.agent_metrics(_actions(spark, d)).withColumn("custo", F.round("custo", 9))


@query("usage_cumulative_cost", over_actions("""
    SELECT action_id, round(sum(cost) OVER (ORDER BY timestamp, action_id ROWS UNBOUNDED PRECEDING), 9) AS custo_acumulado
    FROM actions"""))
def _(spark, d):
    return usage.cumulative_cost(_actions(spark, d)).select(
        "action_id", F.round("custo_acumulado", 9).alias("custo_acumulado"))


@query("usage_budget_by_agent", over_actions("""
    , c AS (SELECT action_id, agent_name, sum(cost) OVER (PARTITION BY agent_name ORDER BY timestamp, action_id
              ROWS UNBOUNDED PRECEDING) AS spent FROM actions)
    SELECT action_id, agent_name, round(spent, 9) AS custo_acumulado,
           round(greatest(0.0::DOUBLE, 0.5::DOUBLE - spent), 9) AS orcamento_restante, spent >= 0.5::DOUBLE AS orcamento_excedido
    FROM c"""))
def _(spark, d):
    left = usage.budget(_actions(spark, d), 0.5, ["agent_name"])
    return left.select("action_id", "agent_name", F.round("custo_acumulado", 9).alias("custo_acumulado"),
                       F.round("orcamento_restante", 9).alias("orcamento_restante"), "orcamento_excedido")


@query("usage_rolling_tokens", over_actions("""
    , m AS (SELECT timestamp, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM actions GROUP BY timestamp)
    SELECT timestamp, tokens, (sum(tokens) OVER w)::BIGINT AS tokens_60s,
           greatest(0, 10000 - sum(tokens) OVER w)::BIGINT AS tokens_restantes, (sum(tokens) OVER w) > 10000 AS acima_do_limite
    FROM m WINDOW w AS (ORDER BY timestamp RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)"""))
def _(spark, d):
    return usage.rolling_tokens(_actions(spark, d))


# --- streams ----------------------------------------------------------------------------------------------

def _waves(spark, d, root: str):
    """Two waves of message files: first arrivals, then everything again with status repeats. Each is written by all tasks,
    and the next one only when the caller has dealt with it. Gives the folder of both."""
    for i, wave in enumerate((D.first_arrivals(spark, d), D.source_messages(spark, d))):
        wave.write.parquet(os.path.join(root, "in", str(i)))
        yield os.path.join(root, "in", "*")


@query("stream_bronze", f"WITH {D.MESSAGES} SELECT message_id, status FROM messages")
def _(spark, d):
    from prosa.streaming.messages import arriving, stream_to_bronze
    root = scratch_dir(spark, "stream")
    tables = Tables(spark, root)
    for folder in _waves(spark, d, root):
        stream_to_bronze(arriving(spark, folder), tables, os.path.join(root, "state")).awaitTermination()
    return tables.read("bronze").select("message_id", "status")


@query("stream_after_batch", f"WITH {D.MESSAGES} SELECT message_id, status FROM messages")
def _(spark, d):
    """A stream into a table that a batch job has filled, then a second stream with a checkpoint of its own."""
    from prosa.plans.medallion import ingest
    from prosa.streaming.messages import arriving, stream_to_bronze
    root = scratch_dir(spark, "mixed")
    tables = Tables(spark, root)
    D.first_arrivals(spark, d).write.parquet(os.path.join(root, "first"))
    ingest(tables, os.path.join(root, "first"))
    for folder in _waves(spark, d, root):
        stream_to_bronze(arriving(spark, folder), tables, os.path.join(root, "state")).awaitTermination()
    stream_to_bronze(arriving(spark, folder), tables, os.path.join(root, "another")).awaitTermination()
    return tables.read("bronze").select("message_id", "status")


@query("stream_dedup", over_cleaned("SELECT message_id, status FROM cleaned"))
def _(spark, d):
    from prosa.operators.bronze import cast_timestamp
    from prosa.streaming.messages import arriving, resolved, stream_messages
    root = scratch_dir(spark, "dedup")
    tables = Tables(spark, root)
    for folder in _waves(spark, d, root):
        typed = cast_timestamp(arriving(spark, folder))
        stream_messages(typed, tables, os.path.join(root, "candidates"), os.path.join(root, "state")).awaitTermination()
    return resolved(tables.read(os.path.join(root, "candidates"))).select("message_id", "status")


@query("stream_refresh", over_conversations("""
    SELECT conversation_id, total_messages, inbound_messages, avg_response_time_sec, conversation_outcome FROM convs"""))
def _(spark, d):
    from prosa.streaming.messages import arriving, changes, refresh_touched, stream_to_bronze
    root = scratch_dir(spark, "refresh")
    tables = Tables(spark, root)
    for folder in _waves(spark, d, root):
        stream_to_bronze(arriving(spark, folder), tables, os.path.join(root, "state")).awaitTermination()
        refresh_touched(changes(tables), tables, os.path.join(root, "state2"), every=None, gold=False).awaitTermination()
    return tables.read("silver_conversations").select(
        "conversation_id", "total_messages", "inbound_messages", "avg_response_time_sec", "conversation_outcome")
