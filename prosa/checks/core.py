"""Queries over sources, Bronze, Silver and conversations."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from prosa.checks.base import (
    SEGMENTS, bronze_of, conversations_of, entity_columns, masked, messages_of, notebook_conversations,
    notebook_messages, notebook_source, over_cleaned, over_conversations, over_messages,
    over_silver, query, stored,
)
from prosa.operators import bronze as B
from prosa.operators import conversations as C
from prosa.operators import silver
from prosa.operators.segments import DIMENSIONS, gold_segmentation
from prosa.params import NOTEBOOK
from prosa.schemas import SOURCE_MESSAGES
from prosa.session import scratch_dir
from prosa.sources import derived as D
from prosa.sources.tables import Tables, append_record, export_csv, nanos_to_timestamp, read_source

# --- sources and tables ----------------------------------------------------------------------


@query("source_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, d):
    return read_source(spark, f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@query("source_csv_round_trip", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, l_shipdate FROM lineitem""")
def _(spark, d):
    df = D.table(spark, d, "lineitem")
    path = scratch_dir(spark, "export") + ".csv"
    export_csv(df, path)
    return read_source(spark, path, schema=df.schema)


@query("table_as_of_batch", f"""
    WITH {D.MESSAGES}
    SELECT 0 AS as_of, count(*) AS linhas, count(DISTINCT conversation_id) AS conversas FROM one
    UNION ALL
    SELECT 1, count(*), count(DISTINCT conversation_id) FROM messages""")
def _(spark, d):
    tables = Tables(spark, scratch_dir(spark, "versions"))
    source, first = D.source_messages(spark, d), D.first_arrivals(spark, d)
    tables.append(first, "bronze")
    tables.append(B.unseen_ids(source, first), "bronze")
    states = [
        tables.read("bronze", as_of=n).agg(
            F.lit(n).alias("as_of"), F.count(F.lit(1)).alias("linhas"),
            F.count_distinct("conversation_id").alias("conversas"))
        for n in range(tables.version("bronze") + 1)]
    return states[0].unionByName(states[1])


@query("table_schema_merge", f"""
    WITH {D.MESSAGES}
    SELECT CAST(NULL AS VARCHAR) AS origem, count(*) AS linhas FROM one
    UNION ALL SELECT 'repeticao', count(*) FROM messages WHERE message_id LIKE '%d'""")
def _(spark, d):
    tables = Tables(spark, scratch_dir(spark, "merge"))
    source, first = D.source_messages(spark, d), D.first_arrivals(spark, d)
    tables.overwrite(first, "bronze")
    repeats = B.unseen_ids(source, first).withColumn("origem", F.lit("repeticao"))
    tables.append(repeats, "bronze")
    return tables.read("bronze").groupBy("origem").agg(F.count(F.lit(1)).alias("linhas"))


@query("table_listing", f"""
    WITH {D.MESSAGES}
    SELECT n.name, n.name = 'bronze' AS exists,
           CASE WHEN n.name = 'bronze' THEN (SELECT count(*) FROM messages) ELSE 0 END AS rows,
           CASE WHEN n.name = 'bronze' THEN 0 ELSE -1 END::BIGINT AS version
    FROM (VALUES ('bronze'), ('silver_messages'), ('silver_conversations'), ('gold_sentiment'), ('gold_personas'),
                 ('gold_segmentation'), ('gold_analytics'), ('gold_vendor')) n(name)""")
def _(spark, d):
    tables = Tables(spark, scratch_dir(spark, "listing"))
    tables.overwrite(D.source_messages(spark, d), "bronze")
    return tables.listing().drop("path")


@query("table_gold_discovery", f"""
    WITH {D.MESSAGES}
    SELECT 'por_canal' AS tabela, count(DISTINCT channel) AS linhas FROM messages
    UNION ALL SELECT 'por_campanha', count(DISTINCT campaign_id) FROM messages""")
def _(spark, d):
    tables = Tables(spark, scratch_dir(spark, "discovery"))
    source = D.source_messages(spark, d)
    tables.overwrite(source.groupBy("channel").count(), f"{tables.root}/gold/por_canal")
    tables.overwrite(source.groupBy("campaign_id").count(), f"{tables.root}/gold/por_campanha")
    tables.overwrite(source.where("channel IS NULL").select("channel"), f"{tables.root}/gold/vazia")
    found = [df.agg(F.lit(name).alias("tabela"), F.count(F.lit(1)).alias("linhas"))
             for name, df in tables.gold_tables().items()]
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


@query("sql_over_frames", """
    SELECT d.lang, l.quality, count(*) AS documentos, sum(d.n_chars)::BIGINT AS caracteres
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality""")
def _(spark, d):
    return Tables(spark, d).sql(
        "SELECT d.lang, l.quality, count(*) AS documentos, sum(d.n_chars) AS caracteres "
        "FROM {docs} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality",
        docs=D.table(spark, d, "documents"), labels=D.table(spark, d, "labels"))


@query("source_nanosecond_time", "SELECT event_id, ts FROM events")
def _(spark, d):
    events = D.table(spark, d, "events").select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"))
    return nanos_to_timestamp(events, "ts")


@query("run_records_appended", f"""
    WITH {D.STEPS}
    SELECT step_name AS notebook, CASE WHEN step_name = 'gold' THEN 'v2' END AS versao,
           sum(rows_output)::BIGINT AS rows_written, CAST(NULL AS VARCHAR) AS error
    FROM step_versions GROUP BY step_name""")
def _(spark, d):
    tables = Tables(spark, scratch_dir(spark, "records"))
    totals = (D.step_log(spark, d).groupBy(F.col("step_name").alias("notebook"))
              .agg(F.sum("rows_output").alias("rows_written")))
    for row in totals.orderBy("notebook").collect():  # one row per layer of the run
        record = row.asDict() | {"error": None}
        if record["notebook"] == "gold":
            record["versao"] = "v2"
        append_record(spark, tables, f"{tables.root}/notebook_runs", record)
    return tables.read(f"{tables.root}/notebook_runs").select("notebook", "versao", "rows_written", "error")


# --- Bronze --------------------------------------------------------------------------------------

_TYPED = ("message_id", "conversation_id", "timestamp", "status", "meta_device", "meta_city", "meta_state",
          "meta_response_time_sec", "meta_is_business_hours", "meta_lead_source")


@query("bronze_typed", over_messages(f"SELECT {', '.join(_TYPED)}, 'events.parquet' AS _source_file FROM bronze"))
def _(spark, d):
    return bronze_of(spark, d).select(*_TYPED, "_source_file")


@query("bronze_metadata_map", over_messages("""
    SELECT message_id, CAST(NULL AS VARCHAR) AS meta_device_type, CAST(NULL AS VARCHAR) AS meta_os,
           CAST(NULL AS VARCHAR) AS meta_browser, meta_city, meta_state, CAST(NULL AS VARCHAR) AS meta_country
    FROM bronze"""))
def _(spark, d):
    return B.parse_metadata(notebook_source(spark, d), NOTEBOOK).select(
        "message_id", *[f"meta_{k}" for k in NOTEBOOK.metadata_keys])


@query("bronze_bad_metadata", over_messages("SELECT count(*) AS rows, 0::BIGINT AS bad_rows FROM bronze"))
def _(spark, d):
    return B.bad_metadata(D.source_messages(spark, d))


@query("bronze_new_rows", over_messages("""
    SELECT message_id, status FROM messages WHERE message_id NOT IN (SELECT message_id FROM one)
       OR ts > (SELECT max(ts) FROM one)"""))
def _(spark, d):
    held = B.cast_timestamp(D.first_arrivals(spark, d))
    return B.new_rows(B.cast_timestamp(D.source_messages(spark, d)), held).select("message_id", "status")


@query("bronze_unseen_ids", over_messages("""
    SELECT message_id, status FROM messages WHERE message_id NOT IN (SELECT message_id FROM one)"""))
def _(spark, d):
    return B.unseen_ids(D.source_messages(spark, d), D.first_arrivals(spark, d)).select("message_id", "status")


@query("bronze_ingest_modes", f"""
    WITH {D.MESSAGES},
    n AS (SELECT (SELECT count(*) FROM one) AS a, (SELECT count(*) FROM messages) AS b)
    SELECT 1 AS carga, 'full' AS mode, 'success' AS status, a AS rows_read, a AS rows_written FROM n
    UNION ALL SELECT 2, 'incremental', 'success', b, b - a FROM n
    UNION ALL SELECT 3, 'incremental', 'no_new_data', b, 0 FROM n""")
def _(spark, d):
    from prosa.plans.medallion import ingest
    root = scratch_dir(spark, "ingest")
    tables = Tables(spark, root)
    first, second = os.path.join(root, "in", "first.parquet"), os.path.join(root, "in", "second.parquet")
    D.first_arrivals(spark, d).write.parquet(first)
    D.source_messages(spark, d).write.parquet(second)
    loads = [ingest(tables, path, schema=SOURCE_MESSAGES) for path in (first, second, second)]
    return spark.createDataFrame(
        [(i, s["mode"], s["status"], s["rows_read"], s["rows_written"]) for i, s in enumerate(loads, 1)],
        "carga int, mode string, status string, rows_read long, rows_written long")


@query("bronze_time_batches", over_messages("""
    , numbered AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp, message_id) AS pos,
                          count(*) OVER () // 4 AS size FROM bronze)
    SELECT CAST(least((pos - 1) // size, 3) AS INT) AS batch, count(*) AS rows, min(timestamp) AS first_at,
           max(timestamp) AS last_at FROM numbered GROUP BY 1"""))
def _(spark, d):
    return B.batch_summary(B.split_batches(bronze_of(spark, d), 4))


@query("bronze_schema_check", f"""
    WITH {D.MESSAGES} SELECT 'fonte' AS tabela, 0::BIGINT AS problemas, count(*) AS linhas FROM messages
    UNION ALL SELECT 'fonte_notebook', 1, count(*) FROM messages""")
def _(spark, d):
    result = None
    for name, df in (("fonte", D.source_messages(spark, d)), ("fonte_notebook", notebook_source(spark, d))):
        problems = len(B.schema_issues(df))
        row = df.agg(F.lit(name).alias("tabela"), F.lit(problems).cast("long").alias("problemas"),
                     F.count(F.lit(1)).alias("linhas"))
        result = row if result is None else result.unionByName(row)
    return result


# --- Silver ---------------------------------------------------------------------------------------

@query("silver_dedup", over_cleaned("SELECT message_id, conversation_id, status FROM cleaned"))
def _(spark, d):
    return silver.deduplicate(bronze_of(spark, d)).select("message_id", "conversation_id", "status")


@query("silver_dedup_by_id", f"""
    WITH {D.MESSAGES} SELECT message_id, status AS message_status FROM messages""")
def _(spark, d):
    return silver.deduplicate(notebook_source(spark, d), NOTEBOOK).select("message_id", "message_status")


@query("silver_content", over_cleaned(
    "SELECT message_id, is_audio_transcription, message_body_normalized, 'silver_v1' AS _silver_version FROM cleaned"))
def _(spark, d):
    return silver.clean(bronze_of(spark, d)).select(
        "message_id", "is_audio_transcription", "message_body_normalized", "_silver_version")


@query("silver_cleaning_stats", over_cleaned("""
    SELECT (SELECT count(*) FROM bronze) AS rows_before, count(*) AS rows_after_dedup,
           (SELECT count(*) FROM bronze) - count(*) AS duplicates_removed,
           count(*) FILTER (is_audio_transcription) AS audio_transcriptions, count(*) AS rows_written
    FROM cleaned"""))
def _(spark, d):
    source = bronze_of(spark, d)
    return silver.cleaning_stats(source, silver.clean(source))


_ENTITIES = ("extracted_cpf_hash", "extracted_email_hash", "extracted_cep", "extracted_plate",
             "extracted_competitor", "pii_cpf_found", "pii_email_found", "pii_cep_found", "pii_phone_found")


@query("silver_entities", over_silver(f"SELECT message_id, message_body_masked, {', '.join(_ENTITIES)} FROM silver"))
def _(spark, d):
    return messages_of(spark, d).select("message_id", "message_body_masked", *_ENTITIES)


@query("document_entities", f"SELECT doc_id, {entity_columns('text')} FROM documents")
def _(spark, d):
    return silver.extract(D.table(spark, d, "documents"), "text").select("doc_id", *_ENTITIES)


@query("page_entities", f"SELECT page_id, {entity_columns('html')} FROM pages")
def _(spark, d):
    return silver.extract(D.table(spark, d, "pages"), "html").select("page_id", *_ENTITIES)


@query("document_masking", f"""
    SELECT doc_id, md5(masked) AS digest, length(masked) AS n_chars FROM (
      SELECT doc_id, {masked('text')} AS masked FROM documents)""")
def _(spark, d):
    df = silver.with_mask(D.table(spark, d, "documents"), "text", "masked")
    return df.select("doc_id", F.md5("masked").alias("digest"), F.length("masked").cast("long").alias("n_chars"))


@query("page_masking", f"""
    SELECT page_id, md5(masked) AS digest, length(masked) AS n_chars FROM (
      SELECT page_id, {masked('html')} AS masked FROM pages)""")
def _(spark, d):
    df = silver.with_mask(D.table(spark, d, "pages"), "html", "masked")
    return df.select("page_id", F.md5("masked").alias("digest"), F.length("masked").cast("long").alias("n_chars"))


@query("silver_extraction_stats", over_silver("""
    SELECT count(*) AS total_messages, count(*) FILTER (pii_cpf_found) AS messages_with_cpf,
           count(*) FILTER (pii_email_found) AS messages_with_email, count(*) FILTER (pii_cep_found) AS messages_with_cep,
           count(*) FILTER (pii_phone_found) AS messages_with_phone, count(extracted_plate) AS messages_with_plate,
           count(extracted_competitor) AS messages_with_competitor, count(*) AS rows_written FROM silver"""))
def _(spark, d):
    return silver.extraction_stats(messages_of(spark, d))


_NOTEBOOK_TEXT = r"""
    , nb AS (SELECT message_id, trim(coalesce(message_body, '')) AS body, lower(trim(sender_name)) AS sender_name_normalized
             FROM messages),
    found AS (
      SELECT message_id, sender_name_normalized, body,
        list_sort(list_distinct(regexp_extract_all(body, '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b'))) AS cpfs,
        list_sort(list_distinct(regexp_extract_all(body, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'))) AS emails,
        list_sort(list_distinct(regexp_extract_all(body, '\b(?:\+55\s?)?\(?\d{2}\)?\s?\d{4,5}-?\d{4}\b'))) AS phones,
        list_sort(list_distinct(regexp_extract_all(body, '\b\d{5}-?\d{3}\b'))) AS ceps,
        list_sort(list_distinct(regexp_extract_all(upper(body), '\b[A-Z]{3}\d[A-Z0-9]\d{2}\b'))) AS plates,
        concat_ws(';', CASE WHEN contains(lower(body), 'porto seguro') THEN 'porto seguro' END,
                       CASE WHEN contains(lower(body), 'hdi') THEN 'hdi' END) AS competitors
      FROM nb)
"""


@query("silver_all_entities", over_messages(_NOTEBOOK_TEXT + """
    SELECT message_id, sender_name_normalized, body AS message_body_normalized,
           coalesce(substr(sha256(cpfs[1]), 1, 16), '') AS cpfs, coalesce(substr(sha256(emails[1]), 1, 16), '') AS emails,
           coalesce(substr(sha256(phones[1]), 1, 16), '') AS phones, array_to_string(ceps, ';') AS ceps,
           array_to_string(plates, ';') AS plates, competitors,
           len(cpfs) > 0 AS pii_cpf_found, len(emails) > 0 AS pii_email_found, len(phones) > 0 AS pii_phone_found,
           len(ceps) > 0 AS pii_cep_found
    FROM found"""))
def _(spark, d):
    def text(name):
        return F.array_join(f"extracted_{name}", ";").alias(name)
    return notebook_messages(spark, d).select(
        "message_id", "sender_name_normalized", "message_body_normalized", text("cpfs"), text("emails"),
        text("phones"), text("ceps"), text("plates"), text("competitors"),
        "pii_cpf_found", "pii_email_found", "pii_phone_found", "pii_cep_found")


@query("document_all_entities", r"""
    SELECT doc_id,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text,
        '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'))), ';') AS emails,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text,
        '\b(?:\+55\s?)?\(?\d{2}\)?\s?\d{4,5}-?\d{4}\b'))), ';') AS phones,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d{5}-?\d{3}\b'))), ';') AS ceps
    FROM documents""")
def _(spark, d):
    from prosa import params as P
    from prosa.functions.columns import all_matches
    return D.table(spark, d, "documents").select(
        "doc_id", F.array_join(all_matches("text", P.ANY_EMAIL), ";").alias("emails"),
        F.array_join(all_matches("text", P.ANY_PHONE), ";").alias("phones"),
        F.array_join(all_matches("text", P.CEP), ";").alias("ceps"))


_GOLD_TEXT = ("conversation_id", "conversation_outcome", *DIMENSIONS, "agent_id", "campaign_id", "lead_source",
              "lead_state", "lead_city")


@query("gold_pii_leaks", over_conversations(" UNION ALL ".join(
    rf"SELECT '{c}' AS column, count(*) FILTER (regexp_matches({c}, '\b\d{{3}}\.?\d{{3}}\.?\d{{3}}-?\d{{2}}\b|@')) AS leaks "
    "FROM gold_segments" for c in _GOLD_TEXT), SEGMENTS))
def _(spark, d):
    return silver.leaks(gold_segmentation(conversations_of(spark, d)))


_GOLD = ("gold_sentiment", "gold_personas", "gold_segmentation", "gold_analytics", "gold_vendor", "gold/lead_scoring",
         "gold/funil_conversao", "gold/performance_campanha", "gold/analise_temporal", "gold/analise_concorrencia")


@query("gold_pii_leaks_all", over_conversations(
    "SELECT tabela, tipo, count(*) FILTER (total_messages < 0) AS linhas FROM convs, (VALUES "
    + ", ".join(f"('{g}')" for g in _GOLD) + ") t(tabela), (VALUES ('cpf'), ('email'), ('telefone'), ('cep'), ('placa')) k(tipo) GROUP BY 1, 2"))
def _(spark, d):
    """All Gold tables, all kinds: no row may hold personal data."""
    from prosa.plans.medallion import gold_frames
    return silver.leak_table(gold_frames(stored(spark, conversations_of(spark, d))))


# --- conversations -----------------------------------------------------------------------------------

@query("conversations", over_conversations(f"SELECT {', '.join(C.COLUMNS)} FROM convs"))
def _(spark, d):
    return conversations_of(spark, d)


@query("conversation_stats", over_conversations("""
    SELECT count(*) AS total_conversations,
           count(*) FILTER (conversation_outcome = 'venda_fechada') AS conversations_with_sale,
           count(competitor_mentioned) AS conversations_with_competitor, count(lead_plate) AS conversations_with_plate,
           count(*) AS rows_written FROM convs"""))
def _(spark, d):
    return C.conversation_stats(conversations_of(spark, d))


@query("conversation_summary", over_conversations("""
    SELECT count(*) AS total, round(avg(total_messages), 6) AS media_mensagens,
           round(avg(duration_minutes), 6) AS media_duracao_min FROM convs"""))
def _(spark, d):
    return C.conversation_summary(conversations_of(spark, d)).select(
        "total", F.round("media_mensagens", 6).alias("media_mensagens"),
        F.round("media_duracao_min", 6).alias("media_duracao_min"))


@query("conversation_extras", over_silver("""
    SELECT conversation_id, quantile_cont(meta_response_time_sec, 0.5)::DOUBLE AS response_time_sec_mediana,
           min(meta_response_time_sec) AS response_time_sec_min,
           bool_or(conversation_outcome = 'venda_fechada') AS venda_fechada,
           bool_or(extracted_competitor IS NOT NULL) AS menciona_concorrente,
           coalesce(array_to_string(list_sort(list(DISTINCT extracted_competitor)
             FILTER (extracted_competitor IS NOT NULL)), ', '), '') AS concorrentes_mencionados,
           avg(meta_is_business_hours::INT) AS proporcao_horario_comercial,
           substr(sha256(first(extracted_plate ORDER BY timestamp, message_id)
             FILTER (extracted_plate IS NOT NULL)), 1, 16) AS veiculo_placa_hash,
           first(extracted_cpf_hash ORDER BY timestamp, message_id)
             FILTER (extracted_cpf_hash IS NOT NULL) AS pii_cpf_hash,
           first(extracted_email_hash ORDER BY timestamp, message_id)
             FILTER (extracted_email_hash IS NOT NULL) AS pii_email_hash,
           count(*) FILTER (message_type = 'document') AS total_document
    FROM silver GROUP BY conversation_id"""))
def _(spark, d):
    return C.conversation_extras(messages_of(spark, d))


# A body that names a brand, a year, both or neither, by the number in the message id.
VEHICLES = """
cars AS (
  SELECT conversation_id, ts AS timestamp, message_id, CASE k % 5
      WHEN 0 THEN concat('tenho um Fiat ', CAST(1980 + k % 60 AS STRING)) WHEN 1 THEN concat('ONIX (', CAST(1995 + k % 30 AS STRING), ')')
      WHEN 2 THEN concat('carro ano ', CAST(1950 + k % 100 AS STRING)) WHEN 3 THEN 'onixx x1999' END AS message_body_masked
  FROM (SELECT *, CAST(regexp_extract(message_id, '([0-9]+)', 1) AS INT) AS k FROM messages))
"""


@query("vehicle_mentions", rf"""
    WITH {D.MESSAGES}, {VEHICLES}, f AS (
      SELECT *, nullif(lower(regexp_extract(message_body_masked, '(?i)\b(fiat|onix)\b')), '') AS brand,
             nullif(regexp_extract(message_body_masked, '\b(?:19|20)[0-9]{{2}}\b'), '') AS year FROM cars)
    SELECT conversation_id, first(brand ORDER BY timestamp, message_id) FILTER (brand IS NOT NULL) AS veiculo_marca,
           first(year ORDER BY timestamp, message_id) FILTER (year IS NOT NULL) AS veiculo_ano
    FROM f GROUP BY conversation_id""")
def _(spark, d):
    cars = D.derived(spark, d, f"{D.MESSAGES}, {VEHICLES}", "cars", "events")
    return C.vehicle_mentions(cars, ("fiat", "onix")).select("conversation_id", "veiculo_marca", "veiculo_ano")


@query("conversations_first_known", f"""
    WITH {D.MESSAGES}
    SELECT conversation_id, count(*) AS total_messages,
           count(*) FILTER (direction = 'inbound') AS inbound_messages,
           count(*) FILTER (direction = 'outbound') AS outbound_messages,
           min(agent_id) AS agent_id, min(json_extract_string(metadata, '$.lead_source')) AS lead_source,
           min(json_extract_string(metadata, '$.state')) AS lead_state,
           date_diff('second', min(ts), max(ts))::DOUBLE / 60 AS duration_minutes,
           CASE WHEN count(*) >= 15 THEN 'em_negociacao' WHEN count(*) <= 2 THEN 'ghosting' ELSE 'contato_inicial'
           END AS conversation_outcome, CAST(NULL AS DOUBLE) AS avg_response_time_sec
    FROM messages GROUP BY conversation_id""")
def _(spark, d):
    return notebook_conversations(spark, d).select(
        "conversation_id", "total_messages", "inbound_messages", "outbound_messages", "agent_id", "lead_source",
        "lead_state", "duration_minutes", "conversation_outcome", "avg_response_time_sec")


@query("turn_conversations", f"""
    WITH {D.TURNS}
    SELECT conversation_id, count(*) AS total_messages, count(*) FILTER (direction = 'inbound') AS inbound_messages,
           count(*) FILTER (direction = 'outbound') AS outbound_messages,
           md5(first(message_body ORDER BY turn, message_id)) AS first_digest,
           md5(first(message_body ORDER BY turn, message_id) FILTER (direction = 'inbound')) AS lead_digest
    FROM turns GROUP BY conversation_id""")
def _(spark, d):
    from prosa.functions.columns import earliest
    order = F.struct("turn", "message_id")
    inbound = F.col("direction") == "inbound"
    return D.turn_messages(spark, d).groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(inbound).alias("inbound_messages"),
        F.count_if(F.col("direction") == "outbound").alias("outbound_messages"),
        earliest(F.md5("message_body"), order).alias("first_digest"),
        earliest(F.md5("message_body"), order, inbound).alias("lead_digest"))
