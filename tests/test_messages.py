import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import by, later_batch, message, source, two_conversations
from prosa.operators import bronze as B
from prosa.operators import conversations as C
from prosa.operators import silver as S
from prosa.params import NOTEBOOK
from prosa.plans.medallion import build_gold, build_silver, ingest, one_plan
from prosa.sources.tables import Tables


def bronze(df):
    return B.to_bronze(df, "memory")


# --- Bronze ---------------------------------------------------------------------------------------

def test_schema_issues(spark):
    df = two_conversations(spark)
    assert B.schema_issues(df) == []
    assert B.schema_issues(df.drop("metadata", "status")) == ["Missing columns: ['metadata', 'status']"]
    assert B.schema_issues(df.where("false")) == ["DataFrame is empty"]
    assert B.extra_columns(df.withColumn("more", F.lit(1))) == ["more"]
    with pytest.raises(B.SchemaValidationError):
        B.require_valid(df.drop("metadata"))


def test_metadata_and_time(spark):
    rows = by(bronze(two_conversations(spark)), "message_id")
    assert rows["m1"]["meta_city"] == "Sao Paulo" and rows["m3"]["meta_state"] == "RJ"
    assert rows["m1"]["meta_response_time_sec"] is None and rows["m2"]["meta_response_time_sec"] == 90
    assert rows["m1"]["meta_is_business_hours"] is True
    assert rows["m2"]["timestamp"] == dt.datetime(2026, 2, 1, 9, 1, 30)
    assert rows["m1"]["_source_file"] == "memory" and rows["m1"]["metadata"].startswith("{")


def test_bad_text(spark):
    df = source(spark, message("a", metadata="{no json"), message("b"))
    assert B.bad_metadata(df).first().asDict() == {"rows": 2, "bad_rows": 1}
    with pytest.raises(Exception):
        B.parse_metadata(df, mode="FAILFAST").collect()
    late = source(spark, message("a", at="01/02/2026"))
    with pytest.raises(Exception):
        B.cast_timestamp(late).collect()
    assert B.cast_timestamp(late, strict=False).first()["timestamp"] is None


def test_new_rows_keeps_old_ids_with_later_times(spark):
    held = bronze(two_conversations(spark))
    incoming = B.cast_timestamp(source(
        spark, message("m1", at="2026-02-01 09:00:00"), message("m2", at="2026-02-05 00:00:00"),
        message("m9", at="2026-01-01 00:00:00")))
    assert sorted(r[0] for r in B.new_rows(incoming, held).select("message_id").collect()) == ["m2", "m9"]
    assert [r[0] for r in B.unseen_ids(incoming, held).select("message_id").collect()] == ["m9"]
    assert B.new_rows(incoming, held.where("false")).count() == 3


def test_ingest_modes(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "data"))
    first, second = str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet")
    two_conversations(spark).write.parquet(first)
    later_batch(spark).write.parquet(second)
    load = ingest(tables, first)
    assert (load["mode"], load["rows_written"], load["total_rows"]) == ("full", 4, 4)
    again = ingest(tables, first)
    assert (again["status"], again["rows_written"]) == ("no_new_data", 0)
    more = ingest(tables, second)
    assert (more["mode"], more["rows_written"], more["total_rows"]) == ("incremental", 2, 6)
    assert tables.read("bronze", as_of=0).count() == 4
    assert ingest(tables, first, mode="full")["total_rows"] == 4
    with pytest.raises(ValueError):
        ingest(tables, first, mode="sometimes")


def test_split_batches(spark):
    df = B.cast_timestamp(source(spark, *[message(f"m{i}", at=f"2026-02-01 09:00:0{i % 3}") for i in range(10)]))
    sizes = {r["batch"]: r["rows"] for r in B.batch_summary(B.split_batches(df, 4)).collect()}
    assert sizes == {0: 2, 1: 2, 2: 2, 3: 4}
    ends = {r["batch"]: (r["first_at"], r["last_at"]) for r in B.batch_summary(B.split_batches(df, 4)).collect()}
    assert all(ends[i][1] <= ends[i + 1][0] for i in range(3))
    assert [r["batch"] for r in B.split_batches(df.limit(2), 4).collect()] == [3, 3]


# --- Silver -----------------------------------------------------------------------------------------

def test_dedup_keeps_best_status(spark):
    df = bronze(source(
        spark, message("a", status="sent"), message("b", status="delivered"), message("c", status="read", body="x"),
        message("d", status="failed", body="x"), message("e", body=None, status="sent"),
        message("f", body=None, status="queued"), message("g", body="y", status="sent"), message("h", body="y", status="sent")))
    kept = {r["message_id"] for r in S.deduplicate(df).collect()}
    assert kept == {"b", "c", "e", "g"}


def test_dedup_by_id(spark):
    df = source(spark, message("a", status="sent"), message("a", status="read"), message("b", status="odd"))
    kept = S.deduplicate(df.withColumnRenamed("status", "message_status"), NOTEBOOK)
    assert {(r["message_id"], r["message_status"]) for r in kept.collect()} == {("a", "read"), ("b", "odd")}


def test_dedup_limits_copies_before_the_shuffle(spark):
    plan = S.deduplicate(bronze(two_conversations(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_content_flags(spark):
    df = source(spark, message("a", body="[audio transcrito]  tenho um carro  "), message("b", body=" oi "),
                message("c", body=None), message("d", body="x [audio transcrito] y"))
    rows = by(S.content_flags(df), "message_id")
    assert rows["a"]["is_audio_transcription"] and rows["a"]["message_body_normalized"] == "tenho um carro"
    assert rows["b"]["message_body_normalized"] == " oi " and not rows["b"]["is_audio_transcription"]
    assert rows["c"]["is_audio_transcription"] is None and rows["c"]["message_body_normalized"] is None
    assert not rows["d"]["is_audio_transcription"]
    note = by(S.content_flags(df.withColumn("message_body", F.regexp_replace("message_body", "audio transcrito", "TRANSCRIção de áudio")), NOTEBOOK), "message_id")
    assert note["d"]["is_audio_transcription"] and note["c"]["message_body_normalized"] == ""
    assert note["a"]["sender_name_normalized"] == "ana"


def test_silver_layer(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.overwrite(bronze(source(
        spark, message("m1", status="sent"), message("m2", status="delivered"),
        message("m3", at="2026-02-01 09:01:30", direction="inbound",
                body="meu cpf eh 383.182.856-05, cep 08617-986 e email joao@example.com"),
        message("m4", "c2", body="Bom dia!", conversation_outcome="ghosting"),
        message("m5", "c2", at="2026-02-01 10:05:00", direction="inbound", message_type="audio", sender_name="Joao",
                body="[audio transcrito] tenho um Onix 2022 placa SYL8V26", conversation_outcome="ghosting"))), "bronze")
    stats = build_silver(tables)
    expected = {"rows_before": 5, "rows_after_dedup": 4, "duplicates_removed": 1, "audio_transcriptions": 1,
                "messages_with_cpf": 1, "messages_with_cep": 1, "messages_with_email": 1, "messages_with_plate": 1,
                "total_conversations": 2, "conversations_with_sale": 1, "conversations_with_plate": 1}
    assert {k: stats[k] for k in expected} == expected
    messages = by(tables.read("silver_messages"), "message_id")
    assert "383" not in messages["m3"]["message_body_masked"] and len(messages["m3"]["extracted_cpf_hash"]) == 16
    convs = by(tables.read("silver_conversations"), "conversation_id")
    assert convs["c2"]["lead_plate"] == "SYL8V26" and convs["c2"]["lead_name"] == "Joao"
    assert convs["c1"]["duration_minutes"] == 1.5 and convs["c1"]["has_cpf"]
    assert convs["c1"]["lead_cep"] == "08617986"
    rows = build_gold(tables)
    assert rows["gold_sentiment"] == rows["gold_personas"] == rows["gold_segmentation"] == rows["gold_analytics"] == 2
    assert rows["gold_vendor"] == 1 and rows["gold/funil_conversao"] == 2
    for name in tables.gold_tables():
        df = tables.read(f"{tables.root}/gold/{name}")
        texts = [n for n, k in df.dtypes if k == "string"]
        if texts:
            assert all(r["leaks"] == 0 for r in S.leaks(df, texts).collect())


# --- conversations ------------------------------------------------------------------------------------

def test_first_values_follow_time_then_id(spark):
    df = source(
        spark,
        message("b", at="2026-02-01 08:00:00", body="um", agent_id="late"), message("d0", body="dois", agent_id="early"),
        message("a", at="2026-02-01 08:00:00", agent_id=None, body="placa XYZ9W12"),
        message("d", at="2026-02-01 09:30:00", body="placa ABC1D23", direction="inbound", sender_name="Lead"))
    row = one_plan(df).first()
    assert row["agent_id"] is None  # the first row decides, also with a null
    assert row["lead_plate"] == "XYZ9W12" and row["lead_name"] == "Lead"
    assert (row["total_messages"], row["inbound_messages"], row["outbound_messages"]) == (4, 1, 3)
    assert row["avg_response_time_sec"] is None and row["duration_minutes"] == 90.0
    quiet = one_plan(source(spark, message("z", "c9"))).first()
    assert quiet["lead_phone"] is None and quiet["duration_minutes"] == 0.0


def test_extras_and_vehicle(spark):
    df = S.silver_messages(bronze(source(
        spark, message("a", body="HDI Seguros?", meta={"response_time_sec": 10}),
        message("b", at="2026-02-01 09:01:00", body="porto seguro, onix 2022", meta={"response_time_sec": 40, "is_business_hours": False}))))
    row = C.conversation_extras(df).first()
    assert row["concorrentes_mencionados"] == "hdi seguros, porto seguro"
    assert row["response_time_sec_mediana"] == 25.0 and row["response_time_sec_min"] == 10
    assert row["proporcao_horario_comercial"] == 0.5 and row["venda_fechada"] and row["menciona_concorrente"]
    car = C.vehicle_mentions(df, ("onix", "gol")).first()
    assert (car["veiculo_marca"], car["veiculo_ano"]) == ("onix", "2022")


def test_notebook_conversations(spark):
    df = source(spark, *[message(f"m{i}", at=f"2026-02-01 09:00:0{i}", agent_id=None if i == 0 else "x") for i in range(3)])
    df = df.withColumnRenamed("status", "message_status").withColumn("lead_source", F.lit("google")).drop("conversation_outcome")
    assert B.schema_issues(df, NOTEBOOK) == []
    row = one_plan(df, NOTEBOOK).first()
    assert row["agent_id"] == "x" and row["conversation_outcome"] == "contato_inicial"
    assert row["avg_response_time_sec"] is None and row["lead_city"] == "Sao Paulo"


def test_one_task_does_not_need_a_whole_conversation(spark):
    """Partial aggregation stands before the shuffle by conversation."""
    plan = one_plan(two_conversations(spark))._jdf.queryExecution().executedPlan().toString()
    head = plan[:plan.index("hashpartitioning(conversation_id") + 4000]
    assert "partial_min_by" in plan and "partial_count" in head


def test_notebook_layers(spark, tmp_path):
    tables, path = Tables(spark, str(tmp_path / "data")), str(tmp_path / "in.parquet")
    df = two_conversations(spark).withColumnRenamed("status", "message_status").withColumn(
        "lead_source", F.lit("Indicação")).drop("conversation_outcome")
    df.write.parquet(path)
    assert ingest(tables, path, profile=NOTEBOOK)["rows_written"] == 4
    assert ingest(tables, path, profile=NOTEBOOK)["status"] == "no_new_data"
    assert build_silver(tables, NOTEBOOK)["rows_after_dedup"] == 4
    rows = build_gold(tables, NOTEBOOK)
    assert rows == {"gold_sentiment": 2, "gold_personas": 2, "gold_segmentation": 2, "gold_analytics": 2, "gold_vendor": 1}
    seg = tables.read("gold_segmentation").first()
    assert seg["seg_origem"] == "indicacao" and seg["seg_duracao"] == "instantanea" or seg["seg_duracao"] in ("flash", "curta")


def test_leaks_are_found_in_any_table(spark):
    clean = spark.createDataFrame([("a", 1), (None, 2)], "t string, n int")
    dirty = spark.createDataFrame([("fone (11) 98123-4012", "x"), ("a@b.com", "placa abc1d23"), ("383.182.856-01", None)], "a string, b string")
    got = {(r["tabela"], r["tipo"]): r["linhas"] for r in S.leak_table({"clean": clean, "dirty": dirty, "numbers": clean.select("n")}).collect()}
    assert all(n == 0 for (table, _), n in got.items() if table != "dirty")
    assert got["dirty", "cpf"] == got["dirty", "email"] == got["dirty", "placa"] == 1 and got["dirty", "telefone"] >= 1
