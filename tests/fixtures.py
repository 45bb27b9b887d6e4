"""Small hand-made tables."""

import datetime as dt
import json

from prosa.schemas import SOURCE_MESSAGES

CONVERSATION_SCHEMA = """
  conversation_id string, first_message_at timestamp, last_message_at timestamp, total_messages long,
  inbound_messages long, outbound_messages long, has_cpf boolean, has_email boolean, has_cep boolean,
  has_phone boolean, lead_plate string, competitor_mentioned string, conversation_outcome string, agent_id string,
  campaign_id string, channel string, lead_source string, lead_city string, lead_state string,
  avg_response_time_sec double, duration_minutes double, conversation_date date"""


def message(mid, conv="c1", at="2026-02-01 09:00:00", direction="outbound", body="oi", status="sent", **more):
    meta = {"device": "android", "city": "Sao Paulo", "state": "SP", "response_time_sec": None,
            "is_business_hours": True, "lead_source": "google_ads"} | more.pop("meta", {})
    row = {
        "message_id": mid, "conversation_id": conv, "timestamp": at, "direction": direction,
        "sender_phone": "+551100000001", "sender_name": "Ana", "message_type": "text", "message_body": body,
        "status": status, "channel": "whatsapp", "campaign_id": "camp_1", "agent_id": "agent_1",
        "conversation_outcome": "venda_fechada", "metadata": json.dumps(meta)}
    return row | more


def source(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in SOURCE_MESSAGES.fields) for r in rows], SOURCE_MESSAGES)


def two_conversations(spark):
    return source(
        spark,
        message("m1", at="2026-02-01 09:00:00"),
        message("m2", at="2026-02-01 09:01:30", direction="inbound", status="read", meta={"response_time_sec": 90}),
        message("m3", "c2", at="2026-02-02 10:00:00", meta={"state": "RJ"}, conversation_outcome="ghosting"),
        message("m4", "c2", at="2026-02-02 10:05:00", direction="inbound", meta={"state": "RJ"},
                conversation_outcome="ghosting"),
    )


def later_batch(spark):
    return source(spark, message("m5", "c3", at="2026-03-01 08:00:00"),
                  message("m6", "c3", at="2026-03-01 08:02:00", direction="inbound"))


# Seven conversations: id, total, inbound, flags (cpf, email, cep, phone), plate, competitor, outcome, agent,
# campaign, source, state, mean response, minutes
SEVEN = [
    ("conv_001", 18, 9, "1110", "SYL8V26", "porto seguro", "venda_fechada", "marcos", "landing", "google_ads", "SP", 90.0, 30.0),
    ("conv_002", 3, 1, "0000", None, None, "ghosting", "marcos", "landing", "facebook", "RJ", 500.0, 5.0),
    ("conv_003", 12, 6, "1001", "ABC1D23", None, "venda_fechada", "ana", "google", "google_ads", "MG", 150.0, 90.0),
    ("conv_004", 2, 0, "0000", None, None, "ghosting", "ana", "google", "facebook", "SP", None, 2.0),
    ("conv_005", 25, 14, "1101", "XYZ9W12", "hdi seguros", "perdido_concorrente", "marcos", "landing", "google_ads", "PR", 45.0, 150.0),
    ("conv_006", 8, 4, "0100", None, "azul seguros", "proposta_enviada", "ana", "google", "indicacao", "SP", 200.0, 270.0),
    ("conv_007", 5, 2, "0000", None, None, "em_negociacao", "ana", "landing", "instagram", "BA", 300.0, 10.0),
]


def seven_conversations(spark):
    rows = []
    for i, (cid, total, inbound, flags, plate, rival, outcome, agent, campaign, origin, state, wait, minutes) in enumerate(SEVEN):
        start = dt.datetime(2026, 2, 1 + i // 2, 9, 0)
        rows.append((cid, start, start + dt.timedelta(minutes=minutes), total, inbound, total - inbound,
                     *[f == "1" for f in flags], plate, rival, outcome, agent, campaign, "whatsapp", origin, "X", state,
                     wait, minutes, start.date()))
    return spark.createDataFrame(rows, CONVERSATION_SCHEMA)


def by(df, key):
    return {r[key]: r for r in df.collect()}
