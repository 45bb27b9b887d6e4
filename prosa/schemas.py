"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOLEAN, TIMESTAMP = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SOURCE_COLUMNS = (
    "message_id", "conversation_id", "timestamp", "direction", "sender_phone", "sender_name",
    "message_type", "message_body", "status", "channel", "campaign_id", "agent_id",
    "conversation_outcome", "metadata",
)

SOURCE_MESSAGES = _struct(**{name: STRING for name in SOURCE_COLUMNS})

METADATA = _struct(
    device=STRING, city=STRING, state=STRING, response_time_sec=LONG,
    is_business_hours=BOOLEAN, lead_source=STRING,
)

PIPELINE_RUNS = _struct(
    run_id=STRING, status=STRING, started_at=TIMESTAMP, completed_at=TIMESTAMP,
    layers=STRING, trigger=STRING,
)

STEP_RUNS = _struct(
    step_id=STRING, run_id=STRING, step_name=STRING, status=STRING, started_at=TIMESTAMP,
    completed_at=TIMESTAMP, rows_input=LONG, rows_output=LONG, error_message=STRING,
)

AGENT_ACTIONS = _struct(
    action_id=STRING, agent_name=STRING, action=STRING, timestamp=TIMESTAMP,
    input_summary=STRING, output_summary=STRING, model_used=STRING, input_tokens=LONG,
    output_tokens=LONG, cost=DOUBLE, success=BOOLEAN, error_message=STRING,
)

ALERTS = _struct(
    alert_id=STRING, severity=STRING, title=STRING, message=STRING, timestamp=TIMESTAMP,
    resolved=BOOLEAN, source=STRING,
)

NOTEBOOK_RUNS = _struct(
    notebook=STRING, status=STRING, duration_sec=DOUBLE, rows_written=LONG, error=STRING,
    timestamp=STRING,
)

STEPS_JSON = T.ArrayType(STEP_RUNS)
