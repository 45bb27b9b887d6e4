import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fixtures import by
from prosa.operators import ordering, runlog, usage
from prosa.schemas import AGENT_ACTIONS, PIPELINE_RUNS, STEP_RUNS

T0 = dt.datetime(2026, 2, 1, 9)


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([
        ("r1", "completed", at(0), at(10.5), "bronze,silver", "manual"),
        ("r2", "failed", at(100), at(130), "bronze", "schedule"),
        ("r3", "running", at(200), None, "gold", "manual")], PIPELINE_RUNS)


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([
        ("s1", "r1", "bronze", "completed", at(0), at(4), 5, 5, None),
        ("s2", "r1", "silver", "completed", at(4), at(10), 5, 4, ""),
        ("s4", "r2", "silver", "failed", at(120), at(130), 1, 0, "second"),
        ("s3", "r2", "bronze", "failed", at(100), at(120), 1, 0, "first")], STEP_RUNS)


def action(i, sec, agent="a", model="gpt-4o", tin=1000, tout=1000, ok=True):
    return (f"x{i:05d}", agent, "do", at(sec), "", "", model, tin, tout, None, ok, None)


def test_runs(runs, steps):
    rows = by(runlog.run_summary(runs, steps), "run_id")
    assert (rows["r1"]["steps_ok"], rows["r1"]["steps_total"], rows["r1"]["total_rows"], rows["r1"]["first_error"]) == (2, 2, 9, None)
    assert rows["r2"]["first_error"] == "first" and rows["r1"]["duration_sec"] == 10.5
    assert rows["r3"]["steps_total"] == 0 and rows["r3"]["duration_sec"] is None
    assert set(by(runlog.run_summary(runs, steps, ["completed", "failed"], ["manual"]), "run_id")) == {"r1"}
    detail = [(r["run_id"], r["step_id"]) for r in runlog.runs_with_steps(runs, steps, 2).collect()]
    assert detail == [("r3", None), ("r2", "s3"), ("r2", "s4")]
    assert runlog.run_totals(runs).first().asDict() == {"total_runs": 3, "runs_completas": 1, "runs_com_falha": 1}
    assert {(r["status"], r["runs"]) for r in runlog.run_counts(runs).collect()} == {("completed", 1), ("failed", 1), ("running", 1)}


def test_upsert_by_reading(spark, runs):
    newer = runs.where("run_id = 'r3'").withColumns({"status": F.lit("completed"), "completed_at": F.lit(at(260))})
    log = runs.unionByName(newer)
    state = by(runlog.current(log, "run_id", [F.desc_nulls_last("completed_at")]), "run_id")
    assert len(state) == 3 and state["r3"]["status"] == "completed"


def test_nested_steps(spark):
    text = '[{"step_id":"s1","step_name":"bronze","rows_output":3},{"step_id":"s2","step_name":"gold"}]'
    rows = runlog.steps_from_json(spark.createDataFrame([("r1", text)], "run_id string, steps_json string")).collect()
    assert [(r["step_id"], r["rows_output"]) for r in rows] == [("s1", 3), ("s2", None)]


def test_step_results(spark):
    df = runlog.step_results(spark, [("01", "sucesso", 1.5, 10, None, "t"), ("02", "falha", 0.5, None, "e", "t")])
    assert runlog.step_result_totals(df).first().asDict() == {
        "notebooks": 2, "duracao_total_sec": 2.0, "total_rows": 10, "falhas": 1}


def test_cost_and_agents(spark):
    rows = [action(1, 0), action(2, 1, model="unknown"), action(3, 2, agent="b", ok=False, model="")]
    actions = usage.with_cost(spark.createDataFrame(rows, AGENT_ACTIONS))
    cost = by(actions, "action_id")
    assert abs(cost["x00001"]["cost"] - 0.0125) < 1e-12 and cost["x00002"]["cost"] == 0.0
    assert actions.columns == AGENT_ACTIONS.names
    agents = by(runlog.agent_metrics(actions), "agent_name")
    assert agents["a"]["modelos"] == "gpt-4o, unknown" and agents["b"]["modelos"] == "" and agents["b"]["taxa_sucesso_pct"] == 0
    totals = usage.usage_totals(actions).first()
    assert totals["input_tokens"] == 3000
    assert usage.usage_totals(actions.where("false")).first().asDict() == {"custo_total_usd": 0.0, "input_tokens": 0, "output_tokens": 0}
    assert [r["action_id"] for r in runlog.recent_actions(actions, 1).collect()] == ["x00003"]
    assert [r["action_id"] for r in runlog.recent_actions(actions, 5, "a").collect()] == ["x00002", "x00001"]


def test_budget(spark):
    actions = spark.createDataFrame([action(i, i) for i in range(4)], AGENT_ACTIONS).withColumn("cost", F.lit(2.0))
    rows = by(usage.budget(actions, 5.0), "action_id")
    assert [rows[f"x0000{i}"]["orcamento_restante"] for i in range(4)] == [3.0, 1.0, 0.0, 0.0]
    assert [rows[f"x0000{i}"]["orcamento_excedido"] for i in range(4)] == [False, False, True, True]


def test_rolling_tokens_against_brute_force(spark):
    rng = random.Random(1)
    seconds = [0, 60, 60.000001, 119.999999, 120] + [round(rng.random() * 400, 6) for _ in range(300)] + [50.0] * 100
    calls = [action(i, s, tin=rng.randint(1, 90), tout=0) for i, s in enumerate(seconds)]
    got = {r["timestamp"]: r["tokens_60s"] for r in usage.rolling_tokens(spark.createDataFrame(calls, AGENT_ACTIONS), limit=500).collect()}
    for call in calls:
        moment = call[3]
        start = moment - dt.timedelta(seconds=60)
        assert got[moment] == sum(c[7] + c[8] for c in calls if start <= c[3] <= moment)


def test_running_sum_against_brute_force(spark):
    """Half of the rows share one moment and one group; some have no time and come first."""
    rng, start = random.Random(2), dt.datetime(2026, 2, 1)
    times = [None if rng.random() < 0.1 else start + dt.timedelta(minutes=rng.randint(0, 9000)) for _ in range(400)]
    rows = [(f"i{i:04d}", "hot" if i % 2 else rng.choice(["a", None]), start if i % 2 else t, rng.randint(1, 5)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id string, g string, t timestamp, v int").repartition(5)
    total = by(ordering.running_sum(df, F.col("v"), ("t", "id"), "s"), "id")
    group = by(ordering.running_sum(df, F.col("v"), ("t", "id"), "s", ["g"]), "id")
    place = by(ordering.position(df, ("t", "id")), "id")
    ordered = sorted(rows, key=lambda r: (r[2] is not None, r[2] or start, r[0]))
    seen, per = 0, {}
    for n, (rid, g, _, v) in enumerate(ordered, 1):
        seen, per[g] = seen + v, per.get(g, 0) + v
        assert (total[rid]["s"], group[rid]["s"], place[rid]["position"]) == (seen, per[g], n)


def test_rank_by(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "k string, v double")
    assert {k: r["p"] for k, r in by(ordering.rank_by(df, "v", "p"), "k").items()} == {"b": 1, "c": 1, "a": 3, "d": 4}
