import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import by
from prosa.operators import quality as Q


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "a", 1.5), (2, "b", 2.5), (3, None, 0.0), (4, "d", -0.0), (5, "a", None)], "id long, nome string, valor double")


def test_nulls_and_integrity(spark, people):
    rows = by(Q.null_counts(people), "coluna")
    assert (rows["nome"]["nulos"], rows["nome"]["percentual"], rows["id"]["nulos"]) == (1, 20.0, 0)
    health = Q.integrity(people, "p").first()
    assert (health["total_nulos"], health["percentual_nulos"], health["score_saude"], health["status"]) == (2, 13.33, 73.3, "saudavel")
    empty = Q.integrity(people.where("false")).first()
    assert (empty["score_saude"], empty["total_linhas"]) == (100.0, 0)
    hollow = people.select(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(4)])
    worst = Q.integrity(hollow, "oco")
    assert (worst.first()["score_saude"], worst.first()["status"]) == (30.0, "critico")
    alert = Q.health_alerts(Q.health_sweep({"oco": hollow, "p": people})).collect()
    assert [a["message"] for a in alert] == ["oco: score 30.0"] and alert[0]["severity"] == "warning"


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)], "id string, val int")
    row = Q.duplicates(df, ["id", "unknown"]).first()
    assert (row["total_linhas"], row["linhas_unicas"], row["duplicatas"], row["percentual_duplicatas"]) == (5, 3, 2, 40.0)
    assert Q.duplicates(df).first()["duplicatas"] == 2
    assert Q.duplicates(df.where("false")).first()["percentual_duplicatas"] == 0.0
    with pytest.raises(ValueError):
        Q.duplicates(df, ["x"])


def test_schemas(spark, people):
    other = people.select(F.col("id").cast("int").alias("id"), "nome", F.lit(1).alias("mais"))
    found = Q.compare_schemas(people, other)
    assert found["apenas_tabela_a"] == ["valor"] and found["apenas_tabela_b"] == ["mais"]
    assert found["diferencas_tipo"] == {"id": {"tabela_a": "bigint", "tabela_b": "int"}} and not found["schemas_identicos"]
    assert Q.compare_schemas(people, people)["schemas_identicos"]
    assert by(Q.schema_table(people, other), "coluna")["nome"]["igual"]


def test_allowed_values(spark, people):
    rows = {(r["valor"], r["problema"], r["linhas"]) for r in Q.allowed_values(people, "nome", ["a", "b", "z"]).collect()}
    assert rows == {("d", "inesperado", 1), ("z", "ausente", 0)}
    assert Q.allowed_values(people, "nome", ["a", "b", "d"]).isEmpty()
    with pytest.raises(ValueError):
        Q.allowed_values(people, "x", [1])


@pytest.mark.parametrize("exact", [True, False])
def test_profile(people, exact):
    rows = by(Q.profile(people, exact), "coluna")
    assert (rows["nome"]["tipo"], rows["nome"]["nulos_pct"], rows["nome"]["valores_unicos"]) == ("string", 20.0, 4)
    assert rows["valor"]["valores_unicos"] == 4  # 1.5, 2.5, one zero, null
    assert rows["nome"]["exemplo"] == "a"
    stats = by(Q.column_statistics(people, exact), "coluna")
    assert (stats["id"]["min"], stats["id"]["max"], stats["id"]["media"]) == (1.0, 5.0, 3.0)
    assert stats["nome"]["min"] is None and stats["valor"]["media"] == 1.0
    empty = by(Q.profile(people.where("false"), exact), "coluna")
    assert len(empty) == 3 and empty["nome"]["valores_unicos"] == 0 and empty["nome"]["exemplo"] == ""


def test_classes(spark, people):
    df = people.withColumns({"ok": F.lit(True), "dia": F.lit(dt.date(2026, 1, 1)), "lista": F.array(F.lit(1))})
    rows = by(Q.column_classes(df), "coluna")
    assert {k: r["classe"] for k, r in rows.items()} == {
        "id": "numerica", "nome": "categorica", "valor": "numerica", "ok": "booleana", "dia": "temporal", "lista": "outra"}
    assert rows["nome"]["agrupavel"] and not rows["id"]["agrupavel"]
    assert not by(Q.column_classes(df, most=3), "coluna")["nome"]["agrupavel"]


def test_rows(people):
    assert Q.sample_rows(people, 2, ["id"]).collect() == Q.sample_rows(people.repartition(3), 2, ["id"]).collect()
    assert Q.sample_rows(people, 99, ["id"]).count() == 5
    assert Q.preview(people, 2).count() == 2
    assert Q.first_records_json(people.where("id = 3"), 1).first()["json"] == '{"id":3,"nome":null,"valor":0.0}'
    assert Q.schema_of(people) == {"id": "bigint", "nome": "string", "valor": "double"}


def test_pending(spark):
    bronze = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "k string, v string")
    silver = spark.createDataFrame([("a", None)], "k string, v string")
    assert [r["k"] for r in Q.pending_keys(bronze, silver, ["k", "v"]).collect()] == ["b"]
    assert Q.has_pending(bronze, silver, ["k", "v"]) and Q.has_pending(bronze, None, ["k"])
    assert not Q.has_pending(bronze, bronze.distinct(), ["k", "v"])  # duplicates removed is not new data
