import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixtures import by
from prosa.operators.quality import missing_tables
from prosa.sources.guard import BrokenRules, Guard
from prosa.sources.tables import Tables, append_record, export_csv, nanos_to_timestamp, read_source


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "data"))


def test_append_overwrite_versions(spark, tables):
    one = spark.range(3).withColumn("a", F.lit("x"))
    assert not tables.exists("bronze") and tables.version("bronze") == -1
    assert tables.append(one, "bronze") == 0
    assert tables.append(spark.range(3, 5).withColumn("b", F.lit(1)), "bronze") == 1
    assert tables.exists("bronze") and tables.version("bronze") == 1 and tables.count("bronze") == 5
    assert tables.read("bronze", as_of=0).count() == 3
    assert set(tables.read("bronze").columns) == {"id", "a", "b"}
    tables.append(spark.range(3, 4).withColumn("b", F.lit(2)), "bronze", batch=1)  # a repeated batch replaces itself
    assert tables.count("bronze") == 4
    tables.overwrite(spark.range(2), "bronze")
    assert tables.read("bronze").columns == ["id"] and tables.count("bronze") == 2 and tables.version("bronze") == 0


def test_own_rows_may_replace_a_table(tables, spark):
    tables.overwrite(spark.range(2), "bronze")
    tables.overwrite(tables.read("bronze").where("id > 0"), "bronze")
    assert tables.count("bronze") == 1
    with pytest.raises(ValueError):
        tables.write(spark.range(1), "bronze", "replace")


def test_failed_overwrite_keeps_the_table(tables, spark):
    tables.overwrite(spark.range(4), "bronze")
    with pytest.raises(Exception):
        tables.overwrite(spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id")), "bronze")
    assert tables.exists("bronze") and tables.count("bronze") == 4


def test_rules_stop_a_write(tables, spark):
    """Replacing, appending and writing several tables at once: what breaks a rule changes nothing, and its rows are counted."""
    rules = {"big": F.col("id") > 8, "odd": F.col("id") % 2 == 1, "unknown": F.lit(None).cast("boolean")}
    good, bad = spark.range(0, 8, 2), spark.range(0, 11, 1, 3)
    tables.overwrite(good, "bronze", rules=rules)
    for write in (tables.overwrite, tables.append):
        with pytest.raises(BrokenRules) as refused:
            write(bad, "bronze", rules=rules)
        assert refused.value.counts == {"big": 2, "odd": 5, "unknown": 0}
        assert tables.count("bronze") == 4 and len(tables.batches("bronze")) == 1
    assert tables.append(spark.range(8, 9), "bronze", rules=rules) == 1 and tables.count("bronze") == 5
    tables.append(spark.range(6, 7), "bronze", batch=1, rules=rules)  # a repeated batch replaces itself
    assert sorted(r[0] for r in tables.read("bronze").collect()) == [0, 2, 4, 6, 6]
    tables.append(good.limit(0), "bronze", rules=rules)
    assert tables.count("bronze") == 5
    columns = {"a": ["id"], "b": ["id"]}
    tagged = good.withColumn("t", F.explode(F.array(F.lit("a"), F.lit("b"))))
    tables.write_many(tagged, "t", columns, rules=rules)
    with pytest.raises(BrokenRules):
        tables.write_many(tagged.union(spark.sql("SELECT 3L, 'b'")), "t", columns, rules=rules)
    assert tables.count(tables.place("a")) == tables.count(tables.place("b")) == 4
    with pytest.raises(Exception, match="breaks a rule"):
        Guard(rules).stopping(bad).collect()
    assert Guard(rules).stopping(good).count() == 4


def test_writers_keep_apart(tables, spark):
    tables.append(spark.range(4), "bronze")
    tables.append(spark.range(4, 6), "bronze", batch=0, writer="stream-a")
    tables.append(spark.range(6, 7), "bronze", batch=0, writer="stream-b")
    tables.append(spark.range(4, 5), "bronze", batch=0, writer="stream-a")
    assert sorted(r[0] for r in tables.read("bronze").collect()) == [0, 1, 2, 3, 4, 6]
    with pytest.raises(ValueError):
        tables.append(spark.range(1).select(F.col("id").cast("string")), "bronze")


def test_empty_table_keeps_its_schema(tables, spark):
    tables.overwrite(spark.range(0).withColumn("a", F.lit("x")), "bronze")
    assert tables.exists("bronze") and tables.count("bronze") == 0 and set(tables.read("bronze").columns) == {"id", "a"}


def test_listing_and_views(tables, spark):
    tables.overwrite(spark.range(4), "bronze")
    rows = by(tables.listing(), "name")
    assert (rows["bronze"]["exists"], rows["bronze"]["rows"], rows["bronze"]["version"]) == (True, 4, 0)
    assert (rows["gold_vendor"]["exists"], rows["gold_vendor"]["rows"], rows["gold_vendor"]["version"]) == (False, 0, -1)
    assert tables.path("bronze").endswith("/bronze") and tables.path("/other") == "/other"
    assert tables.register(extra=spark.range(2)) == ["bronze", "extra"]
    assert spark.sql("SELECT count(*) FROM bronze JOIN extra USING (id)").first()[0] == 2
    assert tables.sql("SELECT max(id) AS m FROM {b}", b=tables.read("bronze")).first()["m"] == 3
    missing = by(missing_tables(tables.listing(), ["bronze", "gold_vendor"], any_of="gold"), "name")
    assert set(missing) == {"gold_vendor", "gold"}


def test_gold_discovery(tables, spark):
    tables.overwrite(spark.range(4), f"{tables.root}/gold/one")
    tables.overwrite(spark.range(0), f"{tables.root}/gold/none")
    assert set(tables.gold_tables()) == {"one"}
    assert Tables(spark, "/nowhere").gold_tables() == {}


def test_plain_files(tables, spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', [1, 2]), (2, None, None)], "id int, t string, l array<int>")
    path = str(tmp_path / "x.csv")
    export_csv(df, path)
    rows = by(read_source(spark, path), "id")
    assert rows[1]["l"] == "[1,2]" and rows[2]["t"] is None
    df.write.parquet(str(tmp_path / "plain"))
    assert tables.read(str(tmp_path / "plain")).count() == 2
    with pytest.raises(Exception):
        read_source(spark, str(tmp_path / "absent.parquet")).count()


def test_records_may_grow(tables, spark):
    path = f"{tables.root}/runs"
    append_record(spark, tables, path, {"notebook": "01", "rows_written": 1, "duration_sec": 2, "error": None})
    append_record(spark, tables, path, {"notebook": "02", "rows_written": None, "duration_sec": 2.5, "error": "x", "versao": "v2"})
    rows = by(tables.read(path), "notebook")
    assert rows["01"]["error"] is None and rows["01"]["versao"] is None and rows["01"]["duration_sec"] == 2.0
    assert (rows["02"]["rows_written"], rows["02"]["versao"]) == (None, "v2")


def test_nanosecond_file(spark, tmp_path):
    """A file that really holds nanoseconds, also before 1970."""
    moments = [1_700_000_000_123_456_789, -1_001, 0, None]
    path = str(tmp_path / "nanos.parquet")
    pq.write_table(pa.table({"id": [1, 2, 3, 4], "ts": pa.array(moments, pa.timestamp("ns"))}), path, version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        got = by(nanos_to_timestamp(read_source(spark, path), "ts").select("id", F.unix_micros("ts").alias("us")), "id")
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert [got[i]["us"] for i in (1, 2, 3, 4)] == [1_700_000_000_123_456, -2, 0, None]
