"""Data-quality checks and profiles. Each check is one pass over the table."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosa.functions.columns import round_to

HEALTHY, WATCH = 70.0, 40.0


def _percent(part, whole, places: int = 2):
    return F.when(whole > 0, round_to(part / whole * 100, places)).otherwise(F.lit(0.0))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls and their percent per column."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(f"`{name}`").isNull()).alias(f"_n{i}") for i, name in enumerate(names)],
    )
    entries = F.array(*[
        F.struct(F.lit(name).alias("coluna"), F.col(f"_n{i}").alias("nulos"))
        for i, name in enumerate(names)])
    return (counted.select("_total", F.inline(entries))
            .select("coluna", "nulos", _percent(F.col("nulos"), F.col("_total")).alias("percentual"),
                    F.col("_total").alias("total_linhas")))


def duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct keys and surplus rows. Nulls count as equal; unknown columns are dropped."""
    valid = [name for name in (keys or df.columns) if name in df.columns]
    if not valid:
        raise ValueError("Nenhuma coluna válida encontrada")
    return (
        df.groupBy(*valid).agg(F.count(F.lit(1)).alias("_rows"))
        .agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_linhas"),
             F.count(F.lit(1)).alias("linhas_unicas"))
        .withColumn("duplicatas", F.col("total_linhas") - F.col("linhas_unicas"))
        .withColumn("percentual_duplicatas", _percent(F.col("duplicatas"), F.col("total_linhas")))
    )


def compare_schemas(a: DataFrame, b: DataFrame) -> dict[str, Any]:
    """Common and one-sided columns and type differences; reads no data."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    common = sorted(set(left) & set(right))
    differing = {c: {"tabela_a": left[c], "tabela_b": right[c]} for c in common if left[c] != right[c]}
    return {
        "colunas_em_comum": common,
        "apenas_tabela_a": sorted(set(left) - set(right)),
        "apenas_tabela_b": sorted(set(right) - set(left)),
        "diferencas_tipo": differing,
        "schemas_identicos": set(left) == set(right) and not differing,
    }


def schema_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """The comparison as a table: one row per column name."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    rows = [(name, left.get(name), right.get(name), left.get(name) == right.get(name))
            for name in sorted(set(left) | set(right))]
    return a.sparkSession.createDataFrame(rows, "coluna string, tipo_a string, tipo_b string, igual boolean")


def integrity(df: DataFrame, table: str = "") -> DataFrame:
    """Health score of a table: 100 minus up to 40 for nulls and up to 30 for columns more than
    half null."""
    names = df.columns
    nulls = [F.col(f"_n{i}") for i in range(len(names))]
    counted = df.agg(
        F.count(F.lit(1)).alias("total_linhas"),
        *[F.count_if(F.col(f"`{name}`").isNull()).alias(f"_n{i}") for i, name in enumerate(names)],
    )
    rows = F.col("total_linhas")
    critical = sum([F.when((rows > 0) & (n * 2 > rows), 1).otherwise(0) for n in nulls], F.lit(0))
    summed = counted.select(
        rows,
        F.lit(len(names)).cast("long").alias("total_colunas"),
        sum(nulls, F.lit(0)).cast("long").alias("total_nulos"),
        critical.cast("long").alias("colunas_criticas"),
    )
    share = _percent(F.col("total_nulos"), rows * len(names))
    score = (F.lit(100.0) - F.least(F.col("percentual_nulos") * 2, F.lit(40.0))
             - F.least(F.col("colunas_criticas") * 10.0, F.lit(30.0)))
    scored = (summed.withColumn("percentual_nulos", share)
              .withColumn("score_saude", round_to(F.greatest(F.lit(0.0), score), 1)))
    status = (F.when(F.col("score_saude") >= HEALTHY, "saudavel")
              .when(F.col("score_saude") >= WATCH, "atencao").otherwise("critico"))
    return scored.select(F.lit(table).alias("tabela"), "*", status.alias("status"))


def allowed_values(df: DataFrame, column: str, expected: Sequence[Any]) -> DataFrame:
    """Values of a column outside the expected list, and expected values that do not occur, with
    their row counts. No rows means the column is valid and complete."""
    if column not in df.columns:
        raise ValueError(f"Coluna '{column}' não encontrada")
    kind = df.schema[column].dataType
    value = F.col(column)
    found = (df.where(value.isNotNull()).groupBy(value.alias("valor"))
             .agg(F.count(F.lit(1)).alias("linhas")))
    listed = F.col("valor").isin(*expected)
    wanted = df.sparkSession.createDataFrame(
        [(v,) for v in expected], T.StructType([T.StructField("valor", kind)]))
    absent = wanted.join(found.where(listed).select("valor"), "valor", "left_anti")
    return (
        found.where(~listed).select("valor", F.lit("inesperado").alias("problema"), "linhas")
        .unionByName(absent.select("valor", F.lit("ausente").alias("problema"),
                                   F.lit(0).cast("long").alias("linhas")))
    )


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_FLAT = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, *_NUMBERS)


def _entries(counted: DataFrame, columns: Sequence[tuple[str, Mapping[str, Any]]]) -> DataFrame:
    """One aggregate row to one row per column."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("coluna"), *[c.alias(alias) for alias, c in parts.items()])
        for name, parts in columns])
    return counted.select(F.inline(rows))


def _as_text(field: T.StructField):
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # one zero, not two
    return value.cast("string") if isinstance(field.dataType, _FLAT) else F.to_json(value)


def column_values(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, nulls, distinct values (null counts as one) and an example per column.

    Exact: the cells are counted per column and value, with map-side combining, then per column.
    A value that fills a third of the table is one row per map task, and no task holds a set of
    values. ``exact=False`` keeps a HyperLogLog sketch per column instead: no shuffle of values.
    """
    fields = df.schema.fields
    if not exact:
        aggregates, columns = [F.count(F.lit(1)).alias("_total")], []
        for i, field in enumerate(fields):
            text, nulls = _as_text(field), F.col(f"_n{i}")
            aggregates += [F.count_if(F.col(f"`{field.name}`").isNull()).alias(f"_n{i}"),
                           F.approx_count_distinct(text).alias(f"_u{i}"),
                           F.min(F.substring(text, 1, 100)).alias(f"_e{i}")]
            columns.append((field.name, {
                "linhas": F.col("_total"), "nulos": nulls,
                "valores_unicos": F.col(f"_u{i}") + F.when(nulls > 0, 1).otherwise(0),
                "exemplo": F.coalesce(F.col(f"_e{i}"), F.lit(""))}))
        return _entries(df.agg(*aggregates), columns)

    # A digest and the head of a value stand for it: long texts don't move.
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), _as_text(field).alias("_t")) for i, field in enumerate(fields)])))
    cells = cells.select("_i", F.md5("_t").alias("_k"), F.substring("_t", 1, 100).alias("_v"))
    values = cells.groupBy("_i", "_k", "_v").agg(F.count(F.lit(1)).alias("_n")).drop("_k")
    # A row without cells per column keeps the columns of an empty table.
    none = df.sparkSession.createDataFrame([(i, None, 0) for i in range(len(fields))], "_i int, _v string, _n long")
    name = F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("_i") + 1)
    return values.unionByName(none).groupBy("_i").agg(
        F.sum("_n").alias("linhas"),
        F.sum(F.when(F.col("_v").isNull(), F.col("_n")).otherwise(0)).alias("nulos"),
        F.count_if(F.col("_n") > 0).alias("valores_unicos"),
        F.coalesce(F.min("_v"), F.lit("")).alias("exemplo"),
    ).select(name.alias("coluna"), "linhas", "nulos", "valores_unicos", "exemplo")


def _types(df: DataFrame):
    names = F.array(*[F.lit(f.name) for f in df.schema.fields])
    kinds = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    return F.element_at(kinds, F.array_position(names, F.col("coluna")).cast("int"))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, nulls, null percent, distinct values and an example per column."""
    return column_values(df, exact).select(
        "coluna", _types(df).alias("tipo"), "nulos",
        _percent(F.col("nulos"), F.col("linhas")).alias("nulos_pct"), "valores_unicos", "exemplo")


def column_statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, nulls and distinct values per column; minimum, maximum and mean of numeric ones."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMBERS)]
    counted = column_values(df, exact).select(
        "coluna", _types(df).alias("tipo"), "nulos", F.col("valores_unicos").alias("unicos"))
    none = F.lit(None).cast("double")
    if not numeric:
        return counted.withColumns({"min": none, "max": none, "media": none})
    aggregates, columns = [], []
    for i, name in enumerate(numeric):
        value = F.col(f"`{name}`")
        aggregates += [F.min(value).cast("double").alias(f"_l{i}"), F.max(value).cast("double").alias(f"_h{i}"),
                       F.avg(value).alias(f"_m{i}")]
        columns.append((name, {"min": F.col(f"_l{i}"), "max": F.col(f"_h{i}"), "media": F.col(f"_m{i}")}))
    return counted.join(_entries(df.agg(*aggregates), columns), "coluna", "left")


def _class_of(kind: T.DataType) -> str:
    if isinstance(kind, _NUMBERS):
        return "numerica"
    if isinstance(kind, T.StringType):
        return "categorica"
    if isinstance(kind, T.BooleanType):
        return "booleana"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "outra"


def column_classes(df: DataFrame, most: int = 15, exact: bool = True) -> DataFrame:
    """Class of each column, distinct values of text columns (null counts as one), and whether a
    text column is fit for grouping: 2 to ``most`` values."""
    classes = df.sparkSession.createDataFrame(
        [(f.name, _class_of(f.dataType)) for f in df.schema.fields], "coluna string, classe string")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return classes.withColumns({"valores_unicos": F.lit(None).cast("long"), "agrupavel": F.lit(False)})
    values = column_values(df.select(*[F.col(f"`{n}`") for n in texts]), exact).select("coluna", "valores_unicos")
    fit = F.coalesce(F.col("valores_unicos").between(2, most), F.lit(False))
    return classes.join(values, "coluna", "left").withColumn("agrupavel", fit)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows, as read."""
    return df.limit(rows)


def first_records_json(df: DataFrame, rows: int = 3) -> DataFrame:
    return df.limit(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def schema_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def sample_rows(df: DataFrame, rows: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``rows`` random rows (all of a smaller table), the same for the same seed: the rows
    with the smallest hash of key and seed. A top-k, not a sort."""
    salted = F.md5(F.concat_ws("|", *[F.col(name).cast("string") for name in key], F.lit(str(seed))))
    return df.orderBy(salted, *key).limit(rows)


def pending_keys(bronze: DataFrame, silver: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Logical messages that Bronze holds and Silver does not. Nulls count as equal.

    Two 64-bit digests of the keys are compared, so message bodies stay where they are; only those of pending
    messages move. Comparing row counts instead would report new data for ever once duplicates were removed.
    """
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    digests = {"_h1": F.xxhash64(*parts), "_h2": F.xxhash64(F.lit(1), *parts)}
    named = ["_h1", "_h2"]
    missing = (bronze.select(*keys).withColumns(digests).select(named).distinct()
               .join(silver.select(*keys).withColumns(digests).select(named).distinct(), named, "left_anti"))
    return bronze.select(*keys).withColumns(digests).join(missing, named, "left_semi").select(*keys).distinct()


def has_pending(bronze: DataFrame, silver: DataFrame | None, keys: Sequence[str]) -> bool:
    """Whether Silver has to be refreshed."""
    if silver is None:
        return not bronze.isEmpty()
    return not pending_keys(bronze, silver, keys).isEmpty()


def health_sweep(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Integrity of every table."""
    checked = [integrity(df, name) for name, df in tables.items()]
    result = checked[0]
    for other in checked[1:]:
        result = result.unionByName(other)
    return result


def health_alerts(sweep: DataFrame, source: str = "health_sweep") -> DataFrame:
    """One warning per critical table, in the layout of the alert log."""
    return sweep.where(F.col("status") == "critico").select(
        F.substring(F.sha2(F.concat_ws("|", "tabela", F.current_timestamp().cast("string")), 256), 1, 12)
        .alias("alert_id"),
        F.lit("warning").alias("severity"),
        F.lit("Problemas de saúde detectados").alias("title"),
        F.concat(F.col("tabela"), F.lit(": score "), F.col("score_saude").cast("string")).alias("message"),
        F.current_timestamp().alias("timestamp"),
        F.lit(False).alias("resolved"),
        F.lit(source).alias("source"),
    )


def missing_tables(listing: DataFrame, expected: Sequence[str], any_of: str | None = None) -> DataFrame:
    """Expected tables that are absent or empty, from a table listing.

    ``any_of`` is a name prefix of which at least one table must exist with rows, as in "at least one Gold table".
    """
    wanted = listing.sparkSession.createDataFrame([(n,) for n in expected], "name string")
    joined = wanted.join(listing, "name", "left")
    problem = (F.when(~F.coalesce("exists", F.lit(False)), "nao encontrada")
               .when(F.col("rows") == 0, "vazia"))
    found = joined.select("name", problem.alias("problema")).where(F.col("problema").isNotNull())
    if any_of is None:
        return found
    filled = F.count_if(F.col("name").startswith(any_of) & F.col("exists") & (F.col("rows") > 0))
    none = listing.agg(filled.alias("n")).where("n = 0").select(F.lit(any_of).alias("name"), F.lit("nenhuma").alias("problema"))
    return found.unionByName(none)
