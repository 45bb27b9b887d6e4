"""Cost and rate of model calls."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosa import params as P
from prosa.operators.ordering import running_sum

SECOND = 1_000_000


def price_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]] = P.PRICES) -> DataFrame:
    return spark.createDataFrame(
        [(model, float(i), float(o)) for model, (i, o) in prices.items()],
        "model_used string, price_input double, price_output double")


def with_cost(actions: DataFrame, prices: DataFrame | None = None, alias: str = "cost") -> DataFrame:
    """Cost of each call; 0 for a model without a price. The price list joins like any table:
    Spark broadcasts it as long as it is small."""
    prices = price_table(actions.sparkSession) if prices is None else prices
    cost = (F.col("input_tokens") / 1000 * F.col("price_input")
            + F.col("output_tokens") / 1000 * F.col("price_output"))
    return (actions.join(prices, "model_used", "left")
            .withColumn(alias, F.coalesce(cost, F.lit(0.0)))
            .drop("price_input", "price_output")
            .select(*dict.fromkeys([*actions.columns, alias])))


def usage_totals(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("custo_total_usd"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def cumulative_cost(actions: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Running cost in time order, over all calls or per group."""
    return running_sum(actions, F.col("cost"), ("timestamp", "action_id"), "custo_acumulado", within)


def budget(actions: DataFrame, limit: float = P.BUDGET_LIMIT, within: Sequence[str] = ()) -> DataFrame:
    """What each call left of the budget, and whether it was used up."""
    spent = F.col("custo_acumulado")
    return cumulative_cost(actions, within).withColumns({
        "orcamento_restante": F.greatest(F.lit(0.0), F.lit(float(limit)) - spent),
        "orcamento_excedido": spent >= limit,
    })


def rolling_tokens(
    actions: DataFrame,
    within: Sequence[str] = (),
    limit: int = P.TOKENS_PER_MINUTE,
    window_sec: int = P.RATE_WINDOW_SEC,
) -> DataFrame:
    """Tokens used in the last ``window_sec`` seconds at every moment with a call; calls exactly
    that old still count.

    Calls of one moment are summed first. Time is then cut into cells as long as the window, and
    each moment is sent to its own cell and the next one, so a window needs only its cell: no task
    sees more than two cells of distinct moments.
    """
    span = window_sec * SECOND
    moments = actions.groupBy(*within, F.unix_micros("timestamp").alias("_at")).agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("_tokens"))
    own = F.floor(F.col("_at") / F.lit(span)).cast("long")
    placed = moments.withColumn("_own", own).withColumn(
        "_cell", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    window = Window.partitionBy(*within, "_cell").orderBy("_at").rangeBetween(-span, 0)
    used = placed.withColumn("tokens_60s", F.sum("_tokens").over(window))
    return used.where(F.col("_cell") == F.col("_own")).select(
        *within,
        F.timestamp_micros("_at").alias("timestamp"),
        F.col("_tokens").alias("tokens"),
        "tokens_60s",
        F.greatest(F.lit(0), F.lit(limit) - F.col("tokens_60s")).alias("tokens_restantes"),
        (F.col("tokens_60s") > limit).alias("acima_do_limite"),
    )
