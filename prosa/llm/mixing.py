"""Mixing sources to target weights along a time-varying curriculum. Built-in functions only.

Targets: sources in code-point order, null last, have weights 5, 2, 1 in turn and share
``TOTAL`` times all words; a target stops at ``CEILING`` times its source's words and what is left
over is shared anew by weight. That has a closed form: sort the sources by ceiling over weight and
find the level at which the ceilings below it and the weights above it use up the total.

Curriculum: source i is drawn at time t in [0, 1] with density ``target * (1 + slope * (2 t - 1))``,
slopes in turn +0.5, 0, -0.5. Its integral is the demand up to t, ``target * (t + slope * (t^2 - t))``.
A source supplies its documents in the order of the MD5 of their ids, again from the start when it
runs out; the words supplied before a copy, inverted through the demand, give the copy's training
position, and the stream is sorted by position in ranges.

Words supplied before a document are a prefix sum in two levels: sums of 4,096 slices of a source by
hash, then sums within a slice, so a source with a third of all rows is spread over all tasks.
A window over all sources runs over one row per source.

Nulls and edges: a null text has size 0 and is never taken; a null source is a source of its own;
null ids sort as empty text. Repeated rows are documents of their own; ties are broken by id, size and a
hash of the text. Extra columns are ignored. Without words all targets are 0; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosa.llm.common import count_words

WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)
TOTAL, CEILING = 1.5, 2


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, slope: one row per source. ``sizes``: source, size."""
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1

    def in_turn(values):
        return F.get(F.array(*map(F.lit, values)), F.pmod(turn, F.lit(len(values))))

    one = one.select("source", "source_size", in_turn(WEIGHTS).cast("double").alias("w"), in_turn(SLOPES).alias("slope"))
    most = F.col("source_size") * F.lit(CEILING)
    ratio = most.cast("double") / F.col("w")
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumn("most", most).withColumn("ratio", ratio)
    total = F.sum("source_size").over(everyone).cast("double") * F.lit(TOTAL)
    full = F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")
    weight = F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    one = one.withColumn("level", (total - full) / weight)
    first = F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", F.coalesce("source", F.lit(""))))).over(everyone)
    one = one.withColumn("at", first)
    target = F.when(F.col("at").isNull() | (F.col("ratio") <= F.col("at")), F.col("most").cast("double")).otherwise(F.col("w") * F.col("at"))
    return one.select("source", "source_size", target.alias("target"), "slope")


def invert(share, slope):
    """The t at which a source with this slope has met this share of its demand."""
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + F.lit(4.0) * slope * share)
    return F.when(slope == 0.0, share).otherwise(F.lit(2.0) * share / (b + root))


def supply(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, and the columns in ``keep``.

    ``taken`` counts the words the mix takes of a document, repeats included: full rounds over the
    source, and in the last round the documents up to the target, the last of them in part.
    ``position``: time of its first copy, null if nothing is taken.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64(text).alias("_tie"), *keep)
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_slice", F.substring("_order", 1, 3))
    goals = targets(docs.select("source", count_words(F.col("text")).alias("size")))
    slices = docs.select("source", "doc_id", count_words(F.col("text")).alias("size")).groupBy(
        "source", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 3).alias("_slice")).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    offsets = slices.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        F.col("s.source").alias("_source"), F.col("_slice").alias("_part"), "_base", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "_slice").orderBy("_order", F.col("doc_id"), "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_part"))
    rows = rows.join(offsets, same)
    start = F.col("_base") + F.col("_in")
    goal = F.floor(F.col("target") + F.lit(0.5))
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = goal - rounds * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), part - start))
    taken = (rounds * F.col("size") + extra).cast("long")
    share = (start.cast("double") + F.col("size") / F.lit(2.0)) / F.greatest(goal, F.lit(1)).cast("double")
    position = F.when(taken > 0, invert(F.least(share, F.lit(1.0)), F.col("slope")))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), position.alias("position"),
                       start.alias("start"), goal.alias("goal"), "slope", *keep)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by training position; documents not taken come last."""
    rows = supply(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def stream(docs: DataFrame) -> DataFrame:
    """The documents as training reads them: one row per copy, range-sorted by position.

    The columns are those of ``docs``. A document has ``taken / size`` copies, halves rounded up; copies
    are whole, so the one document of a source that the mix takes in part counts or doesn't, and a source misses its target
    by at most half of its longest document. A source with a target above 0 keeps at least one copy, that of its first
    document; only then it can be above its target by more, up to that document.
    """
    columns = docs.columns
    keep = docs.withColumn("_row", F.struct(*columns))
    rows = supply(keep, ("_row",)).where("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    copies = F.greatest(copies, (F.col("start") == 0).cast("int"))
    numbers = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_copy", F.explode(numbers))
    before = F.col("start") + (F.col("_copy") - 1) * F.col("source_size") + F.col("size") / F.lit(2.0)
    share = F.least(before / F.greatest("goal", F.lit(1)), F.lit(1.0))
    rows = rows.withColumn("_position", invert(share, F.col("slope")))
    return rows.orderBy("_position", "doc_id", "_copy").select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
s1 AS (SELECT source, source_size, [5.0, 2.0, 1.0][1 + i % 3]::DOUBLE AS w, [0.5, 0.0, -0.5][1 + i % 3]::DOUBLE AS slope,
    2 * source_size AS most FROM s0),
s2 AS (SELECT *, most::DOUBLE / w AS ratio FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT level AS l FROM s3 WHERE ratio > level ORDER BY ratio, coalesce(source, '') LIMIT 1),
s AS (SELECT source, source_size, slope, CASE WHEN l IS NULL OR ratio <= l THEN most::DOUBLE ELSE w * l END AS target
  FROM s3 LEFT JOIN s4 ON true),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS rounds FROM s),
r AS (SELECT d.doc_id, d.size, g.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, (rounds * size + greatest(0, least(size, goal - rounds * source_size - start)))::BIGINT AS taken,
    least((start::DOUBLE + size / 2.0) / greatest(goal, 1)::DOUBLE, 1.0) AS share FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN
    CASE WHEN slope = 0 THEN share ELSE 2.0 * share / ((1.0 - slope) + sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * share)) END
  END AS position FROM t
"""
