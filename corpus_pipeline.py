"""A training-corpus pipeline in five stages, each one operator on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``, whatever else their input has.

``classify`` drops the documents the quality classifier rejects. ``dedup_lines`` deletes later copies of
repeated runs of lines and drops documents of which nothing is left by that; ``n_chars`` follows the text. ``near_duplicates``
keeps one document of each group of near copies, that with the smallest id: sets of five-word shingles with a
similarity of 0.8 or more link (the query ``op5_jaccard`` has four words and 0.85). ``mix`` repeats and leaves out documents as the source weights ask, in training order. ``encode`` gives the tokens.

Nulls, empty texts, repeated rows and empty tables are handled as the operators say. Rows that repeat an id
are one document to ``near_duplicates``: the row with the smallest text hash stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosa.llm import bpe, classifier, jaccard, line_dedup, mixing
from prosa.llm.common import scratch, table
from prosa.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What the stage calls a near copy: ``WHOLE * common >= PART * union`` over shingles of ``WORDS`` words.
WORDS, PART, WHOLE = 5, 80, 100


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    out = line_dedup.line_dedup(docs, keep=tuple(rest))
    kept = out.where("not (n_deleted > 0 and n_words_left = 0)")
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars.cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs.select(*COLUMNS), WORDS, PART, WHOLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stream(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_file()).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("jaccard_join", near_duplicates),
          ("mixing", mix), ("bpe", encode)]

#: SQL expresses neither boosted trees nor byte-pair encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows go to the shared folder and are read from there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
