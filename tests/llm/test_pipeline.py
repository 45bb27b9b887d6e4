"""The stages one after another, each against what it must do to its own input."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosa.llm import classifier, jaccard, line_dedup
from prosa.llm.common import scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet")
    docs = docs.withColumn("score", F.lit("x")).withColumn("_key", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        folder = scratch(spark, name)
        out.write.parquet(folder)
        out = spark.read.parquet(folder)
        before, after = docs.count(), out.count()
        if name != "bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality_classifier":
            labels = spark.read.parquet(DATA + "/labels.parquet")
            good = classifier.classify(docs, labels).where("predicted = 1")
            assert 0 < after <= before and {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in out.select("doc_id").collect()}
        elif name == "line_dedup":
            gone = line_dedup.line_dedup(docs).where("n_deleted > 0 and n_words_left = 0").count()
            assert after == before - gone and out.where("n_chars <> length(text)").count() == 0
        elif name == "jaccard_join":
            rows = jaccard.jaccard_join(docs)
            assert after == rows.select("component_id").distinct().count()
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in rows.select("component_id").collect()}
        elif name == "mixing":
            assert out.select("doc_id").distinct().join(docs, "doc_id").count() <= before
        else:
            assert after == before
            assert out.join(docs.select("doc_id", "text").distinct(), "doc_id").where("not (decoded <=> coalesce(text, ''))").count() == 0
        docs = out


@pytest.mark.parametrize("rows", [0, 5])
def test_run_on_small_tables(spark, rows):
    folder = scratch(spark, "tables")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(rows).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() <= 2 * rows


def test_near_duplicates_by_the_five_word_rule(spark):
    rng, docs = random.Random(8), []
    for _ in range(12):
        base = [f"v{rng.randint(0, 10 ** 6)}" for _ in range(80)]
        for change in ((), (40,), (20, 60), (10, 30, 50)):
            docs.append((len(docs), " ".join("n" if k in change else w for k, w in enumerate(base))))
        docs.append((len(docs), " ".join(base[:66])))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, DATA).collect()}
    assert kept == set(group.values()) and kept != {r["doc_id"] for r in jaccard.representatives(frame).collect()}
