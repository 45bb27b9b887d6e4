"""The registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import functions as F

from prosa.llm import bpe, classifier, divergence, jaccard, line_dedup, mixing, pii, quality_rules, secrets, substring_dedup, url_filter, vectors, whitening
from prosa.llm.common import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function
    return register


@query("op3_line_dedup")
def op3(spark, d):
    return line_dedup.line_dedup(table(spark, d, "documents"))


@query("op4_mixing", mixing.SQL)
def op4(spark, d):
    return mixing.mix(table(spark, d, "documents"))


@query("op5_jaccard")
def op5(spark, d):
    return jaccard.jaccard_join(table(spark, d, "documents"))


@query("op6_quality_rules", quality_rules.sql())
def op6(spark, d):
    return quality_rules.quality_rules(table(spark, d, "documents")).drop("char_distance", "word_distance")


@query("op7_url_filter", url_filter.SQL)
def op7(spark, d):
    pages = table(spark, d, "pages")
    return url_filter.url_filter(pages, url_filter.repeated_urls(pages))


@query("op1_pii")
def op1(spark, d):
    return pii.find_pii(table(spark, d, "documents"))


@query("op2_secrets")
def op2(spark, d):
    return secrets.scan_secrets(table(spark, d, "documents"))


@query("op8_quality_classifier")
def op8(spark, d):
    return classifier.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary is; it stays outside this repository."""
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


@query("op9_bpe")
def op9(spark, d):
    return token_digests(bpe.encode_decode(table(spark, d, "documents"), tokenizer_file()))


def token_digests(coded):
    """doc_id, n_tokens and the digests of the ids and of the text they decode to."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_vectors")
def op10(spark, d):
    return vectors.audited(table(spark, d, "embeddings"))


@query("op13_substring_dedup")
def op13(spark, d):
    out = substring_dedup.substring_dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_source_divergence", divergence.SQL)
def op12(spark, d):
    return divergence.divergence(table(spark, d, "documents"))


@query("op11_whitening")
def op11(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))
