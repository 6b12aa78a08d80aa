"""Queries of the training-data operators over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import balltree, bpe, decontaminate, hmm, identifiers, jaccard, langid, merkle, outliers, quality, substring, toxicity, training_order
from gleaner.llm.scan import prepare, remainder, table
from gleaner.llm.sql import LEXICAL, MERKLE, NEAR_COPIES, REPEATS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": NEAR_COPIES,
    "op7_substring_dedup": REPEATS,
    "op11_lexical_search": LEXICAL,
    "op12_merkle_manifest": MERKLE,
}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepare(spark), folder)

    QUERIES[function.__name__] = run
    return run


@query
def op9_byte_bpe(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


@query
def op7_substring_dedup(spark, folder):
    found = substring.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_decontamination(spark, folder):
    """Documents that hold a test item within its error budget, one row an item."""
    found = decontaminate.match(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")


@query
def op1_ngram_jaccard(spark, folder):
    return jaccard.join(table(spark, folder, "documents"))


@query
def op6_toxicity(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = toxicity.fit(docs.where(~F.col("held_out")), table(spark, folder, "labels"))
    found = toxicity.predict(docs, model, keep=("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op10_quality(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    model = quality.fit(docs.where(~F.col("held_out")), table(spark, folder, "labels"))
    found = quality.predict(docs, model, keep=("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op3_hidden_markov(spark, folder):
    docs = table(spark, folder, "documents")
    found = hmm.score(docs.withColumn("_learn", remainder("doc_id", 10) != 0), "_learn")
    return found.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), *found.columns[1:])


@query
def op2_quality_rules(spark, folder):
    return outliers.judge(table(spark, folder, "documents"))


@query
def op5_training_order(spark, folder):
    docs = table(spark, folder, "documents")
    tokens = training_order.token_table(
        docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, "doc_id", "text", training_order.Settings()
    )
    return training_order.shards(tokens)


@query
def op12_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.audit(docs, columns, "lang", "doc_id", {"text": merkle.lowered(F.col("text"))}, hit)


@query
def op13_identifiers(spark, folder):
    found = identifiers.find(table(spark, folder, "documents"))
    base = F.sha2(identifiers.joined(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base, identifiers.joined(F.col("spans")).alias("spans"))


@query
def op11_lexical_search(spark, folder):
    return balltree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
