"""The corpus pipeline: language ID, near-duplicates, repeated passages, test leaks, token ids.

Every stage takes ``(spark, docs, sf_dir)``, decides about each row of ``docs`` and, but for
the last, returns rows with the columns of ``docs``.  Columns are renamed while a stage runs,
so that further columns may have any name.  Rows without an id are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontaminate, jaccard, langid, substring
from gleaner.llm.scan import SMALL_BATCH_BYTES, batch_bytes, may_hold, prepare, stored, table


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly."""
    batch_bytes(prepare(spark), SMALL_BATCH_BYTES)
    rows, c = _renamed(docs)
    model = langid.fit(rows, c["text"], c["lang"], c["doc_id"])
    found = langid.predict(rows, model, c["text"], tuple(c.values()))
    return found.where("NOT rejected").select(*c.values()).toDF(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    prepare(spark)
    rows, c = _renamed(docs)
    # Ids may be absent or repeated: rows equal in id and text are one, by their other columns.
    key = F.struct(
        F.col(c["doc_id"]).isNull().alias("none"), F.col(c["doc_id"]).alias("id"), F.xxhash64(c["doc_id"], c["text"]).alias("hash")
    )
    rows = rows.withColumn("key", key)
    decided = stored(jaccard.join(rows, "key", c["text"]).select("key", "component_id"))
    gone = stored(decided.where("key <> component_id").select("key").distinct())
    twice = stored(decided.groupBy("key").count().where("count > 1").select("key"))
    hashed = F.col("key.hash")
    named = gone.unionByName(twice).select(hashed.alias("hash")).distinct()
    # Rows of no such key, most of them, pass without a join.
    may = may_hold(named)(hashed)
    risky = rows.where(may)
    single = rows.where(~may).unionByName(risky.join(named, hashed == F.col("hash"), "left_anti"))
    order = Window.partitionBy("key").orderBy(*[n for k, n in c.items() if k not in ("doc_id", "text")])
    again = risky.join(twice.join(gone, "key", "left_anti").select(hashed.alias("hash")), hashed == F.col("hash"), "left_semi")
    again = again.withColumn("n", F.row_number().over(order)).where("n = 1")
    return single.select(*c.values()).unionByName(again.select(*c.values())).toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; those of such passages only go."""
    prepare(spark)
    rows, c = _renamed(docs)
    found = substring.remove_repeats(rows, c["doc_id"], c["text"], tuple(c.values()))
    found = found.where("n_removed = 0 OR kept_text <> ''")
    changed = F.col("n_removed") > 0
    new = {c["text"]: F.when(changed, F.col("kept_text")).otherwise(F.col(c["text"]))}
    if "n_chars" in c:
        new[c["n_chars"]] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(c["n_chars"]))
    return found.withColumns(new).select(*c.values()).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    prepare(spark)
    rows, c = _renamed(docs)
    found = decontaminate.match(rows, table(spark, sf_dir, "benchmark"), c["text"], keep=tuple(c.values()))
    return found.where("size(leaks) = 0").select(*c.values()).toDF(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of each document."""
    batch_bytes(prepare(spark), SMALL_BATCH_BYTES)
    rows, c = _renamed(docs)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.digests(rows, path, public_tokenizers.PATTERN, c["text"], c["doc_id"], bpe.SMALL_MEMORY)
    return found.withColumnRenamed(c["doc_id"], "doc_id")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Compression, text hashes and BPE ids aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
