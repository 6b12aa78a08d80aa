"""Page rows, artifacts and legacy encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.ranking import top_per_key

_CYRILLIC = "[^А-яЁёЎўІі]"


def fingerprint(pages: DataFrame, html: str = "html") -> DataFrame:
    """Fetched-document row: size in bytes and sha256 beside the page."""
    return pages.withColumns({"size": F.octet_length(html).cast("bigint"), "sha256": F.sha2(html, 256)})


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_")


def artifact_registry(documents: DataFrame, order: str, sha: str = "sha256") -> DataFrame:
    """One artifact per content digest: the first in ``order``."""
    return top_per_key(documents, [sha], [F.col(order)])


def link_artifacts(items: DataFrame, raw_documents: DataFrame, seq: str = "_seq") -> DataFrame:
    """Raw document of each item: the explicit id when it belongs to the same run,
    else the newest document of the run with the same digest."""
    known = raw_documents.select(
        F.col("id").alias("__explicit"), F.col("run_id").alias("__run")
    )
    newest = top_per_key(
        raw_documents, ["run_id", "sha256"], [F.col("created_at").desc(), F.col("id").desc()]
    ).select("run_id", F.col("sha256").alias("artifact_sha256"), F.col("id").alias("__by_digest"))
    joined = items.join(
        known, (items["raw_document_id"] == known["__explicit"]) & (items["run_id"] == known["__run"]), "left"
    ).drop("__run")
    joined = joined.join(newest, ["run_id", "artifact_sha256"], "left")
    return joined.withColumn("raw_document_id", F.coalesce("__explicit", "__by_digest")).drop("__explicit", "__by_digest")


def repair_encoding(content: Column) -> Column:
    """cp1251 text when it has more than twice the Cyrillic letters of the UTF-8 text.

    Needs ``spark.sql.legacy.javaCharsets=true`` for the windows-1251 decoder.
    """
    utf8 = F.decode(content, "UTF-8")
    legacy = F.decode(content, "windows-1251")

    def letters(text: Column) -> Column:
        return F.char_length(F.regexp_replace(text, _CYRILLIC, ""))

    return F.when(letters(legacy) > letters(utf8) * 2, legacy).otherwise(utf8)
