"""Review decisions applied as a batch of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.ranking import top_per_key


@dataclass(frozen=True)
class ReviewOutcome:
    records: DataFrame
    versions: DataFrame
    tasks: DataFrame
    conflicts: DataFrame


def apply_decisions(records: DataFrame, versions: DataFrame, tasks: DataFrame, decisions: DataFrame) -> ReviewOutcome:
    """Apply ``decisions(task_id, decision, corrected_data, corrected_hash, decided_seq)``.

    Accepting (APPROVED, CORRECTED) makes the task's content current; rejecting
    hides a record only when its first version was still pending.  Sampled tasks
    change nothing unless corrected.  Only the first decision of a pending task, by
    ``decided_seq``, counts; further ones, those of decided tasks and of unknown tasks come
    back as conflicts.
    """
    first = top_per_key(decisions, ["task_id"], [F.col("decided_seq"), F.col("decision")])
    chosen = first.select("task_id", F.struct(*[c for c in decisions.columns if c != "task_id"]).alias("__chosen"))
    ordered = decisions.withColumn("__n", F.row_number().over(Window.partitionBy("task_id").orderBy("decided_seq", "decision")))
    later = ordered.where("__n > 1").join(tasks.select("task_id", "status"), "task_id", "left").select("task_id", "status", "decision")
    unknown = first.join(tasks.select("task_id"), "task_id", "left_anti").select("task_id", F.lit(None).cast("string").alias("status"), "decision")
    joined = tasks.join(chosen, "task_id", "left").select(*tasks.columns, "__chosen.*")
    open_task = F.col("status") == "PENDING"
    decided = joined.where(open_task & F.col("decision").isNotNull())
    conflicts = joined.where(~open_task & F.col("decision").isNotNull()).select("task_id", "status", "decision")
    conflicts = conflicts.unionByName(later).unionByName(unknown)
    new_tasks = joined.select(
        *[c for c in tasks.columns if c != "status"],
        F.when(open_task & F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("status")).alias("status"),
    )
    # The version a task is about: the highest number written by its run.
    proposed = versions.groupBy("natural_key", "run_id").agg(F.max("version_number").alias("proposed"))
    sample = F.col("reason") == "SAMPLED_RECORD"
    accepting = F.col("decision").isin("APPROVED", "CORRECTED")
    effective = decided.where(~sample | (F.col("decision") == "CORRECTED"))
    staged = effective.join(proposed, ["natural_key", "run_id"], "left").withColumns(
        {
            # Null means a number after the newest version.
            "target": F.when(~sample, F.col("proposed")),
            "accepted_data": F.coalesce("corrected_data", "new_data"),
            "accepted_hash": F.coalesce("corrected_hash", "new_hash"),
        }
    )
    newest = versions.groupBy("natural_key").agg(F.max("version_number").alias("newest"))

    # The last acceptance of a record wins; one partial aggregate finds it together
    # with the positions that decide about hiding.
    content = F.struct("target", "accepted_data", "accepted_hash", "decision")
    per_record = staged.groupBy("natural_key").agg(
        F.max_by(content, F.when(accepting, F.col("decided_seq"))).alias("a"),
        F.min(F.when(accepting, F.col("decided_seq"))).alias("first_accept"),
        F.min(F.when((F.col("decision") == "REJECTED") & (F.col("proposed") == 1), F.col("decided_seq"))).alias("first_reject"),
    )
    per_record = per_record.join(newest, "natural_key", "left")
    accepts = staged.where(accepting)
    merged = records.join(per_record, "natural_key", "left").withColumns(
        {
            "a_version": F.when(F.col("a").isNotNull(), F.coalesce(F.col("a.target"), F.col("newest") + 1)),
            "a_data": F.col("a.accepted_data"),
            "a_hash": F.col("a.accepted_hash"),
            "a_status": F.col("a.decision"),
        }
    )
    hidden = (
        F.col("first_reject").isNotNull()
        & (F.col("review_status") == "PENDING")
        & (F.col("first_accept").isNull() | (F.col("first_reject") < F.col("first_accept")))
    )
    accepted = F.col("a_version").isNotNull()
    replaced = {
        "current_version": F.when(accepted, F.col("a_version")).otherwise(F.col("current_version")),
        "data": F.when(accepted, F.col("a_data")).otherwise(F.col("data")),
        "data_hash": F.when(accepted, F.col("a_hash")).otherwise(F.col("data_hash")),
        "review_status": F.when(accepted, F.col("a_status"))
        .when(hidden, "REJECTED")
        .otherwise(F.col("review_status")),
        "status": F.when(hidden, "REJECTED").otherwise(F.col("status")),
    }
    if "last_version" in records.columns:
        replaced["last_version"] = F.greatest("last_version", F.coalesce("a_version", "last_version"))
    new_records = merged.select(*[replaced.get(c, F.col(c)).alias(c) for c in records.columns])

    marks = top_per_key(staged.where(F.col("target").isNotNull()), ["natural_key", "target"], [F.col("decided_seq").desc()]).select(
        "natural_key",
        F.col("target").alias("version_number"),
        F.col("decision").alias("m_status"),
        F.when(accepting, F.col("accepted_data")).alias("m_data"),
        F.when(accepting, F.col("accepted_hash")).alias("m_hash"),
    )
    updated = versions.join(marks, ["natural_key", "version_number"], "left")
    change = {
        "data": F.coalesce("m_data", "data"),
        "data_hash": F.coalesce("m_hash", "data_hash"),
        "review_status": F.coalesce("m_status", "review_status"),
    }
    new_versions = updated.select(*[change.get(c, F.col(c)).alias(c) for c in versions.columns])
    extra = accepts.where(sample).join(newest, "natural_key")
    added = {
        "version_number": F.col("newest") + 1,
        "data": F.col("accepted_data"),
        "data_hash": F.col("accepted_hash"),
        "review_status": F.lit("CORRECTED"),
    }
    extra_rows = extra.select(
        *[
            (added.get(c, F.col(c) if c in extra.columns else F.lit(None).cast(versions.schema[c].dataType))).alias(c)
            for c in versions.columns
        ]
    )
    return ReviewOutcome(new_records, new_versions.unionByName(extra_rows), new_tasks, conflicts)


def accept_baseline(records: DataFrame, versions: DataFrame, tasks: DataFrame) -> ReviewOutcome:
    """Approve first observations that still wait; later changes keep their tasks."""
    waiting = (F.col("status") == "ACTIVE") & (F.col("review_status") == "PENDING") & (F.col("current_version") == 1)
    keys = records.where(waiting).select("natural_key", F.lit(True).alias("__hit"))
    new_records = records.withColumn("review_status", F.when(waiting, "APPROVED").otherwise(F.col("review_status")))
    hit = F.col("__hit").isNotNull()
    new_versions = (
        versions.join(keys, "natural_key", "left")
        .withColumn(
            "review_status",
            F.when(hit & (F.col("version_number") == 1), "APPROVED").otherwise(F.col("review_status")),
        )
        .drop("__hit")
    )
    new_tasks = (
        tasks.join(keys, "natural_key", "left")
        .withColumn(
            "status",
            F.when(hit & (F.col("reason") == "NEW_RECORD") & (F.col("status") == "PENDING"), "APPROVED").otherwise(
                F.col("status")
            ),
        )
        .drop("__hit")
    )
    return ReviewOutcome(new_records, new_versions, new_tasks, tasks.where(F.lit(False)).select("task_id", "status"))


def clear_dataset(table: DataFrame, dataset_id: str) -> DataFrame:
    """All rows of other datasets."""
    return table.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id)))
