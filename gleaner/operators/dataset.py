"""Natural keys, preflight and the versioned upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank

# The structural row identity used when declared keys are missing.
ROW_IDENTITY = ("page_url", "table_id", "row_index")


def natural_key(df: DataFrame, fields: Sequence[str]) -> Column:
    """Pipe-joined declared fields; incomplete ones are completed by the row
    identity; without either the key is null and the run is blocked."""

    def part(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("string")
        return F.when(~is_blank(F.col(name)), F.col(name).cast("string"))

    declared = [part(f) for f in fields]
    structural = [part(f) for f in ROW_IDENTITY]
    complete = F.lit(True)
    for value in declared:
        complete = complete & value.isNotNull()
    anchored = F.coalesce(*structural).isNotNull()
    return F.when(complete, F.concat_ws("|", *declared)).when(anchored, F.concat_ws("|", *declared, *structural))


def missing_keys(df: DataFrame, fields: Sequence[str], seq: str = "_seq") -> DataFrame:
    """Rows without any key, with the declared fields they lack."""
    lacking = F.array_compact(
        F.array(*[F.when(is_blank(F.col(f)) if f in df.columns else F.lit(True), F.lit(f)) for f in fields])
    )
    return df.where(natural_key(df, fields).isNull()).select(seq, lacking.alias("missing"))


def duplicate_keys(keyed: DataFrame, key: str = "natural_key", seq: str = "_seq") -> DataFrame:
    """One row per offending input row.  Counts are pre-aggregated, and no group is
    collected: the row list of a key stays a set of rows."""
    repeated = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("rows_with_key")).where("rows_with_key > 1")
    return keyed.select(key, seq).join(repeated, key)


def preflight(
    records: DataFrame,
    *,
    business_records: bool,
    commit_allowed: bool,
    minimum: int = 0,
    on_empty: str = "warning",
) -> list[str]:
    """Blocking codes of an output step; raises when an empty result is forbidden."""
    count = records.count()
    codes = []
    if not commit_allowed:
        codes.append("ASSESSMENT_BLOCKED")
    if not business_records:
        codes.append("MAPPING_REQUIRED")
    if count < minimum:
        codes.append("MINIMUM_EXPECTED_RECORDS")
    if count == 0 and on_empty == "fail":
        raise ValueError("an empty result is forbidden by on_empty = fail")
    return codes


def confidence(df: DataFrame) -> Column:
    """Missing column means 1.0; a null or zero value means 0."""
    if "confidence" not in df.columns:
        return F.lit(1.0)
    return F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))


def requires_review(df: DataFrame, policy: Mapping[str, Any], flag: str) -> Column:
    """``flag`` is the policy switch that applies: ``new`` or ``changed``."""
    asked = F.coalesce(F.col("requires_review").cast("boolean"), F.lit(False)) if "requires_review" in df.columns else F.lit(False)
    return F.lit(bool(policy[flag])) | asked | (confidence(df) < F.lit(float(policy["confidence_below"])))


def compare(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """Adds ``action`` (created, updated, unchanged) and the stored state of each key.

    ``records`` carries ``last_version`` (highest number, pending ones included),
    so numbering needs no scan of the version history.
    """
    stored = records.select(
        "natural_key",
        F.col("data_hash").alias("old_hash"),
        F.col("data").alias("old_data"),
        "current_version",
        "last_version",
    )
    joined = incoming.join(stored, "natural_key", "left")
    action = (
        F.when(F.col("old_hash").isNull(), "created")
        .when(F.col("old_hash") == F.col("data_hash"), "unchanged")
        .otherwise("updated")
    )
    return joined.withColumn("action", action)


def number_versions(
    incoming: DataFrame,
    review: Column | None = None,
    key: str = "natural_key",
    order: str = "run_id",
    digest: str = "data_hash",
) -> DataFrame:
    """Replay many runs at once: change flag and version number of every observation.

    A change that waits for review gets a version but does not replace the current
    content, so the next run is compared with the last *accepted* content.  Each key
    has one row per run (duplicates block a run), which bounds the window.
    """
    runs = Window.partitionBy(key).orderBy(order)
    earlier = runs.rowsBetween(Window.unboundedPreceding, -1)
    until = runs.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(runs) == 1
    pending = F.coalesce(review, F.lit(False)) if review is not None else F.lit(False)
    marked = incoming.withColumns({"__first": first, "__pending": pending})
    sets_current = F.when(F.col("__first") | ~F.col("__pending"), F.col(digest))
    marked = marked.withColumn("__current", F.last(sets_current, ignorenulls=True).over(earlier))
    marked = marked.withColumn("content_changed", F.col("__first") | (F.col("__current") != F.col(digest)))
    marked = marked.withColumn(
        "__number", F.sum(F.col("content_changed").cast("bigint")).over(until)
    )
    accepted = F.when(F.col("content_changed") & (F.col("__first") | ~F.col("__pending")), F.col("__number"))
    marked = marked.withColumn("__accepted", F.last(accepted, ignorenulls=True).over(until))
    number = F.when(F.col("content_changed"), F.col("__number")).otherwise(F.col("__accepted"))
    return marked.withColumn("version_number", number).drop("__first", "__pending", "__current", "__number", "__accepted")


def sample_unchanged(compared: DataFrame, run_id: str, size: int) -> DataFrame:
    """Deterministic audit sample; the order varies by run so all keys get their turn."""
    rank = F.sha2(F.concat_ws("|", F.lit(run_id), F.col("natural_key")), 256)
    return compared.where("action = 'unchanged'").orderBy(rank, "natural_key").limit(size)


@dataclass(frozen=True)
class RunOutcome:
    """Rows one run adds to the store; ``records`` holds new or replaced keys only."""

    records: DataFrame
    versions: DataFrame
    observations: DataFrame
    review_tasks: DataFrame
    counters: DataFrame


def stage_run(
    incoming: DataFrame,
    records: DataFrame,
    run_id: str,
    policy: Mapping[str, Any],
    clock: Column,
) -> DataFrame:
    """Every row of a batch with its action, version number and review state.

    ``incoming`` needs ``natural_key``, ``data_hash``, ``data`` and the optional side
    columns ``confidence``, ``requires_review``, ``source_published_at``,
    ``source_modified_at``, ``fetched_at``, ``evidence``.
    """
    compared = compare(incoming, records)
    created, updated = F.col("action") == "created", F.col("action") == "updated"
    pending = (created & requires_review(compared, policy, "new")) | (
        updated & requires_review(compared, policy, "changed")
    )
    number = (
        F.when(created, F.lit(1).cast("bigint"))
        .when(updated, F.col("last_version") + 1)
        .otherwise(F.col("current_version"))
    )
    return compared.withColumns(
        {
            "run_id": F.lit(run_id),
            "observed_at": clock,
            "pending": pending,
            "version_number": number,
            "confidence": confidence(compared),
        }
    ).withColumn("review_status", F.when(F.col("pending"), "PENDING").otherwise("APPROVED"))


def apply_run(
    incoming: DataFrame,
    records: DataFrame,
    run_id: str,
    policy: Mapping[str, Any],
    clock: Column,
) -> RunOutcome:
    """Compare one batch with the stored records and derive all rows it adds."""
    return outcome_of(stage_run(incoming, records, run_id, policy, clock), run_id, policy)


def outcome_of(staged: DataFrame, run_id: str, policy: Mapping[str, Any]) -> RunOutcome:
    """Rows a staged run adds; write the staged rows first when several are used."""
    created, updated = F.col("action") == "created", F.col("action") == "updated"
    replaces = created | (updated & ~F.col("pending"))
    changed = created | updated
    next_records = staged.where(changed).select(
        "natural_key",
        F.when(replaces, F.col("version_number")).otherwise(F.col("current_version")).alias("current_version"),
        F.col("version_number").alias("last_version"),
        F.when(replaces, F.col("data")).otherwise(F.col("old_data")).alias("data"),
        F.when(replaces, F.col("data_hash")).otherwise(F.col("old_hash")).alias("data_hash"),
        F.when(replaces, F.col("confidence")).alias("confidence"),
        F.when(replaces, F.col("review_status")).alias("review_status"),
        F.when(created, F.col("observed_at")).alias("created_at"),
        F.col("observed_at").alias("updated_at"),
    )
    versions = staged.where(changed).select(
        "natural_key", "version_number", "run_id", "data", "data_hash", "confidence", "review_status", "observed_at"
    )

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in staged.columns else F.lit(None)).cast(kind).alias(name)

    observations = staged.select(
        F.concat_ws("|", "run_id", "natural_key").alias("observation_id"),
        "natural_key",
        "run_id",
        "version_number",
        changed.alias("content_changed"),
        optional("source_published_at", "timestamp_ntz"),
        optional("source_modified_at", "timestamp_ntz"),
        optional("fetched_at", "timestamp_ntz"),
        "observed_at",
        optional("evidence", "string"),
    )
    def task_id(reason: Column) -> Column:
        return F.concat_ws("|", F.lit(run_id), reason, "natural_key").alias("task_id")

    reason = F.when(created, "NEW_RECORD").otherwise("CHANGED_RECORD")
    tasks = staged.where("pending").select(
        task_id(reason),
        "natural_key",
        "run_id",
        reason.alias("reason"),
        F.col("old_data"),
        F.col("data").alias("new_data"),
        F.col("data_hash").alias("new_hash"),
        F.lit("PENDING").alias("status"),
    )
    size = int(policy.get("sample_unchanged") or 0)
    if size > 0:
        audit = sample_unchanged(staged, run_id, size).select(
            task_id(F.lit("SAMPLED_RECORD")),
            "natural_key",
            "run_id",
            F.lit("SAMPLED_RECORD").alias("reason"),
            F.col("data").alias("old_data"),
            F.col("data").alias("new_data"),
            F.col("data_hash").alias("new_hash"),
            F.lit("PENDING").alias("status"),
        )
        tasks = tasks.unionByName(audit)
    counters = staged.agg(
        F.count_if(created).alias("created"),
        F.count_if(updated).alias("updated"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
        F.count_if("pending").alias("review_tasks"),
    ).withColumn("sampled_for_review", F.least(F.lit(size), F.col("unchanged")).cast("bigint"))
    counters = counters.withColumn("review_tasks", F.col("review_tasks") + F.col("sampled_for_review"))
    return RunOutcome(next_records, versions, observations, tasks, counters)


def merge_records(records: DataFrame, delta: DataFrame) -> DataFrame:
    """New state: replaced keys from ``delta``, all others as stored."""
    kept = records.join(delta.select("natural_key"), "natural_key", "left_anti")
    old = records.select(
        "natural_key", *[F.col(c).alias(f"__{c}") for c in ("status", "confidence", "review_status", "created_at")]
    )
    filled = delta.join(old, "natural_key", "left").select(
        *[c for c in delta.columns if c not in ("confidence", "review_status", "created_at")],
        F.coalesce("confidence", "__confidence").alias("confidence"),
        F.coalesce("review_status", "__review_status").alias("review_status"),
        F.coalesce("__created_at", "created_at").alias("created_at"),
        F.coalesce("__status", F.lit("ACTIVE")).alias("status"),
    )
    return kept.unionByName(filled)


def field_diff(df: DataFrame, fields: Sequence[str], old: str = "old", new: str = "new") -> Column:
    """Changed fields only, as ``map<field, struct<old, new>>`` of text values."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(f) for f in fields]),
        F.array(
            *[
                F.struct(F.col(f"{old}.{f}").cast("string").alias("old"), F.col(f"{new}.{f}").cast("string").alias("new"))
                for f in fields
            ]
        ),
    )
    return F.map_filter(pairs, lambda _, v: ~v["old"].eqNullSafe(v["new"]))
