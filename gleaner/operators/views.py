"""Dataset views, time ranges, keyset pages, summary and coverage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.ranking import top_per_key

# Run states whose result counts as committed.
SUCCESSFUL = ("SUCCESS", "PARTIAL_SUCCESS", "WAITING_FOR_REVIEW", "SUCCESS_EMPTY_ALLOWED")
FULL_PASS = ("SUCCESS", "WAITING_FOR_REVIEW", "SUCCESS_EMPTY_ALLOWED")
TIME_BASES = ("source_published_at", "source_modified_at", "fetched_at", "observed_at")


def current_view(
    records: DataFrame,
    versions: DataFrame,
    observations: DataFrame,
    time_basis: str = "observed_at",
    include_pending: bool = False,
    visible_statuses: Sequence[str] = ("APPROVED",),
) -> DataFrame:
    """Active records with their current version and its latest observation.

    Adds ``time`` (the chosen basis; creation time only without an observation)
    and ``stable_id``.
    """
    shown = F.col("status") == "ACTIVE"
    if not include_pending:
        shown = shown & F.col("review_status").isin(*visible_statuses)
    active = records.where(shown)
    content = versions.select(
        "natural_key",
        F.col("version_number").alias("current_version"),
        F.col("run_id").alias("version_run_id"),
    )
    latest = top_per_key(
        observations,
        ["natural_key", "version_number"],
        [F.col("observed_at").desc(), F.col("observation_id").desc()],
    )
    seen = latest.select(
        "natural_key",
        F.col("version_number").alias("current_version"),
        "observation_id",
        "run_id",
        *TIME_BASES,
    )
    joined = active.join(content, ["natural_key", "current_version"]).join(
        seen, ["natural_key", "current_version"], "left"
    )
    return joined.withColumns(
        {
            "time": F.when(F.col("observation_id").isNull(), F.col("created_at")).otherwise(F.col(time_basis)),
            "stable_id": F.coalesce("observation_id", "natural_key"),
        }
    )


def history_view(
    records: DataFrame,
    versions: DataFrame,
    observations: DataFrame,
    time_basis: str = "observed_at",
    run_id: str | None = None,
    include_pending: bool = False,
) -> DataFrame:
    """Observations with record and version; a run filter reaches the scan."""
    chosen = observations if run_id is None else observations.where(F.col("run_id") == run_id)
    content = versions if include_pending else versions.where("review_status = 'APPROVED'")
    content = content.select(
        "natural_key", "version_number", "data_hash", F.col("review_status").alias("version_status")
    )
    known = records.select("natural_key", "status", "review_status", "confidence")
    joined = chosen.join(content, ["natural_key", "version_number"]).join(known, "natural_key")
    return joined.withColumns({"time": F.col(time_basis), "stable_id": F.col("observation_id")})


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest committed run, as one row (top-1 per task, no full sort)."""
    done = runs.where(F.col("status").isin(*SUCCESSFUL))
    order = [F.col("finished_at").desc(), F.col("created_at").desc(), F.col("run_id").desc()]
    return done.orderBy(*order).limit(1)


def latest_run_view(
    runs: DataFrame, records: DataFrame, versions: DataFrame, observations: DataFrame, time_basis: str = "observed_at"
) -> DataFrame:
    """Content of the newest committed run; an empty run gives an empty view."""
    # Exactly one row by the limit above, so this broadcast is bounded.
    run = F.broadcast(latest_run(runs).select("run_id"))
    return history_view(records, versions, observations.join(run, "run_id", "left_semi"), time_basis)


def time_range(df: DataFrame, lower: str | None, upper: str | None, time: str = "time") -> DataFrame:
    """Half-open ``lower <= t < upper`` on UTC text bounds; nulls fall out."""
    if lower and upper and upper <= lower:
        raise ValueError("the end of a range must be after its start")
    if lower:
        df = df.where(F.col(time) >= F.lit(lower).cast("timestamp_ntz"))
    if upper:
        df = df.where(F.col(time) < F.lit(upper).cast("timestamp_ntz"))
    return df


def at_second(df: DataFrame, moment: str, time: str = "time") -> DataFrame:
    """Rows inside the exact second that holds ``moment``."""
    floor = F.date_trunc("SECOND", F.lit(moment).cast("timestamp_ntz")).cast("timestamp_ntz")
    return df.where((F.col(time) >= floor) & (F.col(time) < floor + F.expr("interval 1 second")))


@dataclass(frozen=True)
class PageKey:
    """Resume point of a page: plain sort key plus the filters it belongs to, and the number of rows if known."""

    time: str | None
    stable_id: str
    context: tuple[tuple[str, Any], ...] = ()
    total: int | None = None


@dataclass(frozen=True)
class Page:
    rows: list
    has_more: bool
    total: int
    next_key: PageKey | None


def keyset_rows(df: DataFrame, limit: int, after: PageKey | None = None, direction: str = "desc", offset: int = 0) -> DataFrame:
    """``limit`` rows in (null last, time, id) order after a resume point."""
    time, ident = F.col("time"), F.col("stable_id")
    if after is not None:
        if after.time is None:
            later = time.isNull() & (ident < after.stable_id if direction == "desc" else ident > after.stable_id)
        else:
            at = F.lit(after.time).cast("timestamp_ntz")
            if direction == "desc":
                inside = (time < at) | ((time == at) & (ident < after.stable_id))
            else:
                inside = (time > at) | ((time == at) & (ident > after.stable_id))
            later = time.isNull() | inside
        df = df.where(later)
    order = (
        [time.desc_nulls_last(), ident.desc()] if direction == "desc" else [time.asc_nulls_last(), ident.asc()]
    )
    ordered = df.orderBy(*order)
    if after is None and offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def read_page(
    df: DataFrame,
    limit: int = 100,
    after: PageKey | None = None,
    direction: str = "desc",
    context: tuple[tuple[str, Any], ...] = (),
) -> Page:
    """One page with a look-ahead row; a resume key is refused when filters changed."""
    if not 1 <= limit <= 1000:
        raise ValueError("page size must be between 1 and 1000")
    if after is not None and after.context != context:
        raise ValueError("the resume key belongs to other filters")
    total = df.count()
    rows = keyset_rows(df, limit + 1, after, direction).collect()
    shown = rows[:limit]
    more = len(rows) > limit
    key = None
    if more:
        last = shown[-1]
        key = PageKey(None if last["time"] is None else last["time"].isoformat(), last["stable_id"], context)
    return Page(shown, more, total, key)


def record_item(view: DataFrame, include_evidence: bool = False) -> DataFrame:
    """API shape: ids, data, timestamps, provenance, confidence, review state."""
    item = [
        F.col("natural_key"),
        F.col("data"),
        F.struct(*[F.col(b) for b in TIME_BASES]).alias("timestamps"),
        F.struct("run_id", "observation_id", F.col("current_version").alias("version")).alias("provenance"),
        F.col("confidence"),
        F.col("review_status"),
    ]
    if include_evidence:
        item.append(F.col("evidence"))
    return view.select(*item)


def dataset_summary(records: DataFrame) -> DataFrame:
    active = F.col("status") == "ACTIVE"
    waiting = active & (F.col("review_status") == "PENDING")
    return records.agg(
        F.count_if(active & (F.col("review_status") == "APPROVED")).alias("approved"),
        F.count_if(waiting).alias("pending"),
        F.count_if(F.col("review_status") == "REJECTED").alias("rejected"),
        F.count_if(waiting & (F.col("current_version") == 1)).alias("pending_initial"),
    )


def coverage_sources(memberships: DataFrame, runs: DataFrame, dataset_runs: DataFrame, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """State of every expected source, judged by its latest run in the window.

    A membership that names neither workflow nor source is judged by the newest run of all.
    """
    window = time_range(runs, lower, upper, "finished_at")
    committed = window.join(dataset_runs.select("run_id", "observed_count"), "run_id")
    order = [F.col("finished_at").desc(), F.col("created_at").desc(), F.col("run_id").desc()]
    by_workflow = top_per_key(committed.where("workflow_id is not null"), ["workflow_id"], order)
    by_source = top_per_key(committed.where("source_id is not null"), ["source_id"], order)

    run_facts = F.struct("run_id", "status", "assessment_status", "assessment_codes", "observed_count", "finished_at")
    # One aggregated row, for memberships that are open.
    newest = committed.agg(
        F.max_by(run_facts, F.struct("finished_at", "created_at", "run_id")).alias("by_any"),
        F.max(F.when(F.col("run_id").isNotNull(), 1)).alias("__open"),
    )

    def found(best: DataFrame, key: str) -> DataFrame:
        return best.select(F.col(key), run_facts.alias(f"by_{key}"))

    joined = memberships.join(found(by_workflow, "workflow_id"), "workflow_id", "left").join(
        found(by_source, "source_id"), "source_id", "left"
    )
    is_open = F.when(F.col("workflow_id").isNull() & F.col("source_id").isNull(), 1)
    joined = joined.withColumn("__open", is_open).join(newest, "__open", "left")
    run = F.when(F.col("workflow_id").isNotNull(), F.col("by_workflow_id"))
    run = run.when(F.col("source_id").isNotNull(), F.col("by_source_id")).otherwise(F.col("by_any"))
    joined = joined.withColumn("run", run)
    missing = F.col("run.run_id").isNull()
    full = F.col("run.status").isin(*FULL_PASS) & ~F.coalesce(F.col("run.assessment_status") == "PARTIAL", F.lit(False))
    state = (
        F.when(missing, "MISSING").when(full, "PASS").when(F.col("run.status").isin(*SUCCESSFUL), "PARTIAL").otherwise("FAIL")
    )
    given = F.when(F.col("run.assessment_codes") != "", F.col("run.assessment_codes"))
    codes = (
        F.when(missing, "SOURCE_NOT_CHECKED")
        .when(full, F.coalesce(given, F.lit("")))
        .when(F.col("run.status").isin(*SUCCESSFUL), F.coalesce(given, F.lit("PARTIAL_RUN")))
        .otherwise(F.col("run.status"))
    )
    return joined.select(
        "source_key",
        "required",
        F.col("run.run_id").alias("run_id"),
        state.alias("status"),
        codes.alias("codes"),
        F.coalesce(F.col("run.observed_count"), F.lit(0)).cast("bigint").alias("record_count"),
        F.when(codes.contains("EMPTY_VALID_WINDOW"), "EMPTY_VALID_WINDOW").alias("empty_reason"),
        F.col("run.finished_at").alias("finished_at"),
    )


def coverage_status(sources: DataFrame) -> DataFrame:
    required = F.col("required")
    row = sources.agg(
        F.count_if(required).alias("expected_sources"),
        F.count_if(required & (F.col("status") != "MISSING")).alias("checked_sources"),
        F.count_if(required & (F.col("status") == "PASS")).alias("successful_sources"),
        F.count_if(required & (F.col("status") == "PARTIAL")).alias("partial_sources"),
        F.count_if(required & F.col("status").isin("FAIL", "MISSING")).alias("failed_sources"),
    )
    whole = F.col("successful_sources") == F.col("expected_sources")
    return row.withColumn(
        "status", F.when(whole, "PASS").when(F.col("successful_sources") > 0, "PARTIAL").otherwise("FAIL")
    )


def record_history(versions: DataFrame, key: Column) -> DataFrame:
    """Versions of the chosen records, newest first."""
    return versions.where(key).orderBy("natural_key", F.col("version_number").desc())


def approved_export(records: DataFrame) -> DataFrame:
    return records.where("status = 'ACTIVE' and review_status = 'APPROVED'")


def in_scope(df: DataFrame, project: str, owned: DataFrame, member: DataFrame) -> DataFrame:
    """Rows of projects a user owns or belongs to."""
    allowed = owned.select(F.col("project_id").alias(project)).unionByName(
        member.select(F.col("project_id").alias(project))
    )
    return df.join(allowed, project, "left_semi")
