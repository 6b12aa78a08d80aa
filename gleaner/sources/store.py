"""Dataset store on plain parquet: one folder per attempt, visible by manifest.

A run writes its files first, under a name of its own, and one manifest row last, so readers
see all of a run or nothing, whatever a dead run left; a repeated run id is a no-op.  Of two
writers one publishes, the other fails.  Record state is kept in key buckets; a run rewrites
only the buckets of keys that it creates or changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleaner.context import merge_review_policy
from gleaner.operators import dataset, review, views
from gleaner.plans.ranking import top_per_key
from gleaner.sources import timeline

RECORDS = (
    "natural_key string, current_version bigint, last_version bigint, data string, data_hash string, "
    "confidence double, review_status string, created_at timestamp_ntz, updated_at timestamp_ntz, status string"
)
VERSIONS = (
    "natural_key string, version_number bigint, run_id string, data string, data_hash string, "
    "confidence double, review_status string, observed_at timestamp_ntz"
)
OBSERVATIONS = (
    "observation_id string, natural_key string, run_id string, version_number bigint, content_changed boolean, "
    "source_published_at timestamp_ntz, source_modified_at timestamp_ntz, fetched_at timestamp_ntz, "
    "observed_at timestamp_ntz, evidence string"
)
TASKS = (
    "task_id string, natural_key string, run_id string, reason string, old_data string, new_data string, new_hash string, status string"
)
BLOCKED = "run_id string, reason string, finished_at timestamp_ntz"
MANIFEST = (
    "number bigint, folder string, kind string, run_id string, observed_count bigint, created bigint, updated bigint, unchanged bigint, "
    "review_tasks bigint, sampled_for_review bigint, finished_at timestamp_ntz, buckets map<string,string>"
)


@dataclass(frozen=True)
class CommitResult:
    run_id: str
    blocked: bool
    repeated: bool
    reason: str | None
    counters: Mapping[str, int]


class DatasetStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, commit string").parquet(f"{self.path}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, commit string")

    def manifest(self) -> DataFrame:
        """One row per commit, ``kind`` is ``run`` or ``review``."""
        return self._read("manifest", MANIFEST).drop("commit")

    def dataset_runs(self) -> DataFrame:
        """Committed runs, also the empty ones."""
        return self.manifest().where("kind = 'run'").drop("buckets", "kind", "folder")

    def blocked_runs(self) -> DataFrame:
        return self._read("blocked", BLOCKED).drop("commit").distinct()

    def last_commit(self, kind: str | None = None) -> Row | None:
        rows = self.manifest() if kind is None else self.manifest().where(F.col("kind") == kind)
        return rows.orderBy(F.col("number").desc()).limit(1).first()

    def _committed(self, table: str, schema: str, keys: Sequence[str] = ()) -> DataFrame:
        """Rows of published commits; rows that reviews wrote replace the key's row of a run."""
        folders = [(r["folder"], r["kind"]) for r in self.manifest().select("folder", "kind").collect()]  # a row a commit
        rows = self._read(table, schema)
        by_runs = rows.where(F.col("commit").isin([f for f, kind in folders if kind == "run"]))
        reviewed = [f for f, kind in folders if kind == "review"]
        if not keys or not reviewed:
            return by_runs.drop("commit")
        # Only what reviews wrote is ranked; the history itself is read and passed on.
        newer = top_per_key(rows.where(F.col("commit").isin(reviewed)), keys, [F.col("commit").desc()])
        return by_runs.join(newer.select(*keys), list(keys), "left_anti").select(*rows.columns).unionByName(newer).drop("commit")

    def versions(self) -> DataFrame:
        return self._committed("versions", VERSIONS, ["natural_key", "version_number"])

    def observations(self) -> DataFrame:
        return self._committed("observations", OBSERVATIONS)

    def review_tasks(self) -> DataFrame:
        return self._committed("review_tasks", TASKS, ["task_id"])

    def records(self, only: Sequence[int] | None = None) -> DataFrame:
        """Current state, optionally of some buckets; reads the newest file set of each."""
        last = self.last_commit()
        places = {int(b): folder for b, folder in last["buckets"].items()} if last else {}
        wanted = [b for b in places if only is None or b in set(only)]
        if not wanted:
            return self.spark.createDataFrame([], RECORDS)
        # At most ``buckets`` paths.
        folders = [f"{self.path}/records/commit={places[b]}/bucket={b}" for b in sorted(wanted)]
        names = [part.strip().split(" ")[0] for part in RECORDS.split(",")]
        return self.spark.read.schema(RECORDS).parquet(*folders).select(*names)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _next(self) -> tuple[int, str, dict[int, str]]:
        """Number of the next commit, the folder of this attempt at it, and where each bucket is."""
        last = self.last_commit()
        places = {int(b): folder for b, folder in last["buckets"].items()} if last else {}
        number = (last["number"] if last else 0) + 1
        return number, f"{number:012d}-{uuid.uuid4().hex[:12]}", places

    def _write(self, table: str, folder: str, frame: DataFrame) -> None:
        frame.write.parquet(f"{self.path}/{table}/commit={folder}")

    def _stage(self, name: str, folder: str, frame: DataFrame) -> DataFrame:
        """Written once, so every later step reads the same rows."""
        self._write(f"staging/{name}", folder, frame)
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/staging/{name}/commit={folder}")

    def _touched(self, frame: DataFrame) -> list[int]:
        """Buckets of the keys at hand, at most ``buckets`` numbers."""
        return [r[0] for r in frame.select(self.bucket_of(F.col("natural_key")).alias("b")).distinct().collect()]

    def _write_records(self, folder: str, frame: DataFrame) -> None:
        placed = frame.withColumn("bucket", self.bucket_of(F.col("natural_key")))
        # Adaptive execution splits large buckets and joins small ones.
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/records/commit={folder}")

    def _publish(
        self, number: int, folder: str, kind: str, run_id: str, clock: str, counters: Mapping[str, int], places: Mapping[int, str]
    ) -> None:
        """The manifest row makes a commit visible; it is written last, and only if its number is free.

        A number that a dead writer took without a row is passed over; one that another
        writer published fails this commit, whose comparison is out of date.
        """
        names = ("created", "updated", "unchanged", "review_tasks", "sampled_for_review")
        observed = sum(counters.get(n, 0) for n in names[:3])
        row = self.spark.range(1).select(
            F.lit(number).cast("bigint").alias("number"),
            F.lit(folder).alias("folder"),
            F.lit(kind).alias("kind"),
            F.lit(run_id).alias("run_id"),
            F.lit(observed).cast("bigint").alias("observed_count"),
            *[F.lit(counters.get(n, 0)).cast("bigint").alias(n) for n in names],
            F.lit(clock).cast("timestamp_ntz").alias("finished_at"),
            F.from_json(F.lit(json.dumps(places)), "map<string,string>").alias("buckets"),
        )
        while True:
            last = self.last_commit()
            if last and last["folder"].split("-")[0] >= folder.split("-")[0]:
                raise RuntimeError(f"{run_id}: another writer published a commit meanwhile; run again")
            try:
                row.withColumn("number", F.lit(number).cast("bigint")).coalesce(1).write.parquet(f"{self.path}/manifest/commit={number:012d}")
                return
            except AnalysisException as problem:
                if problem.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                number += 1

    def _known(self, run_id: str) -> bool:
        return not self.manifest().where(F.col("run_id") == run_id).isEmpty()

    def _block(self, run_id: str, reason: str, clock: str) -> CommitResult:
        row = self.spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(reason).alias("reason"), F.lit(clock).cast("timestamp_ntz").alias("finished_at")
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/blocked/commit=all")
        return CommitResult(run_id, True, False, reason, {})

    def commit(
        self,
        batch: DataFrame,
        run_id: str,
        clock: str,
        policy: Mapping[str, Any] | None = None,
    ) -> CommitResult:
        """Compare a batch with the stored state and publish the outcome, all or nothing.

        ``batch`` needs ``natural_key``, ``data_hash`` and ``data``.
        """
        if self._known(run_id):
            return CommitResult(run_id, False, True, "RUN_ALREADY_COMMITTED", {})
        number, folder, places = self._next()
        incoming = self._stage("incoming", folder, batch)
        # Keys are counted with map-side aggregation, then checked per bucket: at
        # most ``buckets`` rows come back.
        counts = incoming.groupBy("natural_key").agg(F.count(F.lit(1)).alias("n"))
        checks = counts.groupBy(self.bucket_of(F.col("natural_key")).alias("b")).agg(
            F.max("n").alias("most"), F.count_if(F.col("natural_key").isNull()).alias("missing")
        ).collect()
        if any(c["missing"] for c in checks):
            return self._block(run_id, "NATURAL_KEY_MISSING", clock)
        if any(c["most"] > 1 for c in checks):
            return self._block(run_id, "DUPLICATE_NATURAL_KEY", clock)
        state = self.records([c["b"] for c in checks])
        rules = merge_review_policy(policy)
        staged = dataset.stage_run(incoming, state, run_id, rules, F.lit(clock).cast("timestamp_ntz"))
        # One join with the state; all outputs read its written result.
        outcome = dataset.outcome_of(self._stage("compared", folder, staged), run_id, rules)
        self._write("versions", folder, outcome.versions)
        self._write("observations", folder, outcome.observations)
        self._write("review_tasks", folder, outcome.review_tasks)
        touched = self._touched(outcome.records)
        if touched:
            self._write_records(folder, dataset.merge_records(self.records(touched), outcome.records))
        counters = outcome.counters.first().asDict()
        places.update({b: folder for b in touched})
        self._publish(number, folder, "run", run_id, clock, counters, places)
        return CommitResult(run_id, False, False, None, counters)

    def review(self, decisions: DataFrame, review_id: str, clock: str) -> DataFrame:
        """Apply ``decisions(task_id, decision, corrected_data, corrected_hash, decided_seq)``;
        returns the decisions that came too late.  Only keys with a decision are rewritten."""
        if self._known(review_id):
            return decisions.where(F.lit(False)).select("task_id", F.lit("").alias("status"), "decision")
        number, folder, places = self._next()
        tasks = self._stage("decided", folder, self.review_tasks().join(decisions.select("task_id"), "task_id", "left_semi"))
        touched = self._touched(tasks)
        keys = tasks.select("natural_key").distinct()
        versions = self.versions().join(keys, "natural_key", "left_semi")
        outcome = review.apply_decisions(self.records(touched), versions, tasks, decisions)
        self._write("versions", folder, outcome.versions)
        self._write("review_tasks", folder, outcome.tasks)
        if touched:
            self._write_records(folder, outcome.records)
        places.update({b: folder for b in touched})
        self._publish(number, folder, "review", review_id, clock, {}, places)
        return outcome.conflicts

    def current(self, **options: Any) -> DataFrame:
        return views.current_view(self.records(), self.versions(), self.observations(), **options)

    def history(self, **options: Any) -> DataFrame:
        return views.history_view(self.records(), self.versions(), self.observations(), **options)

    def latest_run(self, **options: Any) -> DataFrame:
        """Content of the newest committed run; empty when that run observed nothing."""
        last = self.last_commit("run")
        return self.history(run_id=last["run_id"] if last else "", **options)

    def timeline(self, view: str = "current", time_basis: str = "observed_at", files: int | None = None, **options: Any) -> timeline.Timeline:
        """Pages of a view (``current`` or ``history``) as of the last commit; built when first asked for."""
        last = self.last_commit()
        frame = getattr(self, view)(time_basis=time_basis, **options)
        named = "-".join(f"{k}={v}" for k, v in sorted(options.items()))
        place = f"{self.path}/timeline/{view}-{time_basis}{'-' + uuid.uuid5(uuid.NAMESPACE_OID, named).hex[:12] if named else ''}/{last['folder'] if last else 'none'}"
        if timeline.exists(self.spark, place):
            return timeline.Timeline(self.spark, place, timeline.shape(frame))
        return timeline.build(frame, place, files)
