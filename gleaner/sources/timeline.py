"""Pages of a view without reading the view: rows clustered by time, and what each file holds.

``build`` writes a view range-partitioned and sorted by (time, stable id), rows without a time apart, and
beside it one row a file: its first and last place and its number of rows.  A page then takes from that list the
file its key lies in and the next ones until they hold enough rows, and reads these only; the
total comes from the list, too, but for the files that a range cuts.  A page key carries the total on.

A timeline is a snapshot: pages of one walk agree with each other whatever is committed meanwhile.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import views
from gleaner.operators.views import Page, PageKey

FILES = "file string, undated boolean, rows bigint, first_time timestamp_ntz, first_id string, last_time timestamp_ntz, last_id string"


def build(view: DataFrame, path: str, files: int | None = None) -> Timeline:
    """Write a view (``time``, ``stable_id`` and any other columns) as a timeline; ready once its list is written."""
    spark, path = view.sparkSession, path.rstrip("/")
    order = ["undated", "time", "stable_id"]
    rows = _typed(view).withColumn("undated", F.col("time").isNull())
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    # A folder of its own for each attempt: what a dead one left is never listed.
    place = f"{path}/rows-{uuid.uuid4().hex[:12]}"
    ranged.sortWithinPartitions(*order).write.partitionBy("undated").parquet(place)
    written = spark.read.schema(rows.schema).parquet(place)
    at = F.struct("time", "stable_id")
    listed = written.groupBy(F.col("_metadata.file_path").alias("file"), "undated").agg(
        F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    columns = [F.col(f"{end}.{c}").alias(f"{end}_{n}") for end in ("first", "last") for c, n in (("time", "time"), ("stable_id", "id"))]
    listed.select("file", "undated", "rows", *columns).coalesce(1).write.parquet(f"{path}/files")
    return Timeline(spark, path, shape(view))


def _typed(view: DataFrame) -> DataFrame:
    return view.withColumns({"time": F.col("time").cast("timestamp_ntz"), "stable_id": F.col("stable_id").cast("string")})


def shape(view: DataFrame) -> T.StructType:
    """Columns of a timeline's rows."""
    return _typed(view).schema


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(FILES).parquet(f"{path.rstrip('/')}/files")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


class Timeline:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._list = spark.read.schema(FILES).parquet(f"{self.path}/files")

    def files(self, lower: str | None = None, upper: str | None = None) -> DataFrame:
        """Files with rows in a half-open range; rows without a time are in no range."""
        if lower and upper and upper <= lower:
            raise ValueError("the end of a range must be after its start")
        found = self._list
        if lower:
            found = found.where(F.col("last_time") >= F.lit(lower).cast("timestamp_ntz"))
        if upper:
            found = found.where(F.col("first_time") < F.lit(upper).cast("timestamp_ntz"))
        return found

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def total(self, lower: str | None = None, upper: str | None = None) -> int:
        """Rows of a range: the list's numbers, and a count of the files that a bound cuts."""
        whole = F.lit(True)
        if lower:
            whole = whole & (F.col("first_time") >= F.lit(lower).cast("timestamp_ntz"))
        if upper:
            whole = whole & (F.col("last_time") < F.lit(upper).cast("timestamp_ntz"))
        found = self.files(lower, upper)
        inside = found.where(whole).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        cut = [r["file"] for r in found.where(~whole).select("file").collect()]  # around two bounds
        return inside + (views.time_range(self._read(cut), lower, upper).count() if cut else 0)

    def page_files(self, limit: int, after: PageKey | None = None, direction: str = "desc", lower: str | None = None, upper: str | None = None) -> list[str]:
        """The files that hold the ``limit`` rows after a key."""
        down = direction == "desc"
        found = self.files(lower, upper)
        if after is not None:
            found = found.where(self._holds_later(after, down))
        ends = [F.col("last_time").desc(), F.col("last_id").desc()] if down else [F.col("first_time").asc(), F.col("first_id").asc()]
        # Every file but the first holds a row of the page or ends the search.
        nearest = found.orderBy("undated", *ends).limit(limit + 1).select("file", "rows").collect()
        chosen, held = [], 0
        for place, row in enumerate(nearest):
            chosen.append(row["file"])
            held += row["rows"] if place else 0  # the key or a bound may lie inside the first
            if held >= limit:
                break
        return chosen

    @staticmethod
    def _holds_later(after: PageKey, down: bool) -> Column:
        ident = F.lit(after.stable_id)
        if after.time is None:
            return F.col("undated") & ((F.col("first_id") < ident) if down else (F.col("last_id") > ident))
        at = F.lit(after.time).cast("timestamp_ntz")
        end_time, end_id = ("first_time", "first_id") if down else ("last_time", "last_id")
        beyond = F.col(end_time) < at if down else F.col(end_time) > at
        tied = (F.col(end_time) == at) & ((F.col(end_id) < ident) if down else (F.col(end_id) > ident))
        return F.col("undated") | beyond | tied

    def page_rows(self, limit: int, after: PageKey | None = None, direction: str = "desc", lower: str | None = None, upper: str | None = None) -> DataFrame:
        rows = self._read(self.page_files(limit, after, direction, lower, upper))
        return views.keyset_rows(views.time_range(rows, lower, upper), limit, after, direction)

    def page(self, limit: int = 100, after: PageKey | None = None, direction: str = "desc", lower: str | None = None, upper: str | None = None) -> Page:
        """One page with a look-ahead row; a key of another range, direction or timeline is refused."""
        if not 1 <= limit <= 1000:
            raise ValueError("page size must be between 1 and 1000")
        context = (("timeline", self.path), ("direction", direction), ("from", lower), ("to", upper))
        if after is not None and after.context != context:
            raise ValueError("the resume key belongs to other filters")
        total = after.total if after is not None and after.total is not None else self.total(lower, upper)
        rows = self.page_rows(limit + 1, after, direction, lower, upper).collect()
        shown, key = rows[:limit], None
        if len(rows) > limit:
            last = shown[-1]
            key = replace(PageKey(None if last["time"] is None else last["time"].isoformat(), last["stable_id"], context), total=total)
        return Page(shown, len(rows) > limit, total, key)
