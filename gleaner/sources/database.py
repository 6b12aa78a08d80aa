"""Idempotent writes to an external database: tasks fill a staging table, one transaction publishes it.

1. The rows are pinned and numbered, so that a task that runs again writes the same rows again.
2. Tasks append their partitions to a staging table of this attempt; the target is not touched.
   A task that was lost after its commit leaves repeated numbers, which publishing reads once.
3. One transaction on the driver merges the staging table into the target inside the database and enters the
   run in a ledger table.  A run that the ledger has is not published again, and of two
   publishers of one run the ledger's key stops the second.

No row of the data passes through the driver.  An attempt that failed leaves the target as it was and a
staging table, which ``drop_stage`` removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.ranking import top_per_key
from gleaner.session import pin
from gleaner.sources.sinks import check_table, prepare_for_table

STAGING, LEDGER = "_stage_", "_published"
ROW = "stage_row"


@dataclass(frozen=True)
class Target:
    """A table behind a JDBC address; ``schema`` may be empty for databases without one."""

    url: str
    table: str
    schema: str = "public"
    allowed: Sequence[str] = ()
    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def engine(self) -> str:
        return self.url.split(":")[1].lower()

    @property
    def name(self) -> str:
        qualified = check_table(self.table, self.allowed, self.schema)
        return qualified if self.schema else self.table

    def beside(self, suffix: str) -> str:
        return f"{self.name}{suffix}"

    def quoted(self, column: str) -> str:
        mark = "`" if self.engine in ("mysql", "mariadb") else '"'
        return f"{mark}{column.replace(mark, mark * 2)}{mark}"

    def read(self, spark: SparkSession, table: str | None = None) -> DataFrame:
        return spark.read.format("jdbc").options(url=self.url, dbtable=table or self.name, **self.options).load()


@contextmanager
def transaction(spark: SparkSession, target: Target) -> Iterator[Any]:
    """Runs statements on the driver, all or none; yields ``run(sql, *texts)``, which gives the rows it changed."""
    jvm = spark.sparkContext._jvm
    if target.options.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(target.options["driver"])
    settings = jvm.java.util.Properties()
    for key, value in target.options.items():
        settings.setProperty(key, str(value))
    connection = jvm.java.sql.DriverManager.getConnection(target.url, settings)
    try:
        connection.setAutoCommit(False)

        def run(sql: str, *texts: str) -> int:
            statement = connection.prepareStatement(sql)
            try:
                for place, text in enumerate(texts, 1):
                    statement.setString(place, text)
                if not statement.execute():
                    return statement.getUpdateCount()
                rows, result = 0, statement.getResultSet()
                while result.next():
                    rows += 1
                return rows
            finally:
                statement.close()

        yield run
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _like(target: Target, name: str, columns: Sequence[str], numbered: bool) -> str:
    """A new empty table with columns of the target, and a row number."""
    listed = ", ".join(target.quoted(c) for c in columns)
    number = f", CAST(0 AS {'SIGNED' if target.engine in ('mysql', 'mariadb') else 'BIGINT'}) AS {ROW}" if numbered else ""
    tail = " WITH NO DATA" if target.engine in ("postgresql", "derby", "db2") else ""
    return f"CREATE TABLE {name} AS SELECT {listed}{number} FROM {target.name} WHERE 1 = 0{tail}"


def _merge(target: Target, source: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    """One statement that puts a source's rows into the target."""
    q = target.quoted
    listed = ", ".join(q(c) for c in columns)
    rest = [c for c in columns if c not in keys]
    insert = f"INSERT INTO {target.name} ({listed}) SELECT {listed} FROM {source}"
    if not keys:
        return insert
    if target.engine in ("postgresql", "sqlite"):
        # A WHERE keeps the parser of the second engine from reading ON as a join.
        update = ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest)
        return f"{insert} WHERE 1 = 1 ON CONFLICT ({', '.join(q(k) for k in keys)}) DO {f'UPDATE SET {update}' if rest else 'NOTHING'}"
    if target.engine in ("mysql", "mariadb"):
        return f"{insert} ON DUPLICATE KEY UPDATE " + ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest or keys)
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    matched = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    values = ", ".join(f"s.{q(c)}" for c in columns)
    return f"MERGE INTO {target.name} t USING {source} s ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({values})"


def prepare_ledger(spark: SparkSession, target: Target) -> None:
    """The ledger of published runs; made once for each target."""
    try:
        target.read(spark, target.beside(LEDGER)).schema  # noqa: B018
    except Exception:  # no such table, in the words of any database
        with transaction(spark, target) as run:
            run(f"CREATE TABLE {target.beside(LEDGER)} (run_id VARCHAR(200) NOT NULL PRIMARY KEY, attempt VARCHAR(40) NOT NULL, changed_rows BIGINT NOT NULL)")


def published(spark: SparkSession, target: Target) -> DataFrame:
    """``run_id, attempt, changed_rows`` of every published run."""
    return target.read(spark, target.beside(LEDGER)).toDF("run_id", "attempt", "changed_rows")


def stage(df: DataFrame, target: Target, mapping: Mapping[str, str] | None = None, keys: Sequence[str] = (), order: Sequence[Column] = ()) -> tuple[str, list[str]]:
    """Fill a staging table of a new attempt; returns the attempt's name and the columns it has.

    Columns are renamed by ``mapping``, and those that the target lacks are left out.  Of rows
    with equal keys the last by ``order`` stays (without one, by content); null keys are equal here.
    """
    spark = df.sparkSession
    known = {c.lower(): c for c in target.read(spark).columns}
    chosen = {**dict(mapping or {})}
    given = {c: known[chosen.get(c, c).lower()] for c in df.columns if chosen.get(c, c).lower() in known}
    rows = prepare_for_table(df, list(given.values()), given)
    if not rows.columns:
        raise ValueError("no column of the rows is in the table")
    stand = [known[k.lower()] for k in keys]
    if keys:
        last = [o.desc() for o in order] or [F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
        if order:
            rows = prepare_for_table(top_per_key(df, [F.col(f"`{c}`") for c, t in given.items() if t in stand], last), list(given.values()), given)
        else:
            rows = top_per_key(rows, [F.col(f"`{k}`") for k in stand], last)
    attempt = uuid.uuid4().hex[:16]
    with transaction(spark, target) as run:
        run(_like(target, target.beside(STAGING + attempt), rows.columns, True))
    numbered = pin(rows.withColumn(ROW, F.monotonically_increasing_id()))
    fill(numbered, target, attempt)
    return attempt, rows.columns


def fill(numbered: DataFrame, target: Target, attempt: str) -> None:
    options = {**target.options, "url": target.url, "dbtable": target.beside(STAGING + attempt)}
    numbered.write.format("jdbc").options(**options).mode("append").save()


def publish(spark: SparkSession, target: Target, attempt: str, columns: Sequence[str], run_id: str, keys: Sequence[str] = ()) -> int:
    """Merge a filled staging table into the target, once a run; returns the changed rows, 0 for a repeated run."""
    stand = {c.lower(): c for c in columns}
    keys = [stand[k.lower()] for k in keys]
    listed = ", ".join(target.quoted(c) for c in columns)
    staged, once = target.beside(STAGING + attempt), target.beside(f"{STAGING}{attempt}_once")
    number = target.quoted(ROW.upper() if target.engine in ("derby", "oracle", "db2", "h2") else ROW)
    with transaction(spark, target) as run:
        if run(f"SELECT run_id FROM {target.beside(LEDGER)} WHERE run_id = ?", run_id):
            return 0
        # Repeated numbers are the same rows written by a task that ran twice.
        run(_like(target, once, columns, True))
        run(f"INSERT INTO {once} SELECT DISTINCT {listed}, {number} FROM {staged}")
        changed = run(_merge(target, once, columns, keys))
        run(f"INSERT INTO {target.beside(LEDGER)} VALUES (?, ?, {changed})", run_id, attempt)
    return changed


def drop_stage(spark: SparkSession, target: Target, attempt: str) -> None:
    for suffix in ("", "_once"):
        try:
            with transaction(spark, target) as run:
                run(f"DROP TABLE {target.beside(f'{STAGING}{attempt}{suffix}')}")
        except Exception:  # noqa: S110, S112 - absent already
            continue


def write(
    df: DataFrame, target: Target, run_id: str, mapping: Mapping[str, str] | None = None, keys: Sequence[str] = (), order: Sequence[Column] = ()
) -> int:
    """Insert the rows, or with ``keys`` insert and update by key, once a run; returns the changed rows.

    A run may be repeated after any failure: until it is published the target is unchanged, afterwards
    nothing happens.  Null keys match nothing in the target.
    """
    spark = df.sparkSession
    prepare_ledger(spark, target)
    if published(spark, target).where(F.col("run_id") == run_id).limit(1).count():
        return 0
    attempt, columns = stage(df, target, mapping, keys, order)
    changed = publish(spark, target, attempt, columns, run_id, keys)
    drop_stage(spark, target, attempt)
    return changed
