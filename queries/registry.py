from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the given parquet tables: ``t.orders``, ``t.pages`` …"""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over given tables (``{orders}``) and further frames."""
        import re

        names = set(re.findall(r"{(\w+)}", text)) - set(frames)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **frames)


def query(name: str, oracle: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(tune(spark), folder))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def plain(text: str) -> str:
    """A derivation text with its ``{table}`` marks removed, for the oracle side."""
    import re

    return re.sub(r"{(\w+)}", r"\1", text)
