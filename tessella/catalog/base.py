"""Registry of the queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import shared_dir

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def new_folder(self, name: str) -> str:
        """A fresh path in the shared folder, for queries that write and read back."""
        return f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
