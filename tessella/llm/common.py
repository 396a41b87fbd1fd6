"""What the operators of this subpackage share: tables between steps, and caches that outlive a task."""

from __future__ import annotations

import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read with column pruning, safe
    against lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python process, so that tasks run one after the other
    in one worker share it. Whoever fills it bounds it."""
    holder = sys.modules.setdefault("tessella_process_cache", types.ModuleType("tessella_process_cache"))
    return holder.__dict__.setdefault(name, {})


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def plain_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
