"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 1 << 28  # of the files read for one part of a table that is stored in parts


def build_session(app: str = "tessella", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{name: str(value) for name, value in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is missing and Spark runs in local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


@lru_cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tessella-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Survives the loss of executors, unlike a local checkpoint.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs in here go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bytes_read(df: DataFrame) -> int:
    """Size of the files ``df`` is computed from."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(x.stats().sizeInBytes()) for x in leaves if x.getClass().getSimpleName() == "LogicalRelation")


def stored(df: DataFrame, by: str | None = None, part_bytes: int | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder: computed once, read by columns, a fraction of the disk of ``cut``.

    With ``by`` the rows are computed in parts, by a hash of that column, a part for each ``part_bytes`` of the files
    read. The shuffle files of a part go before the next one begins, so a join or an aggregation over the column takes
    the disk of one part whatever the size of the table; the files are read once for each part.
    """
    if not df.columns or any(re.search(r"\b(void|interval)\b", f.dataType.simpleString()) for f in df.schema):
        return cut(df)  # types that Parquet has no form for
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may hold anything or differ by case only
    parts = 1 if by is None else max(1, -(-bytes_read(df) // (part_bytes or PART_BYTES)))
    place = None if by is None else F.pmod(F.xxhash64(f"c{df.columns.index(by)}"), F.lit(parts))
    for i in range(parts):
        with shuffles_dropped(spark):
            rows = numbered if parts == 1 else numbered.where(place == i)
            rows.write.mode("append").option("compression", "zstd").parquet(path)
    back = spark.read.schema(numbered.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(df.schema)])
