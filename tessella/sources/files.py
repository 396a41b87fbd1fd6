"""Readers for the file layouts the analyses start from."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.clean import nan_to_null

RAW = "_raw_line"


def read_header_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header line, every column text."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """CSV with a header line and given types; NaN becomes null."""
    return nan_to_null(spark.read.options(header=True, **options).schema(schema).csv(path))


def read_inferred_csv(spark: SparkSession, path: str, timestamps: Sequence[str] = (), **options: str) -> DataFrame:
    """CSV with types taken from the data, at the price of one more pass; prefer ``read_typed_csv``."""
    df = spark.read.options(header=True, inferSchema=True, **options).csv(path)
    return nan_to_null(df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in timestamps}) if timestamps else df)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by header line. The listing reads no contents; tasks read the first line of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            lines = []
            for name in batch["path"]:
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_stream(inner) as stream:
                    text = b""
                    while b"\n" not in text:
                        chunk = stream.read(1 << 16)
                        if not chunk:
                            break
                        text += chunk
                lines.append(text.split(b"\n", 1)[0].decode("utf-8").rstrip("\r"))
            yield batch.assign(header=lines)

    groups: dict[str, list[str]] = {}
    for row in files.mapInPandas(first_lines, "path string, header string").collect():  # one short row per file
        groups.setdefault(row["header"], []).append(row["path"])
    return groups


def field_count(line: str, sep: str) -> Column:
    """Number of fields of a raw line; separators inside a quoted field do not count."""
    cut = re.escape(sep)
    bare = F.regexp_replace(line, rf'(^|{cut})"(?:[^"\\]|\\.|"")*"(?={cut}|$)', "$1")
    return F.regexp_count(bare, F.lit(cut)) + 1


def read_tilde_folder(spark: SparkSession, path: str, sep: str = "~", null: str = "_") -> DataFrame:
    """All ``*.csv`` files of a folder put together by column name, every column text.

    Files may have different columns (each week names its own days). ``null`` marks missing values,
    so that the text ``NA`` stays a value. Lines with too many fields are left out, whatever those hold, short
    lines are filled with nulls.
    """
    frames = []
    for header, files in sorted(_headers(spark, path).items()):
        names = header.split(sep)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAW]])
        lines = (
            spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", null)
            .option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).csv(sorted(files))
        )
        # the reader keeps the raw line where its number of fields is not that of the header
        frames.append(lines.where(F.col(RAW).isNull() | (field_count(RAW, sep) <= len(names))).drop(RAW))
    if not frames:
        raise FileNotFoundError(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_months(spark: SparkSession, paths: Mapping[str, str], **options: str) -> DataFrame:
    """Folders of several months as one frame with a ``month`` column."""
    frames = [read_tilde_folder(spark, p, **options).withColumn("month", F.lit(m)) for m, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_latin1_semicolon(spark: SparkSession, path: str, null: str = "_") -> DataFrame:
    """Semicolon-separated ISO-8859-1 file with a header line, every column text."""
    return (
        spark.read.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("nullValue", null).csv(path)
    )


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """``start_date, end_date, matchday, team, position`` from files named ``<start>_<end>_<n>.csv``."""
    lines = spark.read.schema("position int, team string").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(path)
    parts = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""), "_")
    return lines.select(
        F.to_date(parts[0]).alias("start_date"), F.to_date(parts[1]).alias("end_date"), parts[2].cast("int").alias("matchday"),
        F.trim("team").alias("team"), "position",
    )


def read_sheet_extract(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A worksheet exported to Parquet or CSV (Spark reads no workbook files)."""
    if path.rstrip("/").endswith((".parquet", "_parquet")):
        return spark.read.parquet(path)
    return read_typed_csv(spark, path, schema) if schema else read_header_csv(spark, path)
