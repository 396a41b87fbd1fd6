"""Fixed time windows over a stream of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAR = "9999-01-01"
POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def tumbled(rows: DataFrame, ts: str, keys: Sequence[str], sums: Sequence[str], folder: str, count: str = "N_APPARATI", width: str = "3 hours",
            late: str = "0 seconds", close: bool = True) -> tuple[DataFrame, int]:
    """Sums and row count per fixed window and key of the stream ``rows``, and how many late rows were left out.

    A window is written once, in append mode, when the watermark (the latest time seen less ``late``) has passed
    its end; rows that come for a written window are late. What is there now is read, in as many batches as
    the source makes, and the query ends; started again on the same ``folder``, it goes on where it ended.
    ``close`` ends the stream: a row far in the future lets the watermark pass all windows. Rows with a null time
    or key are left out.
    """
    spark = rows.sparkSession
    stream = rows.where(F.col(ts).isNotNull())
    for c in keys:
        stream = stream.where(F.col(c).isNotNull())
    stream = stream.select(F.col(ts).cast("timestamp").alias("_time"), *keys, *sums, F.lit(False).alias("_end"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name not in ("_time", "_end")]
    end = spark.range(1).select(F.lit(FAR).cast("timestamp").alias("_time"), *nothing, F.lit(True).alias("_end"))
    end.limit(0).write.mode("append").parquet(f"{folder}/end")
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/end"))
    windows = (
        both.withWatermark("_time", late).groupBy(F.window("_time", width), *keys, "_end")
        .agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias(count))
        .select(F.col("window.start").cast("timestamp_ntz").alias(ts), *keys, *sums, count, "_end")
    )
    dropped = 0
    for last in (False, True)[:1 + close]:
        if last:
            end.write.mode("append").parquet(f"{folder}/end")
        # the two sources have a watermark each; the end has none before it comes, and is ahead of all then
        policy = spark.conf.get(POLICY)
        spark.conf.set(POLICY, "max")
        try:
            query = (
                windows.writeStream.outputMode("append").trigger(availableNow=True)
                .option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/windows").start()
            )
            query.awaitTermination()
        finally:
            spark.conf.set(POLICY, policy)
        dropped += sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    # filtered here only: the stream's own filter would be moved before the watermark
    return spark.read.schema(windows.schema).parquet(f"{folder}/windows").where("NOT _end").drop("_end"), dropped
