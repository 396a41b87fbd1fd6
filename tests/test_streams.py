"""Windows over a stream of files: batches, late rows, going on after an end."""

from datetime import datetime

from pyspark.sql import functions as F

from tessella.operators import series, streams

SCHEMA = "ts timestamp_ntz, k string, v double"


def put(spark, path, rows):
    spark.createDataFrame([(datetime(2024, 1, d, h), k, v) if d else (None, k, v) for d, h, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_windows_of_a_stream(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [(1, 0, "a", 1.0), (1, 2, "a", 2.0), (1, 4, "b", 3.0), (2, 1, "a", 4.0), (0, 0, "a", 9.0), (2, 1, None, 9.0)]
    put(spark, source, first)
    rows = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    closed, late = streams.tumbled(rows(), "ts", ["k"], ["v"], folder, count="n", close=False)
    assert late == 0 and {(r["ts"].hour, r["k"], r["v"], r["n"]) for r in closed.collect()} == {(0, "a", 3.0, 2), (3, "b", 3.0, 1)}
    # the next run goes on: a row for a written window is late, an open window grows
    put(spark, source, [(1, 1, "a", 100.0), (2, 2, "a", 5.0), (3, 1, "c", 6.0)])
    closed, late = streams.tumbled(rows(), "ts", ["k"], ["v"], folder, count="n")
    assert late == 1
    batch = series.tumble(spark.createDataFrame([(datetime(2024, 1, d, h), k, v) for d, h, k, v in [*first[:4], (2, 2, "a", 5.0), (3, 1, "c", 6.0)]], SCHEMA), "ts", ["k"], ["v"], count="n")
    assert sorted(map(tuple, closed.select("ts", "k", "v", "n").collect())) == sorted(map(tuple, batch.select("ts", "k", "v", "n").collect()))


def test_several_batches_are_one_result(spark, tmp_path):
    source = f"{tmp_path}/in"
    for day in range(1, 6):
        put(spark, source, [(day, h, "a", float(h)) for h in range(24)])
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    closed, late = streams.tumbled(rows, "ts", ["k"], ["v"], f"{tmp_path}/out", count="n", late="10 days")
    assert late == 0 and closed.count() == 40 and closed.agg(F.sum("n")).first()[0] == 120
