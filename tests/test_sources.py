"""Readers and writers on hand-written files."""

import json

from pyspark.sql import functions as F

from tessella.operators.joins import interval_lookup, rank_weight
from tessella.operators.reshape import wide_days_to_long
from tessella.plans import traffic
from tessella.sources import files, literals, sinks


def test_tilde_folder(spark, tmp_path):
    (tmp_path / "w1.csv").write_text("A~B~MAX DS 01_01_2020\nx~NA~1\ny~_~2\nlong~a~b~c\nshort~q\n~e~3\nempty~a~b~\nnulls~_~_~_~_\n\"q~\"~a~b\n\"r~\"~a~b~\n")
    (tmp_path / "w2.csv").write_text("A~B~MAX DS 08_01_2020\nz~RM~0,5\n")
    rows = {r["A"]: r for r in files.read_tilde_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x", "y", "short", None, "z", "q~"}  # only the over-long lines go
    assert rows["x"]["B"] == "NA" and rows["y"]["B"] is None
    assert rows["short"]["MAX DS 01_01_2020"] is None
    assert rows["x"]["MAX DS 08_01_2020"] is None and rows["z"]["MAX DS 08_01_2020"] == "0,5"


def test_months(spark, tmp_path):
    for month in ("10", "11"):
        (tmp_path / month).mkdir()
        (tmp_path / month / "a.csv").write_text(f"A~B\n{month}~1\n")
    df = files.read_months(spark, {m: str(tmp_path / m) for m in ("10", "11")})
    assert {(r["A"], r["month"]) for r in df.collect()} == {("10", "10"), ("11", "11")}


def test_latin1_and_provinces(spark, tmp_path):
    text = "Denominazione regione;Sigla automobilistica\nValle d'Aosta/Vallée d'Aoste;AO\nCampania;NA\nCampania;NA\n"
    (tmp_path / "c.csv").write_bytes(text.encode("latin-1"))
    rows = {(r["REGIONE"], r["PROVINCIA"]) for r in literals.provinces(files.read_latin1_semicolon(spark, str(tmp_path / "c.csv"))).collect()}
    assert ("Valle d'Aosta/Vallée d'Aoste", "AO") in rows and ("Campania", "NA") in rows and ("Sardegna", "VS") in rows
    assert len(rows) == 7


def test_rankings_and_lookup(spark, tmp_path):
    (tmp_path / "2020-01-07_2020-01-13_18.csv").write_text("1,Inter \n2,Juventus\n")
    (tmp_path / "2020-01-13_2020-01-20_19.csv").write_text("1,Juventus\n2,Inter\n")
    table = files.read_rankings(spark, str(tmp_path))
    assert {r["team"] for r in table.collect()} == {"Inter", "Juventus"}
    days = spark.createDataFrame([(d, t) for d in ("2020-01-13", "2020-01-14", "2020-02-01") for t in ("Inter", "Nobody")], "day string, team string")
    found = interval_lookup(days, F.to_date("day"), table, "start_date", "end_date", ["team"], ["position"])
    got = {(r["day"], r["team"]): r["w"] for r in found.withColumn("w", rank_weight("position")).collect()}
    assert got[("2020-01-13", "Inter")] == 1.0  # both intervals hold the day, the earlier start wins
    assert got[("2020-01-14", "Inter")] == 0.95
    assert got[("2020-02-01", "Inter")] is None and got[("2020-01-13", "Nobody")] is None


def test_typed_and_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,ts\n1,NaN,2020-01-01 10:00:00\n2,1.5,2020-01-02 11:30:00\n")
    path = str(tmp_path / "t.csv")
    assert [r["b"] for r in files.read_typed_csv(spark, path, "a int, b double, ts string").orderBy("a").collect()] == [None, 1.5]
    inferred = files.read_inferred_csv(spark, path, timestamps=["ts"])
    assert dict(inferred.dtypes)["ts"] == "timestamp_ntz" and dict(inferred.dtypes)["a"] == "int"
    assert files.read_header_csv(spark, path).dtypes[0] == ("a", "string")
    assert files.read_sheet_extract(spark, path).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.23456), (2, None)], "id int, v double")
    sinks.write_csv_decimals(df, str(tmp_path / "d"))
    assert {r["v"] for r in files.read_header_csv(spark, str(tmp_path / "d")).collect()} == {"1.235", None}
    for month in ("10", "11", "10"):
        sinks.write_month(df, str(tmp_path / "m"), month)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    table = spark.createDataFrame([(0, 1, "a", 0.7, 0.9), (0, 2, "b", 0.3, 0.9)], "id_cluster int, rank int, feature string, importance double, accuracy double")
    sinks.write_json_report(sinks.importance_report(table), str(tmp_path / "j"))
    line = next(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json").read_text().strip()
    assert json.loads(line)["features_importance"][0] == {"feature": "a", "importance": 0.7}


def test_fan_shares(spark):
    rows = {r["REGIONE"]: r for r in literals.fan_shares(spark).collect()}
    assert len(rows) == 20 and rows["Lombardia"]["ROMA"] == 0.0 and abs(rows["Campania"]["NAPOLI"] - 0.467) < 1e-12


def test_wide_days_drops_incomplete(spark):
    names = [f"{p} 0{d}_01_2020" for d in (1, 2) for p in ("MAX DS", "INTERVALLO MAX DS", "TIPO GIORNO DS")]
    df = spark.createDataFrame([("x", "1,5", "10:00", "FER", "0", None, "FES")], "ID string, " + ", ".join(f"`{n}` string" for n in names))
    rows = wide_days_to_long(df, ["ID"], traffic.DOWN).collect()
    assert [(str(r["DATA"]), r["MAX_DS"]) for r in rows] == [("2020-01-01", "1,5")]


def test_device_weeks_filters(spark):
    columns = ["APPARATO", "CATEGORIA", "ID_MISURE_ATTESTAZIONE", "PROVINCIA", "CAPACITA", "SOGLIA GIALLA", "SOGLIA ROSSA", *traffic.LINES, "FLAG MISURA MANCANTE", "WEEK"]
    base = ("C", "1", "RM", "9", "5", "7")
    rows = [
        ("a", *base, "75", "20", "5", None, "1"), ("a", *base, "75", "20", "5", None, "2"),
        ("b", *base, "75", "20", "5", None, "1"),                                      # misses a week
        ("c", *base, "74", "20", "6", None, "1"), ("c", *base, "74", "20", "6", None, "2"),  # share too small
        ("d", *base, "0", "0", "0", None, "1"), ("d", *base, "0", "0", "0", None, "2"),      # no lines at all
        ("e", *base, "9", "0", "0", "Y", "1"), ("e", *base, "9", "0", "0", "Y", "2"),        # marked invalid
        ("f", *base, None, "0", "0", None, "1"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    assert {r["ID"] for r in traffic.device_weeks(df).collect()} == {"aC1"}
    two = df.where("APPARATO = 'b'").withColumn("month", F.lit("11")).unionByName(df.where("APPARATO <> 'b'").withColumn("month", F.lit("10")))
    assert {r["ID"] for r in traffic.device_weeks(two, period=["month"]).collect()} == {"aC1", "bC1"}
