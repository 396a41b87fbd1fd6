"""Operators on small hand-made or random tables, against brute force or another library path."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessella.functions.quantiles import exact_quantiles
from tessella.functions.sizing import literal_rows, small_table
from tessella.operators import clean, clusters, density, explain, forecast, isolation, joins, matches, profile, reshape, rollup, series, vectors, words
from tessella.plans import claims as claims_plan
from tessella.plans import topics, wine
from tessella.sources import literals


@pytest.mark.parametrize("accuracy,band", [(10_000, 1_000_000), (20, 5)])
def test_exact_quantiles(spark, accuracy, band):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.25), rng.exponential(50, 300)])
    groups = rng.integers(0, 3, len(values))
    df = spark.createDataFrame(pd.DataFrame({"g": groups, "v": values}))
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, "v", probs, accuracy=accuracy, band_rows=band).first()["quantiles"]
    assert np.allclose(got, np.quantile(values, probs))
    for row in exact_quantiles(df, "v", probs, by=["g"], accuracy=accuracy, band_rows=band).collect():
        assert np.allclose(row["quantiles"], np.quantile(values[groups == row["g"]], probs))


def test_quantiles_edge_cases(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert exact_quantiles(empty, "v", [0.5]).first()["quantiles"] == [None]
    assert exact_quantiles(empty, "v", [0.5], by=["g"]).count() == 0
    df = spark.createDataFrame([(1, 2.0), (None, 5.0), (1, None), (2, float("nan"))], "g int, v double")
    assert [tuple(r) for r in exact_quantiles(df, "v", [0.5], by=["g"]).collect()] == [(1, [2.0])]


def test_size_checks(spark):
    table, fits = small_table(spark.range(5), max_rows=10)
    assert fits and table.count() == 5
    table, fits = small_table(spark.range(50), max_rows=10)
    assert not fits and table.count() == 50
    with pytest.raises(ValueError):
        literal_rows(spark.range(50), 10)


def test_correlation_over_rows_with_both_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) * [1, 10, 100, 1, 1] + [1e6, 0, 0, 0, 0]
    x[:, 3] = x[:, 1] * 2 + 1
    x[:, 4] = 7.0
    x[rng.random((300, 5)) < 0.1] = np.nan
    x[:, 4] = 7.0
    names = list("abcde")
    df = clean.nan_to_null(spark.createDataFrame(pd.DataFrame(x, columns=names)))
    expected = pd.DataFrame(x, columns=names).corr()
    for some in (names, names[:2], ["b", "d"]):
        for r in profile.correlation_pairs(df, some).collect():
            e = expected.loc[r["left"], r["right"]]
            assert (r["r"] is None and np.isnan(e)) or abs(r["r"] - e) < 1e-9
    assert [r["column"] for r in profile.high_correlation(df, names, 0.8).collect()] == ["d"]


def test_null_rules(spark):
    df = spark.createDataFrame([("Y", 1.0), (None, float("nan")), ("N", None)], "f string, v double")
    assert clean.drop_equal(df, "f", "Y").count() == 2
    assert clean.drop_any_null(df).count() == 1
    assert {r["v"] for r in clean.nan_to_null(df).collect()} == {1.0, None}
    filled = clean.fill_constant(df, 0).collect()
    assert {r["f"] for r in filled} == {"Y", "0", "N"}
    assert rollup.count_by(df, ["f"]).count() == 2
    counts = reshape.one_hot(df, ["f"]).collect()
    assert [r["f_N"] + r["f_Y"] for r in counts if r["v"] is not None and np.isnan(r["v"])] == [0]


def test_selecting_columns(spark):
    df = spark.createDataFrame([("1", "2", 3)], "`MAX DS 01` string, `INTERVALLO MAX DS 01` string, n int")
    assert clean.select_like(df, "MAX DS ", keep=["n"]).columns == ["n", "MAX DS 01", "INTERVALLO MAX DS 01"]
    assert clean.reorder(df, ["n"]).columns[0] == "n"
    assert clean.numeric_columns(df) == ["n"] and len(clean.text_columns(df)) == 2


def test_pairing_beyond_the_literal(spark):
    df = spark.range(3)
    assert joins.pair_with_all(df, spark.range(4).withColumnRenamed("id", "k")).count() == 12
    assert joins.pair_with_all(df, spark.range(40).withColumnRenamed("id", "k"), max_rows=10).distinct().count() == 120


def test_match_flags_and_kpi(spark):
    rows = [
        (1, "2020-01-05 20:45:00", "Juventus", "Inter", "SKY"), (2, "2020-01-05 20:45:00", "Juventus", "Roma", "DAZN"),
        (3, "2020-01-06 15:00:00", "Lecce", "Parma", "SKY"),
    ]
    calendar = spark.createDataFrame(rows, "n int, data string, casa string, trasferta string, diretta string")
    calendar = calendar.withColumn("data", F.col("data").cast("timestamp_ntz"))
    flags = {str(r["data"]): r for r in matches.match_flags(calendar, literals.TEAMS, ["n"]).collect()}
    night = flags["2020-01-05 20:45:00"]
    assert (night["GAME_J"], night["GAME_I"], night["GAME_R"], night["GAME_M"]) == (0.25, 0.25, 1.0, 0.0)
    fans = literals.fan_shares(spark)
    found = matches.regional_kpi(calendar, fans, literals.TEAMS, literals.TEAM_SHARES, ["n"])
    kpi = {(r["REGIONE"], str(r["DATA"])): r["KPI"] for r in found.collect()}
    lazio = 0.163 * 0.25 + 0.06 * 0.25 + 0.065 * 0.05 + 0.351 * 1.0 + 0.04 * 0.05
    assert abs(kpi[("Lazio", "2020-01-05 18:00:00")] - lazio) < 1e-12  # 20:45 + 1 h falls in 21:00, moved to 18:00
    assert kpi[("Lazio", "2020-01-06 12:00:00")] == 0.0
    hours = spark.createDataFrame([(h,) for h in (21, 18, 15)], "h int").select(matches.match_hour_weight(F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.lit(1), "h", F.lit(0), F.lit(0))))
    assert [r[0] for r in hours.collect()] == [2.0, 0.5, 0.6]


def test_series_gaps_and_duplicate_buckets(spark):
    at = lambda h: dt.datetime(2020, 1, 1, h)
    rows = [("RM", at(0), 0, 5.0, 1, 1), ("RM", at(0), 1, 1.0, 0, 1), ("RM", at(9), 1, 2.0, 0, 1), ("MI", at(3), 0, 4.0, 0, 1)]
    df = spark.createDataFrame(rows, "PROVINCIA string, DATA timestamp_ntz, TIPO_GIORNO_DS int, MAX_DS double, F int, N int").withColumn("KPI", F.lit(0.0))
    found = series.series_for_key(df, sums=("MAX_DS", "F", "N"), scale=False).where("PROVINCIA = 'RM'").orderBy("DATA").collect()
    assert [r["MAX_DS"] for r in found] == [6.0, 0.0, 0.0, 2.0]
    assert [r["PRED"] for r in found] == [0.0, 0.0, 2.0, 0.0]
    assert [r["TIPO_GIORNO_DS"] for r in found] == [1, 1, 1, 1]
    scaled = series.series_for_key(df, sums=("MAX_DS", "F", "N")).where("PROVINCIA = 'MI'").first()
    assert scaled["MAX_DS"] == 0.0  # a constant column becomes 0


def test_group_ngrams_equals_joined_text(spark):
    rng = np.random.default_rng(4)
    pool = ["a", "b", "c", "d", "", "E f"]
    rows = [(i, int(rng.integers(0, 3)), " ".join(rng.choice(pool, rng.integers(0, 9)))) for i in range(120)] + [(999, 0, None)]
    df = spark.createDataFrame(rows, "id int, g int, t string")
    docs = {}
    for i, g, t in sorted(rows):
        if t is not None:
            docs.setdefault(g, []).append(t)
    for n in (1, 2, 4):
        expected = {}
        for g, parts in docs.items():
            w = " ".join(parts).lower().split(" ")
            for i in range(len(w) - n + 1):
                key = (g, " ".join(w[i:i + n]))
                expected[key] = expected.get(key, 0) + 1
        got = {(r["g"], r["ngram"]): r["tf"] for r in words.group_ngrams(df, "g", ["id"], "t", n).collect()}
        assert got == expected


def test_block_borders(spark, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 4)
    df = spark.createDataFrame([(i, 0, f"w{i}") for i in range(40)], "id int, g int, t string")
    got = {r["ngram"] for r in words.group_ngrams(df, "g", ["id"], "t", 3).collect()}
    assert got == {f"w{i} w{i + 1} w{i + 2}" for i in range(38)}


def joined_text(df, group, order, text, name="Doc"):
    """All texts of a group as one, in a stated order; for small test data only."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t"))))
    return df.where(F.col(text).isNotNull()).groupBy(group).agg(F.concat_ws(" ", pieces["_t"]).alias(name))


def test_tfidf_equals_ml_stages(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, " ".join(rng.choice(list("abcdef"), 12))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g int, t string")
    docs = joined_text(df, "g", "id", "t")
    model = Pipeline(stages=[
        Tokenizer(inputCol="Doc", outputCol="w"), NGram(n=2, inputCol="w", outputCol="n"),
        CountVectorizer(inputCol="n", outputCol="c", vocabSize=10000, minDF=2, maxDF=4 * 0.9), IDF(inputCol="c", outputCol="x"),
    ]).fit(docs)
    names = model.stages[2].vocabulary
    expected = {
        (r["g"], names[i]): v for r in model.transform(docs).select("g", vector_to_array("x").alias("x")).collect() for i, v in enumerate(r["x"]) if v
    }
    scored = words.tfidf(words.group_ngrams(df, "g", ["id"], "t", 2), "g", 4)
    got = {(r["g"], r["ngram"]): r["tfidf"] for r in scored.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    lists = words.topic_lists(words.top_words(df, "g", ["id"], "t", n=2, top=3), "g")
    assert all(len(r["topN_words"]) <= 3 for r in lists.collect())


def test_text_clean(spark):
    df = spark.createDataFrame([("Il cane, corre! Vedi http://x.y 42 volte",)], "t string")
    assert words.clean_text(df, "t").first()["clean"] == "cane corre volte"
    parts = words.clean_sentences(df, "t", [], pattern=r"[^\w\s]", stop_words=()).collect()
    assert [r["sentence"] for r in parts] == ["il cane corre", "vedi httpxy 42 volte"]
    kept = df.select(words.clean_tokens("t", stem=lambda a: F.transform(a, lambda w: F.substring(w, 1, 3))).alias("w")).first()["w"]
    assert kept == ["can", "cor", "vol"]
    stemmed = df.select(words.clean_tokens("t", stem=words.suffix_stem(["e", "re", "orre"])).alias("w")).first()["w"]
    assert stemmed == ["can", "cor", "volt"]


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i] & core].min() if core[i] else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return core, np.array([label[near[i] & core].min() if (near[i] & core).any() else -1 for i in range(len(x))])


@pytest.mark.parametrize("d,eps,least,hot", [(2, 0.5, 4, 100_000), (2, 0.35, 3, 10), (3, 0.9, 5, 20), (1, 0.05, 3, 100_000)])
def test_dbscan(spark, d, eps, least, hot):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (110, d)), rng.normal(4, 0.5, (110, d)), rng.uniform(-4, 8, (60, d)), np.tile(rng.normal(1, 1, (1, d)), (40, 1))])
    core, cluster = brute_dbscan(x, eps, least)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"a{i} double" for i in range(d)))
    got = {r["id"]: (r["kind"], r["cluster"]) for r in density.dbscan(df, [f"a{i}" for i in range(d)], "id", eps, least, hot).collect()}
    assert len(got) == len(x)
    assert all((got[i][0] == "core") == core[i] and got[i][1] == cluster[i] for i in range(len(x)))


def test_isolation_forest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 3))
    x[:10] += 12
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(1000)))
    first = {r["id"]: (r["score"], r["anomaly"]) for r in isolation.isolation_forest(df, list("abc"), ["id"], 0.01, trees=50).collect()}
    again = {r["id"]: (r["score"], r["anomaly"]) for r in isolation.isolation_forest(df.repartition(5), list("abc"), ["id"], 0.01, trees=50).collect()}
    assert first == again
    assert {i for i, v in first.items() if v[1] == -1} == set(range(10))
    assert {v[1] for v in first.values()} == {-1, 1}


def test_splits(spark):
    df = spark.range(10_000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    counts = {(r["y"], r["split"]): r["count"] for r in explain.stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 6300, (0, "test"): 2700, (1, "train"): 700, (1, "test"): 300}
    shares = {r["split"]: r["count"] / 10_000 for r in explain.three_way_split(df, ["id"]).groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.64) < 0.02 and abs(shares["val"] - 0.16) < 0.02


def test_components(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(key=range(400)))
    fit = vectors.fit_components(df, list("abcd"), 4)
    assert abs(sum(fit.variance) - 1) < 1e-9 and all(a >= b - 1e-12 for a, b in zip(fit.variance, fit.variance[1:]))
    got = fit.transform_columns(df).orderBy("key").toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    vt *= np.where(vt[np.arange(4), np.abs(vt).argmax(1)] < 0, -1, 1)[:, None]
    assert np.allclose(got[["PC1", "PC2", "PC3", "PC4"]].to_numpy(), z @ vt.T, atol=1e-6)
    assert np.allclose(fit.variance, s**2 / (s**2).sum())
    assert fit.k_for_variance(0.7) == int(np.nonzero(np.cumsum(fit.variance) >= 0.7)[0][0]) + 1
    assert fit.loadings(spark).count() == 16
    assert len(fit.transform(df, 2).first()["pca_features"]) == 2


def test_encoder_hook_and_topics(spark):
    rows = [(i, f"{w} is here. {w} again and {w} stays") for i, w in enumerate(["red", "green", "blue"] * 10)]
    df = spark.createDataFrame(rows, "id int, t string")

    def make():
        return lambda texts: np.array([[t.count("red"), t.count("green"), t.count("blue"), len(t)] for t in texts], dtype=float)

    found = topics.sentence_vectors(df, "t", ["id"], encoder=make, pattern=r"[^\w\s]", stop_words=())
    assert found.count() == 60
    result = topics.extract_topics(found, ["id", "sentence_no"], components=3, k=3, n=2, max_iter=20)
    joined = topics.with_topics(result, ["id"])
    assert joined.count() == 60


def test_forest_explains_the_rule(spark):
    rng = np.random.default_rng(8)
    x = rng.random((600, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(600)))
    df = df.withColumn("y", F.when(F.col("b") > 0.7, -1).otherwise(1)).withColumn("cluster", F.when(F.col("c") > 0.5, 1).otherwise(0))
    table, tested = explain.random_forest_importance(df, list("abc"), "y", ["id"], trees=10)
    assert table.orderBy("rank").first()["feature"] == "b"
    report = {r["class"]: r for r in profile.classification_report(tested, "y", "predicted").collect()}
    assert report["accuracy"]["f1"] > 0.95 and report["-1"]["support"] + report["1"]["support"] == tested.count()
    per_cluster = explain.one_vs_rest_importance(df, list("abc"), "cluster", ["id"], trees=5)
    assert {r["feature"] for r in per_cluster.where("rank = 1").collect()} == {"c"}


def test_forecast_and_two_targets(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(p, start + dt.timedelta(hours=3 * i), float(np.sin(i / 4) + 1), i % 2, 0.0) for p in ("A", "B") for i in range(240)]
    df = spark.createDataFrame(rows, "PROVINCIA string, DATA timestamp_ntz, MAX_DS double, TIPO_GIORNO_DS int, KPI double")
    found = forecast.one_step_forecast(series.series_for_key(df, sums=("MAX_DS",)), iterations=10)
    error = forecast.regression_metrics(found, "expected", "predicted").first()
    assert error["rmse"] < 0.2 and error["rows"] == found.count()
    rng = np.random.default_rng(9)
    x = rng.random((500, 3))
    raw = pd.DataFrame(x, columns=["acid", "sugar", "salt"]).assign(id=range(500), type=np.where(x[:, 0] > 0.5, "white", "red"), quality=(x[:, 1] * 6).astype(int))
    predicted = wine.wine_predictions(spark.createDataFrame(raw), ["id"], iterations=10)
    for r in forecast.two_target_metrics(predicted, "type", "quality").collect():
        assert r["accuracy"] > 0.9 and r["rmse"] < 1.0


def test_ngrams_of_texts_with_any_order_key(spark):
    rows = [("g", "b", "c d"), ("g", None, "a b"), ("g", "x", "e f"), ("g", "k", None)]
    df = spark.createDataFrame(rows, "g string, id string, t string")
    got = {r["ngram"] for r in words.group_ngrams(df, "g", ["id"], "t", 2).collect()}
    assert got == {"a b", "b c", "c d", "d e", "e f"}


def test_sentences_keep_control_characters(spark):
    df = spark.createDataFrame([("One\u0001two. Three! four",)], "t string")
    assert df.select(words.sentences("t")).first()[0] == ["One\u0001two.", "Three!", "four"]


def test_split_without_label_and_classes_missing_in_train(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2, float(i)) for i in range(60)], "id int, c int, x double")
    marks = explain.stratified_split(df, "c", ["id"]).collect()
    assert all((r["split"] is None) == (r["c"] is None) for r in marks)
    lone = df.where("c is not null").withColumn("c", F.when(F.col("id") == 7, 9).otherwise(F.col("c")))
    table = explain.one_vs_rest_importance(lone, ["x"], "c", ["id"], trees=2).collect()
    assert {r["id_cluster"] for r in table} == {0, 1, 9}


def test_one_hot_of_values_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "id int, c string")
    out = reshape.one_hot(df, ["c"])
    assert len({x.lower() for x in out.columns}) == 3
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]


def test_joins_on_odd_input(spark):
    a = spark.createDataFrame([(None, 1), (2, None)], "k int, v int")
    b = spark.createDataFrame([(2, 5)], "k int, w int")
    assert sorted((str(r["k"]), r["v"], r["w"]) for r in joins.full_outer([a, b], ["k"], 0).collect()) == [("2", 0, 5), ("None", 1, 0)]
    assert joins.pair_with_all(b, a.limit(0)).columns == ["k", "w", "k", "v"] and joins.pair_with_all(b, a.limit(0)).count() == 0
    many = spark.range(25).withColumnRenamed("id", "n")
    assert sorted((r["k"], r["n"]) for r in joins.pair_with_all(b, many, max_rows=4).collect()) == [(2, i) for i in range(25)]
    days = spark.createDataFrame([("t", "2024-01-05"), ("t", "2024-02-05")], "team string, day string")
    spans = spark.createDataFrame([("t", "2024-01-09", "2024-01-01", 1), ("t", "2024-01-01", "9999-12-31", 2)], "team string, s string, e string, p int")
    assert [r["p"] for r in joins.interval_lookup(days, "day", spans, "s", "e", ["team"], ["p"]).collect()] == [2, 2]


def test_correlation_with_nan_equals_pandas(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.normal(size=(200, 7)), columns=list("abcdefg"))
    frame.loc[::100, "b"] = np.nan
    expected = frame.corr()
    for n in (2, 7):
        names = list("abcdefg")[:n]
        for r in profile.correlation_pairs(spark.createDataFrame(frame), names).collect():
            assert r["r"] == pytest.approx(expected.loc[r["left"], r["right"]])


def test_rows_with_missing_features_stay(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(60)] + [(100, None, 1.0), (101, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    outliers = {r["id"]: r for r in isolation.isolation_forest(df, ["x", "y"], ["id"], 0.1, trees=5, sample=16).collect()}
    assert len(outliers) == 62 and outliers[100]["anomaly"] is None and outliers[101]["score"] is None and outliers[3]["anomaly"] in (1, -1)
    marks = {r["id"]: r for r in density.dbscan(df, ["x", "y"], "id", 0.5, 3).collect()}
    assert len(marks) == 62 and marks[100]["kind"] is None


def test_checkpoints_without_a_named_folder(spark, monkeypatch):
    from tessella import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    folder = session.shared_dir(Session())
    assert folder == session.shared_dir(Session())


def test_marks_stay_beside_their_rows(spark):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"k": np.arange(400) // 2, **{c: rng.normal(size=400) for c in "xyz"}})  # each key twice
    found = claims_plan.claim_outliers(spark.createDataFrame(rows), ["k"], k=2, trees=20).rows
    assert found.columns == ["k", "x", "y", "z", "score", "anomaly"] and found.count() == 400  # before: 800, by a join on the keys
    assert "Join" not in found._jdf.queryExecution().toString()


def test_levels_of_a_tree_score_as_its_nodes(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(100, 3)).round(1)
    nodes = pd.DataFrame(isolation._grow(points, rng, 7), columns=["node", "feature", "cut", "left", "right", "depth"]).sort_values("node")
    levels, depth = isolation._levels(nodes)
    assert len(levels) <= 7 and len(depth) == 2 ** len(levels)

    def walk(x):
        at = 0
        while nodes["feature"][at] >= 0:
            at = nodes["left"][at] if x[nodes["feature"][at]] < nodes["cut"][at] else nodes["right"][at]
        return nodes["depth"][at]

    nodes = {c: dict(zip(nodes["node"], nodes[c])) for c in nodes}
    x = np.concatenate([points, [[np.inf] * 3, [-np.inf] * 3, [np.inf, -np.inf, 0]]])
    assert isolation._score(x, [(levels, depth)], 3.0) == pytest.approx([-(2.0 ** (-walk(r) / 3.0)) for r in x])


def test_kmeans_reads_points_on_all_cores(spark, monkeypatch):
    seen, fit = [], clusters.KMeans.fit
    monkeypatch.setattr(clusters.KMeans, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    points = vectors.as_vector(spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(90)], "id int, x array<double>"), "x", "v").coalesce(1)
    found, _ = clusters.kmeans(points, 3, "v")
    assert found.count() == 90 and seen == [spark.sparkContext.defaultParallelism]  # before: one partition


def test_rare_words_share_vectors(spark):
    texts = [(i, f"often again word{i} {' '.join(f'w{j}' for j in range(i % 30))}", [i]) for i in range(60)] + [(99, None, [1]), (100, "", None)]
    df = spark.createDataFrame(texts, "id int, text string, other array<int>")
    shared = vectors._shared_names(Tokenizer(inputCol="text", outputCol="_words").transform(df.where("text IS NOT NULL")), "_words", 1, 16)
    rows = {r["id"]: r for r in shared.collect()}
    names = {w for r in rows.values() for w in r["_words"]}
    assert len(names) <= 17 and {"often", "again", "w0"} <= names  # before: a vector in the driver for each of 91 words
    assert all(len(rows[i]["_words"]) == 3 + i % 30 for i in range(60) if i % 30)
    assert rows[7]["other"] == [7] and rows[100]["_words"] in ([""], ["\0" + w[1:] for w in rows[100]["_words"]])
    found = vectors.average_word_vectors(df, "text", size=4, min_count=1, most_names=16)
    assert found.count() == 61 and found.columns == ["id", "text", "other", "embedding"]
    assert all(a["_words"] == b.lower().split() for a, (_, b, _) in zip(
        vectors._shared_names(Tokenizer(inputCol="text", outputCol="_words").transform(df.where("id < 60")), "_words", 1, 1000).orderBy("id").collect(), texts))


def test_sentences_are_cleaned_once(spark):
    df = spark.createDataFrame([(i, f"many words here {i % 3}. more words here again.") for i in range(40)], "id int, text string")
    rows = topics.sentence_vectors(df, "text", ["id"], size=4, pattern=r"\d", stop_words=())
    assert rows.count() == 80 and "regexp_replace" not in rows._jdf.queryExecution().toString()  # before: cleaned again by each step
