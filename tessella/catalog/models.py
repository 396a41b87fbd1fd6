"""Models over the given tables: components, clusters, outliers, importances, forecasts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalog import claims, traffic
from tessella.catalog.base import Tables, query, rounded
from tessella.operators import clean, clusters, density, explain, forecast, isolation, joint, series, vectors
from tessella.plans import claims as claims_plan
from tessella.plans import topics as topics_plan

EMBEDDING_SIZE = 64


def embedded(t: Tables) -> DataFrame:
    return vectors.as_vector(t.embeddings, "embedding", "embedding_vector")


@query()
def pca_variance(t: Tables) -> DataFrame:
    return vectors.fit_components(embedded(t), "embedding_vector", 30).explained(t.spark)


@query()
def pca_loadings(t: Tables) -> DataFrame:
    return vectors.fit_components(embedded(t), "embedding_vector", 30).loadings(t.spark)


@query()
def top3_components(t: Tables) -> DataFrame:
    rows = vectors.fit_components(embedded(t), "embedding_vector", 30).transform(embedded(t))
    return vectors.first_components(rows, "pca_features", ["vec_id", "label"])


@query()
def kmeans_clusters(t: Tables) -> DataFrame:
    points = vectors.fit_components(embedded(t), "embedding_vector", 30).transform(embedded(t))
    clustered, _ = clusters.kmeans(points, 12)
    return clustered.select("vec_id", "label", "prediction")


@query(f"""
    SELECT 'length of the loadings' AS check, unnest(range(1, 31))::INTEGER AS component, 1.0::DOUBLE AS value
    UNION ALL SELECT 'largest product with other loadings', unnest(range(1, 31))::INTEGER, 0.0::DOUBLE
    UNION ALL SELECT 'variance off the share', unnest(range(1, 31))::INTEGER, 0.0::DOUBLE""")
def pca_checks(t: Tables) -> DataFrame:
    """Loadings are of length 1 and orthogonal, and a projected column varies as its eigenvalue says."""
    rows = embedded(t)
    model = vectors.fit_components(rows, "embedding_vector", 30)
    load = model.loadings(t.spark)
    other = load.select("feature", F.col("component").alias("other"), F.col("loading").alias("theirs"))
    products = load.join(other, "feature").groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("theirs")).alias("value"))
    length = products.where("component = other").select(F.lit("length of the loadings").alias("check"), "component", "value")
    across = products.where("component <> other").groupBy("component").agg(F.max(F.abs("value")).alias("value"))
    numbers = F.posexplode(vector_to_array("pca_features")).alias("at", "x")
    varied = model.transform(rows).select(numbers).groupBy((F.col("at") + 1).alias("component")).agg(F.var_samp("x").alias("v"))
    share = model.explained(t.spark).join(varied, "component").select(
        F.lit("variance off the share").alias("check"), "component", F.abs(F.col("variance") - F.col("v") / EMBEDDING_SIZE).alias("value")
    )
    rest = across.select(F.lit("largest product with other loadings").alias("check"), "component", "value")
    return rounded(length.unionByName(rest).unionByName(share), ["value"], 6)


@query("SELECT count(*) AS rows, 12::INTEGER AS clusters, 0::BIGINT AS nearer_elsewhere FROM embeddings")
def kmeans_checks(t: Tables) -> DataFrame:
    """Every point is in the cluster whose centre is nearest, and no cluster is empty."""
    points = vectors.fit_components(embedded(t), "embedding_vector", 30).transform(embedded(t))
    clustered, model = clusters.kmeans(points, 12)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    apart = F.transform(centres, lambda c: F.aggregate(F.zip_with(c, F.col("x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    far = clustered.select("prediction", vector_to_array("pca_features").alias("x")).select("prediction", apart.alias("d"))
    nearer = F.count_if(F.element_at("d", F.col("prediction") + 1) > F.array_min("d") + 1e-9)
    return far.agg(F.count("*").alias("rows"), F.count_distinct("prediction").cast("int").alias("clusters"), nearer.alias("nearer_elsewhere"))


@query()
def silhouette_sweep(t: Tables) -> DataFrame:
    points = vectors.fit_components(embedded(t), "embedding_vector", 30).transform(embedded(t))
    return clusters.silhouette_sweep(points, range(2, 20, 2))


# balance in hundreds and nation of a customer as a point
POINTS = "SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey AS y FROM customer"


@query(f"""
    WITH p AS (SELECT id, x, CAST(y AS DOUBLE) AS y FROM ({POINTS})),
    near AS (SELECT a.id AS id, b.id AS other FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.44),
    core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5),
    touched AS (SELECT DISTINCT id FROM near WHERE other IN (SELECT id FROM core))
    SELECT id, CASE WHEN id IN (SELECT id FROM core) THEN 'core' WHEN id IN (SELECT id FROM touched) THEN 'border' ELSE 'noise' END AS kind FROM p""")
def dbscan_kinds(t: Tables) -> DataFrame:
    """Core, border and noise points of the customers by balance and nation."""
    return dbscan(t).select("id", "kind")


@query(f"""
    WITH RECURSIVE p AS (SELECT id, x, CAST(y AS DOUBLE) AS y FROM ({POINTS})),
    near AS (SELECT a.id AS id, b.id AS other FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.44),
    core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5),
    link AS (SELECT * FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.other, reach.root FROM reach JOIN link ON link.id = reach.id),
    named AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
    touched AS (SELECT near.id, min(cluster) AS cluster FROM near JOIN named ON named.id = near.other GROUP BY near.id)
    SELECT p.id, CASE WHEN named.id IS NOT NULL THEN 'core' WHEN touched.id IS NOT NULL THEN 'border' ELSE 'noise' END AS kind,
        coalesce(named.cluster, touched.cluster, -1) AS cluster
    FROM p LEFT JOIN named ON named.id = p.id LEFT JOIN touched ON touched.id = p.id""")
def dbscan_clusters(t: Tables) -> DataFrame:
    """Kind and cluster of every customer, a cluster named by its smallest core point."""
    return dbscan(t).select("id", "kind", "cluster")


@query()
def dbscan(t: Tables) -> DataFrame:
    points = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return density.dbscan(points, ["x", "y"], "id", eps=1.2, min_samples=5)


WIDE, NEAR_SQUARED = 25, 0.34
WIDE_POINTS = f"SELECT vec_id AS id, embedding[1:{WIDE}]::DOUBLE[] AS x FROM embeddings"


@query(f"""
    WITH RECURSIVE p AS ({WIDE_POINTS}),
    near AS (SELECT a.id AS id, b.id AS other FROM p a JOIN p b ON list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= {NEAR_SQUARED}),
    core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5),
    link AS (SELECT * FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.other, reach.root FROM reach JOIN link ON link.id = reach.id),
    named AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
    touched AS (SELECT near.id, min(cluster) AS cluster FROM near JOIN named ON named.id = near.other GROUP BY near.id)
    SELECT p.id, CASE WHEN named.id IS NOT NULL THEN 'core' WHEN touched.id IS NOT NULL THEN 'border' ELSE 'noise' END AS kind,
        coalesce(named.cluster, touched.cluster, -1) AS cluster
    FROM p LEFT JOIN named ON named.id = p.id LEFT JOIN touched ON touched.id = p.id""")
def dbscan_wide(t: Tables) -> DataFrame:
    """Kind and cluster of every vector by twenty-five of its columns."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(WIDE)])
    return density.dbscan(rows, [f"x{i}" for i in range(WIDE)], "id", eps=NEAR_SQUARED ** 0.5, min_samples=5).select("id", "kind", "cluster")


@query()
def isolation_forest(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.count("*").alias("lines")
    )
    return isolation.isolation_forest(rows, ["quantity", "price", "discount", "lines"], ["l_orderkey"])


def marked_claims(t: Tables) -> tuple[DataFrame, list[str]]:
    """All claims without duplicate rows, with a feature for every status, type, part and item there is, marked."""
    features = claims.claim_features(t, clean.distinct_rows(claims.claims(t)))
    found = claims_plan.claim_outliers(features, claims.KEYS)
    return found.rows, [c for c in found.rows.columns if c not in (*claims.KEYS, "score", "anomaly")]


@query()
def claim_anomalies(t: Tables) -> DataFrame:
    """All claims without duplicate rows: features, components, isolation forest, mark per claim row."""
    rows, _ = marked_claims(t)
    return rows.select(*claims.KEYS, "score", "anomaly")


@query()
def rf_importance(t: Tables) -> DataFrame:
    """What a forest relies on to tell the claims that the isolation forest marks from the others."""
    rows, numbers = marked_claims(t)
    table, _ = explain.random_forest_importance(rows, numbers, "anomaly", claims.KEYS)
    return table


@query()
def one_vs_rest_importance(t: Tables) -> DataFrame:
    wide = t.embeddings.where(F.size("embedding") > 0).select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMBEDDING_SIZE)]
    )
    return explain.one_vs_rest_importance(wide, [f"e{i}" for i in range(EMBEDDING_SIZE)], "label", ["vec_id"])


@query()
def sentence_embedding(t: Tables) -> DataFrame:
    """Mean word vectors of the conversation turns."""
    rows = vectors.average_word_vectors(t.conversations.select("conv_id", "turn", "text"), "text", size=32)
    return rows.select("conv_id", "turn", "embedding")


def _token_measures():
    """An encoder as a caller would hand it over: length and first letter of each token."""
    return lambda texts: [[(len(w), w[0] in "aeiou") for w in t.split(" ") if w] for t in texts]


@query("""
    SELECT conv_id, turn, list_avg(list_transform(w, lambda x: length(x)))::FLOAT::DOUBLE AS embedding_0,
           list_avg(list_transform(w, lambda x: (x[1] IN ('a', 'e', 'i', 'o', 'u'))::INTEGER))::FLOAT::DOUBLE AS embedding_1
    FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL)""")
def encoded_turns(t: Tables) -> DataFrame:
    """Means of the token vectors of a given encoder for each turn."""
    rows = vectors.encode_texts(t.conversations.select("conv_id", "turn", "text"), "text", _token_measures, per_token=True)
    return rows.select("conv_id", "turn", *[F.col("embedding")[i].cast("double").alias(f"embedding_{i}") for i in range(2)])


@query()
def topic_extraction(t: Tables) -> DataFrame:
    """Conversation sentences, cleaned and embedded, in twelve topics with the words that stand out."""
    rows = topics_plan.sentence_vectors(t.conversations, "text", ["conv_id", "turn"], size=32, pattern=r"[^\w\s]|http\S+|\d+", stop_words=())
    found = topics_plan.extract_topics(rows, ["conv_id", "turn", "sentence_no"], components=16, k=12, n=2, max_iter=100)
    return topics_plan.with_topics(found, ["conv_id", "turn", "sentence_no"])


@query()
def one_step_forecast(t: Tables) -> DataFrame:
    return forecast.one_step_forecast(series.series_for_key(traffic.features(t)))


@query()
def series_forecast(t: Tables) -> DataFrame:
    """One step ahead with a model of its own for each province, with and without the match indicator."""
    return forecast.series_forecast(series.series_for_key(traffic.features(t)))


@query("""
    SELECT user_id, count(*) AS rows, round(coalesce(regr_slope(value, minute), 0), 6) AS slope,
           round(coalesce(regr_intercept(value, minute), avg(value)), 6) AS intercept
    FROM (SELECT user_id, value, hour(ts) * 60 + minute(ts) AS minute FROM events) GROUP BY user_id HAVING count(DISTINCT minute) > 1""")
def series_trend(t: Tables) -> DataFrame:
    """A line through the values of each user by minute of the day."""
    rows = t.events.select("user_id", "value", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    several = rows.groupBy("user_id").agg(F.count_distinct("minute").alias("n")).where("n > 1")
    models = forecast.series_models(rows.join(several, "user_id", "left_semi"), ["minute"], "value", ["user_id"])
    found = models.select("user_id", "rows", F.col("coefficients")[1].alias("slope"), F.col("coefficients")[0].alias("intercept"))
    return rounded(found, ["slope", "intercept"], 6)


@query("""
    SELECT user_id, count(*) AS rows, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM (
        SELECT user_id, value - (regr_slope(value, minute) OVER u * minute + regr_intercept(value, minute) OVER u) AS e
        FROM (SELECT user_id, value, hour(ts) * 60 + minute(ts) AS minute FROM events) WINDOW u AS (PARTITION BY user_id))
    WHERE e IS NOT NULL GROUP BY user_id""")
def series_trend_errors(t: Tables) -> DataFrame:
    """How far the values of each user are from their line."""
    rows = t.events.select("user_id", "value", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    several = rows.groupBy("user_id").agg(F.count_distinct("minute").alias("n")).where("n > 1").select("user_id")
    rows = rows.join(several, "user_id", "left_semi")
    said = forecast.series_predictions(rows, forecast.series_models(rows, ["minute"], "value", ["user_id"]), ["minute"], ["user_id"])
    return rounded(forecast.regression_metrics(said, "value", "predicted", ["user_id"]).select("user_id", "rows", "rmse", "mae"), ["rmse", "mae"], 6)


TEXT_MEASURES = ["chars", "words", "distinct_words", "lines", "digits", "capitals"]


def labelled_measures(t: Tables) -> DataFrame:
    """Simple measures of the labelled texts, split three ways."""
    words = F.split("text", r"\s+")
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("chars"), F.size(words).cast("double").alias("words"),
        F.size(F.array_distinct(words)).cast("double").alias("distinct_words"), F.size(F.split("text", "\n")).cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("capitals"),
    )
    return explain.three_way_split(rows, ["doc_id"])


@query()
def two_target_model(t: Tables) -> DataFrame:
    """Toxicity as binary and quality as number target from simple measures of the text."""
    found = forecast.two_target_model(labelled_measures(t), TEXT_MEASURES, "toxic", "quality")
    return found.select("doc_id", "split", "quality", "toxic", "predicted_toxic", "predicted_quality")


@query()
def two_target_joint(t: Tables) -> DataFrame:
    """The same two targets from one network whose layers both share."""
    found, _ = joint.joint_model(labelled_measures(t), TEXT_MEASURES, "toxic", "quality", rounds=40)
    return found.select("doc_id", "split", "quality", "toxic", "predicted_toxic", "predicted_quality")
