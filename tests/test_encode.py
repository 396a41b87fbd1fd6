"""A given encoder over texts, whole and token by token."""

from tessella.operators.vectors import encode_texts


def test_given_encoder(spark):
    def whole_texts(texts):
        return [(len(t), t.count("a")) for t in texts]

    def by_token(texts):
        return [[(len(w), 1) for w in t.split()] for t in texts]

    rows = spark.createDataFrame([(1, "a banana"), (2, ""), (3, None), (4, "a banana")], "id long, text string")
    whole = {r.id: r.embedding for r in encode_texts(rows, "text", lambda: whole_texts).collect()}
    assert whole == {1: [8.0, 4.0], 2: [0.0, 0.0], 4: [8.0, 4.0]}
    mean = {r.id: r.v for r in encode_texts(rows, "text", lambda: by_token, "v", per_token=True).collect()}
    assert mean == {1: [3.5, 1.0], 2: None, 4: [3.5, 1.0]}
    assert encode_texts(rows.limit(0), "text", lambda: whole_texts).count() == 0
