"""Lookup of moments in overlapping intervals against plain search."""

import random

from pyspark.sql import functions as F

from tessella.operators.joins import interval_at


def test_moments(spark):
    dice = random.Random(1)
    spans = [(dice.choice("aaab"), s := dice.randrange(1000), s + dice.choice([0, 1, 5, 300, -3]), i) for i in range(200)]
    spans += [("a", None, 5, 900), ("a", 5, None, 901), (None, 0, 1000, 902), ("c", 10, 20, 903), ("c", 20, 30, 904), ("c", 10, 25, 905)]
    moments = [(dice.choice("aaabd"), dice.randrange(1010)) for _ in range(600)] + [("c", t) for t in range(8, 33)] * 2 + [(None, 5), ("a", None)]
    left = spark.createDataFrame([(*m, i) for i, m in enumerate(moments)], "k string, t long, id long").repartition(5)
    right = spark.createDataFrame(spans, "k string, since long, until long, v long").repartition(3)
    got = {r["id"]: r["v"] for r in interval_at(left, "t", right, "since", "until", ["k"], ["v"]).collect()}
    assert len(got) == len(moments)
    for i, (k, t) in enumerate(moments):
        open_ = [(s, e) for kk, s, e, v in spans if None not in (kk, s, e, k, t) and kk == k and s <= t <= e]
        best = {v for kk, s, e, v in spans if open_ and (kk, s, e) == (k, *min(open_))}
        assert got[i] in best if open_ else got[i] is None, (i, k, t)
    assert interval_at(left.limit(0), "t", right, "since", "until", ["k"], ["v"]).count() == 0
    assert interval_at(left, "t", right.limit(0), "since", "until", ["k"], ["v"]).where(F.col("v").isNotNull()).count() == 0
