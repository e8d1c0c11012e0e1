"""Operators that work in stretches of a sequence give what they give on the whole; overlaps without pairs equal those with."""

import random

import pytest
from pyspark.sql import functions as F

from reedline.operators import joins, seq


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(k, i, float(r.randrange(5))) for k, n in (("a", 1000), ("b", 3), ("c", 137)) for i in range(n)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k string, i long, v double").repartition(4).persist()


def same(a, b):
    assert a.columns == b.columns and a.count() == b.count()
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("chunk", [7, 50, 2000])
def test_stretches_equal_the_whole(rows, chunk):
    k = ["k"]
    same(seq.runs(rows, k, "i", F.col("v") >= 1).select("k", "start", "stop", "length"), seq.runs(rows, k, "i", F.col("v") >= 1, chunk=chunk).select("k", "start", "stop", "length"))
    for before, after in ((-3, 3), (0, 5), (-7, 0)):
        same(seq.sliding(rows, k, "i", F.max("v"), before, after, "m"), seq.sliding(rows, k, "i", F.max("v"), before, after, "m", chunk=chunk))
    same(seq.envelope(rows, k, "i", F.col("v"), 5), seq.envelope(rows, k, "i", F.col("v"), 5, chunk=chunk).select("k", "i", "v", "env"))


@pytest.mark.parametrize("how", ["semi", "anti"])
def test_overlaps_without_pairs(spark, how):
    r = random.Random(5)

    def spans(n):
        return [(r.choice("xyz"), a, a + r.randrange(0, 12)) for a in (r.randrange(300) for _ in range(n))] + [("x", None, 5)]

    a, b = (spark.createDataFrame(spans(n), "k string, a long, b long") for n in (120, 40))
    got = joins.with_overlap(a, b, ["k"], F.col("a") - 2, F.col("b") + 3, F.col("a"), F.col("b"), how)
    near = (F.col("r.a") < F.col("l.b") + 3) & (F.col("r.b") > F.col("l.a") - 2)
    want = joins.overlapping(a, b, ["k"], near, how)
    same(got, want)
    assert 0 < got.count() < 121


def test_overlapping_pairs(spark):
    r = random.Random(6)
    a, b = (spark.createDataFrame([(r.choice("xy"), s, s + r.randrange(1, 40)) for s in (r.randrange(500) for _ in range(n))], "k string, a long, b long") for n in (80, 60))
    got = joins.overlapping_pairs(a, b, ["k"], (F.col("a"), F.col("b")), (F.col("a"), F.col("b")), 16).select("l.k", "l.a", "l.b", F.col("r.a").alias("c"), F.col("r.b").alias("d"))
    want = joins.overlapping(a, b, ["k"], (F.col("r.a") < F.col("l.b")) & (F.col("r.b") > F.col("l.a")), "inner").select("l.k", "l.a", "l.b", F.col("r.a").alias("c"), F.col("r.b").alias("d"))
    same(got, want)


def test_clusters_of_a_whole_table(spark):
    r = random.Random(7)
    values = sorted({r.randrange(3000) for _ in range(900)} | set(range(990, 1015)) | set(range(1995, 4005, 2)))
    want, start = [], 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] - values[k - 1] > 2:
            want.append((values[start], values[k - 1], k - start))
            start = k
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(5)
    assert sorted(map(tuple, seq.clusters_1d(df, "v", 2, 100).collect())) == want
    assert seq.clusters_1d(df.where("false"), "v", 2, 100).count() == 0
    with pytest.raises(ValueError):
        seq.cluster_1d(df, [], "v", 2)
