"""Sequences of any length: scans in stretches against one window a key, and exact percentiles against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.operators import joins, quantiles, seq

ROWS = "k string, t long, v double, x string"


def signal(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(-300, 3000) if r.random() < 0.7 else r.randrange(50), None if r.random() < 0.4 else r.uniform(-5, 5), f"x{j}") for j in range(n)]
    return spark.createDataFrame(rows, ROWS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 7, 250, 10_000])
def test_scan_equals_one_window_a_key(spark, width):
    s = signal(spark)
    order = ["t", "x"]
    upto, w = W.partitionBy("k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("k").orderBy(*order)
    want = s.select("*", F.sum("v").over(upto).alias("total"), F.max("v").over(upto).alias("top"), F.last("v", True).over(upto).alias("seen"), F.lag("v").over(w).alias("back"), F.lead("x").over(w).alias("ahead"))
    got = seq.scan(s, ["k"], order, F.floor(F.col("t") / width), total=("sum", F.col("v")), top=("max", F.col("v")), seen=("last", F.col("v")), back=("previous", F.col("v")), ahead=("next", F.col("x")))

    def plain(df):
        return sorted((tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in df.collect()), key=repr)

    assert plain(got) == plain(want)


@pytest.mark.parametrize("width", [3, 40, 5000])
def test_islands_merging_numbers_and_runs(spark, width):
    s = signal(spark, 2).where("k is not null").dropDuplicates(["k", "t"])
    w = seq.within(["k"], "t")
    want = seq.islands(s, ["k"], "t", F.col("t") - F.lag("t").over(w) > 5)
    got = seq.islands_after(s, ["k"], ["t"], F.floor(F.col("t") / width), F.col("t"), lambda before: F.col("t") - before > 5)
    assert rows(got.select("k", "t", "island")) == rows(want.select("k", "t", "island"))
    numbers = s.select("k", "t", F.row_number().over(w).cast("long").alias("i"))
    assert rows(seq.numbered(s.select("k", "t"), ["k"], ["t"], F.floor(F.col("t") / width))) == rows(numbers)
    signs = numbers.join(s, ["k", "t"])
    runs = seq.runs(signs, ["k"], "i", F.col("v") > 0)
    assert rows(seq.runs(signs, ["k"], "i", F.col("v") > 0, chunk=width)) == rows(runs)
    assert rows(seq.merge_runs(runs, ["k"], 2, 2, width=width)) == rows(seq.merge_runs(runs, ["k"], 2, 2))


@pytest.mark.parametrize("width", [10, 3000])
def test_asof_and_overlap_in_stretches(spark, width):
    s = signal(spark, 3)
    left, right = s.where("v is null").select("k", "t", "x"), s.where("v is not null").select("k", "t", "v")
    for tolerance in (None, 20):
        assert rows(joins.asof_backward(left, right, ["k"], "t", ["v"], tolerance, width)) == rows(joins.asof_backward(left, right, ["k"], "t", ["v"], tolerance))
    spans, others = (d.withColumn("to", F.col("t") + F.pmod(F.xxhash64("x" if "x" in d.columns else "v"), F.lit(90)).cast("long")) for d in (left, right))
    for how in ("semi", "anti"):
        args = (spans, others, ["k"], F.col("t"), F.col("to"), F.col("t"), F.col("to"), how)
        assert rows(joins.with_overlap(*args, width=width)) == rows(joins.with_overlap(*args))


def test_overlap_of_timestamps(spark):
    spans = spark.sql("select 'a' k, timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 01:00:00' b union all select 'a', timestamp'2024-01-02', timestamp'2024-01-03'")
    other = spark.sql("select 'a' k, timestamp'2024-01-01 00:30:00' a, timestamp'2024-01-01 02:00:00' b")
    got = joins.with_overlap(spans, other, ["k"], F.col("a"), F.col("b"), F.col("a"), F.col("b"), "semi").collect()
    assert [r.b.hour for r in got] == [1]


def test_a_sequence_that_is_all_rows_is_many_tasks_work(spark):
    s = spark.range(200_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    out = seq.islands_after(s, ["k"], ["t"], F.floor(F.col("t") / 5000), F.col("v"), lambda before: before == 0)
    busy = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]
    assert len(busy) >= 3 and busy.max() <= 100_000 and out.agg(F.max("island")).first()[0] == s.where("v = 0 and t < 199999").count()


@pytest.mark.parametrize(("buckets", "pick"), [(4096, 4096), (4, 3)])
def test_percentiles_equal_numpy(spark, buckets, pick):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(0, 1, 500), "same": np.full(300, 7.5), "one": np.array([2.0]), "two": np.array([1.0, 2.0]), "ties": rng.integers(0, 4, 400).astype(float), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, 5.0]),
        "outlier": np.append(rng.normal(0, 1e-9, 400), 1e12), "far": np.array([np.inf, 1.0, 2.0, -np.inf, 3.0]),
    }
    table = [(k, float(v)) for k, x in groups.items() for v in x] + [("nothing", None), ("nothing", float("nan")), ("one", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(table, "k string, v double").repartition(5)
    wanted = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "high": 1.0}
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", wanted, buckets, pick).collect()}
    assert len(got) == len(groups) + 2 and got["nothing"].mid is None and got[None].mid == 4.0
    for k, x in groups.items():
        for name, share in wanted.items():
            with np.errstate(invalid="ignore", over="ignore"):
                want = float(np.percentile(x, share * 100))
            if k not in ("wide", "far") or np.isfinite(want) and share * (len(x) - 1) == int(share * (len(x) - 1)):
                assert got[k][name] == pytest.approx(want, rel=1e-12, abs=1e-300), (k, name)
    assert quantiles.percentiles(df.limit(0), ["k"], "v", wanted).count() == 0


def test_percentiles_equal_quantile_cont_to_the_last_bit(spark):
    """A threshold is compared with the values it is made of, so a percentile that is off by one bit moves a value to the other side."""
    import duckdb

    r = random.Random(11)
    data = [(k, float(r.randrange(56_000)) / 100) for k in range(300) for _ in range(r.randrange(1, 130))] + [(k, 0.1 * k) for k in range(300, 340) for _ in range(17)]
    found = {row.k: tuple(row)[1:] for row in quantiles.percentiles(spark.createDataFrame(data, "k long, v double"), ["k"], "v", {"p10": 0.1, "p90": 0.9, "p50": 0.5}).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, v DOUBLE)")
    con.execute(f"INSERT INTO t VALUES {', '.join(map(str, data))}")
    assert found == {k: tuple(v) for k, *v in con.execute("SELECT k, quantile_cont(v, 0.1), quantile_cont(v, 0.9), quantile_cont(v, 0.5) FROM t GROUP BY 1").fetchall()}
