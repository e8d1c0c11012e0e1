"""As-of, band and overlap joins on a sequence key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.operators import seq


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], tolerance: int | None = None, width: int | None = None) -> DataFrame:
    """Each left row with the columns of the last right row at or before it: one union and one window, no range join.

    Where several right rows share that time, the one with the greatest columns counts. Beyond tolerance: nulls. With width, the window runs in stretches of so much time (see seq.scan).
    """
    packed = F.struct(F.col(time).alias("t"), *[F.col(c).alias(c) for c in columns])
    kind = right.select(packed.alias("s")).schema["s"].dataType
    a = left.withColumn("_side", F.lit(1)).withColumn("_hit", F.lit(None).cast(kind))
    b = right.select(*keys, time, F.lit(0).alias("_side"), packed.alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [time, "_side", "_hit"]
    if width:
        out = seq.scan(both, keys, order, F.floor(F.col(time) / width), _seen=("last", F.col("_hit"))).where("_side = 1")
    else:
        out = both.withColumn("_seen", F.last("_hit", True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where("_side = 1")
    if tolerance is not None:
        out = out.withColumn("_seen", F.when(F.col(time) - F.col("_seen.t") <= tolerance, F.col("_seen")))
    return out.select(*left.columns, F.col("_seen.t").alias(f"match_{time}"), *[F.col(f"_seen.{c}").alias(f"match_{c}") for c in columns])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, how: str) -> DataFrame:
    """Semi or anti join of aliases l and r: equal keys and a condition on both sides.

    The keys make it an equi-join: all rows of one sequence meet, so both sides should have few rows a key. Spans of long sequences: with_overlap.
    """
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    where = condition
    for s in same:
        where = where & s
    return left.alias("l").join(right.alias("r"), where, {"semi": "left_semi", "anti": "left_anti", "inner": "inner", "left": "left"}[how])


def with_overlap(left: DataFrame, right: DataFrame, keys: list[str], start: Column, stop: Column, from_: Column, to: Column, how: str, width: int | None = None) -> DataFrame:
    """Semi or anti join: left rows with (without) a right row that begins before stop and ends after start, of equal keys.

    start and stop are columns of left, from_ and to of right, numbers or times. No pairs are made: of all right rows that begin before a left row's stop, the
    greatest end decides, a running maximum over one union. A null bound overlaps nothing. With width (numbers only), that runs in stretches of so much (see seq.scan).
    """
    packed = F.struct(*left.columns)
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ends = [f"_k{i}" for i in range(len(keys))]
    a = left.select(*names, stop.alias("_at"), F.lit(0).alias("_side"), start.alias("_from"), packed.alias("_row"))
    b = right.select(*names, from_.alias("_at"), F.lit(1).alias("_side"), to.alias("_to")).where("_at is not null")
    both = a.unionByName(b, allowMissingColumns=True)
    if width:
        both = seq.scan(both, ends, ["_at", "_side"], F.floor(F.col("_at") / width), _most=("max", F.col("_to")))
    else:
        both = both.withColumn("_most", F.max("_to").over(W.partitionBy(*ends).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)))
    hit = F.coalesce(F.col("_most") > F.col("_from"), F.lit(False)) & F.col("_at").isNotNull()
    return both.where(F.col("_side") == 0).where(hit if how == "semi" else ~hit).select("_row.*")


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int) -> DataFrame:
    """Inner join of aliases l and r whose spans overlap, of equal keys. Spans meet by time buckets of `width`; a pair is made in the first bucket that both touch.

    Spans are (start, stop) columns of their own side, stop exclusive. Work follows the pairs and the buckets that spans touch, not all pairs of a key.
    """

    def spread(df, span):
        a, b = F.floor(span[0] / width), F.floor((span[1] - 1) / width)
        rows = df.withColumn("_a", span[0]).withColumn("_b", span[1]).where("_b > _a").withColumn("_first", a)
        return rows.withColumn("_bucket", F.explode(F.sequence(a, b)))

    l, r = spread(left, left_span).alias("l"), spread(right, right_span).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_bucket"]]
    where = (F.col("l._a") < F.col("r._b")) & (F.col("r._a") < F.col("l._b")) & (F.col("l._bucket") == F.greatest("l._first", "r._first"))
    for x in same:
        where = where & x
    return l.join(r, where)


def band(left: DataFrame, right: DataFrame, keys: list[str], time: str, before: int, after: int, how: str, extra: Column | None = None) -> DataFrame:
    """Semi or anti join on -before <= r.time - l.time <= after for one sequence.

    Right times are put in buckets as wide as the band and copied to the bucket before, so rows meet by equal keys and buckets only.
    """
    width = before + after + 1
    at = F.floor(F.col(time) / width)
    points = right.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))
    origin = left.withColumn("_b", at)
    cond = (F.col(f"r.{time}") - F.col(f"l.{time}")).between(-before, after)
    if extra is not None:
        cond = cond & extra
    return overlapping(origin, points, [*keys, "_b"], cond, how).drop("_b")
