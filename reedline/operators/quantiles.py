"""Exact percentiles of groups of any size, by counting in ever narrower buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from reedline.sources.shared import stored

BUCKETS = 4096
#: Values of one bucket that are sorted at once; larger buckets are counted again.
PICK = 4096


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], buckets: int = BUCKETS, pick: int = PICK) -> DataFrame:
    """keys and a column for each wanted percentile (name: share, 0 to 1), exact, with linear interpolation between neighbouring values.

    A percentile lies between two values of known rank. For each such rank, the values of the range that holds it are counted in equal buckets, and the bucket that the
    rank falls into, from its least to its greatest value, is the next range; one with a single value, or few enough rows to sort, gives the answer. Each round is one pass over df
    and an aggregation of at most `buckets` counts a group and rank, added up before the shuffle, so neither the rows of a group nor its distinct values ever meet in one
    task. Two or three rounds are usual. Nulls and nan don't count; a group without values has nulls; df without rows gives none. df is read once a round: store it first where it is dear.
    """
    if not keys or not all(0 <= share <= 1 for share in wanted.values()):
        raise ValueError("keys must be named and shares be 0 to 1")
    names = [f"_k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    number = F.col(value).cast("double")
    rows = df.select(*own, F.when(~F.isnan(number), number).alias("v"))
    whole = stored(rows.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")), "ranges")
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.floor if side == 0 else F.ceil)(F.lit(share) * (F.col("n") - 1)).cast("long").alias("rank")) for name, share in wanted.items() for side in (0, 1)]
    asked = whole.where("n > 0").select(*names, "a", "b", F.col("n").alias("held"), F.lit(0).cast("long").alias("below"), F.explode(F.array(*ranks)).alias("r"))
    open_ = asked.groupBy(*names, F.col("r.rank").alias("rank")).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("held").alias("held"), F.first("below").alias("below"))
    done = None
    while True:
        open_ = stored(open_, "open-ranks")
        found = open_.where("a = b").select(*names, "rank", F.col("a").alias("v"))
        few = (F.col("a") < F.col("b")) & (F.col("held") <= pick)
        sorted_ = _in_range(rows, open_.where(few), names).groupBy(*names, "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("below").alias("below"))  # at most `pick`
        found = found.unionByName(sorted_.select(*names, "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v")))
        done = found if done is None else done.unionByName(found)
        more = open_.where((F.col("a") < F.col("b")) & ~few)
        if more.isEmpty():
            break
        # the two ends have buckets of their own, so each round narrows the range, even one between infinities; halves, since b - a may be beyond the largest double
        part = F.nanvl((F.col("v") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2), F.lit(0.0))
        middle = F.least(F.lit(buckets - 1), F.floor(part * buckets)).cast("int")
        bucket = F.when(F.col("v") == F.col("a"), -1).when(F.col("v") == F.col("b"), buckets).otherwise(middle)
        counts = _in_range(rows, more, names).groupBy(*names, "rank", "below", bucket.alias("bucket")).agg(F.count("*").alias("held"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("held").over(W.partitionBy(*names, "rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("held")
        counts = counts.withColumn("below", F.col("below") + before)
        open_ = counts.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("held"))).select(*names, "rank", "a", "b", "held", "below")
    exact = stored(done, "ranked").alias("x")
    same = [F.col(f"w.{n}").eqNullSafe(F.col(f"x.{n}")) for n in names] + [F.col("w.r.rank") == F.col("x.rank")]
    joined = asked.alias("w").join(exact, same).select(*[f"w.{n}" for n in names], F.col("w.held").alias("n"), "w.r.name", "w.r.side", "x.v")
    sides, out, between = [], [], _interpolation()
    for name, share in wanted.items():
        sides += [F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v"))).alias(f"_{name}_{side}") for side in (0, 1)]
        place = F.lit(share) * (F.col("n") - 1)
        out.append(between(F.col(f"_{name}_0"), F.col(f"_{name}_1"), place - F.floor(place)).alias(name))
    values = joined.groupBy(*names).agg(F.first("n").alias("n"), *sides).select(*names, *out).alias("x")
    back = whole.alias("w").join(values, [F.col(f"w.{n}").eqNullSafe(F.col(f"x.{n}")) for n in names], "left")
    return back.select(*[F.col(f"w.{n}").alias(k) for n, k in zip(names, keys)], *wanted)


def _interpolation():
    """low * (1 - part) + high * part with the first product unrounded, as DuckDB's quantile_cont has it: a value that equals a percentile is compared with its last bit."""

    def between(low, high, part):
        if low is None or high is None or part == 0:
            return low
        try:
            return math.fma(low, 1 - part, high * part)
        except ValueError:  # between infinities of unlike sign
            return math.nan

    return F.udf(between, DoubleType())


def _in_range(rows: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """The values in the range of each open rank of their group."""
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names]
    inside = rows.alias("r").join(ranges.alias("o"), [*same, F.col("r.v").between(F.col("o.a"), F.col("o.b"))])
    return inside.select(*[f"o.{n}" for n in names], "o.rank", "o.below", "o.a", "o.b", "r.v")
