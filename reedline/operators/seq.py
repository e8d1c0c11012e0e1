"""Operators on ordered sequences: any DataFrame with key columns, an order column and values.

Every window is partitioned by the keys, so sequences run in parallel and nothing is ordered globally. One very long sequence runs in parallel too where a stretch
is given: windows of a bounded reach look into the neighbouring stretch (chunked), and those that look back to the start get what came before as one row (scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def within(keys: list[str], order: str | list[str]) -> W:
    return W.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def chunked(df: DataFrame, order: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with _chunk, a stretch of `size` numbers of order, and _own; each also in the neighbouring stretch that looks `before` back or `after` ahead at it (at most size).

    So windows of a bounded reach run by keys and stretch, however long one sequence is. order must be consecutive integers.
    """
    c = F.floor(F.col(order) / size)
    later, earlier = F.when(F.col(order) + before >= (c + 1) * size, c + 1), F.when(F.col(order) - after < c * size, c - 1)
    return df.withColumn("_chunk", F.explode(F.array_compact(F.array(c, later, earlier)))).withColumn("_own", F.col("_chunk") == c)


def scan(df: DataFrame, keys: list[str], order: list[str], stretch: Column, **columns: tuple[str, Column]) -> DataFrame:
    """df with columns that follow from all rows before, however long one sequence is: name=(kind, value).

    Kinds: sum, max and last (the last value that isn't null) up to and with the row; previous and next, the value of the neighbouring row, null at the ends. stretch is a number that
    never falls along order. Each stretch is summed up to one row, those rows are scanned in order, and what came before a stretch leads its rows in a
    window by keys and stretch, so no task sees more than one stretch, or the summaries of one sequence. Rows of equal order count in any order; null keys are a sequence, a null stretch comes first.
    """
    held = {n: (kind, F.struct(value.alias("v")) if kind in ("previous", "next") else value) for n, (kind, value) in columns.items()}
    place = F.struct(*order)
    parts = df.select("*", stretch.alias("_s"), F.lit(1).alias("_lead"), *[value.alias(f"_v_{n}") for n, (_, value) in held.items()])
    whole = {
        "sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), place)), "previous": lambda v: F.max_by(v, place), "next": lambda v: F.min_by(v, place),
    }
    sums = parts.groupBy(*keys, "_s").agg(*[whole[kind](F.col(f"_v_{n}")).alias(f"_v_{n}") for n, (kind, _) in held.items()])
    along = W.partitionBy(*keys).orderBy("_s")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    carried = {
        "sum": lambda v: F.sum(v).over(before), "max": lambda v: F.max(v).over(before), "last": lambda v: F.last(v, True).over(before), "previous": lambda v: F.lag(v).over(along), "next": lambda v: F.lead(v).over(along),
    }
    sides = [(0, [n for n, (kind, _) in held.items() if kind != "next"]), (2, [n for n, (kind, _) in held.items() if kind == "next"])]
    both = parts
    for side, names in sides:
        if names:
            lead = sums.select(*keys, "_s", F.lit(side).alias("_lead"), *[carried[held[n][0]](F.col(f"_v_{n}")).alias(f"_v_{n}") for n in names])
            both = both.unionByName(lead, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_s").orderBy("_lead", *order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    found = {
        "sum": lambda v: F.sum(v).over(upto), "max": lambda v: F.max(v).over(upto), "last": lambda v: F.last(v, True).over(upto),
        "previous": lambda v: F.lag(v).over(inside).getField("v"), "next": lambda v: F.lead(v).over(inside).getField("v"),
    }
    out = both.select("*", *[found[kind](F.col(f"_v_{n}")).alias(n) for n, (kind, _) in held.items()])
    return out.where(F.col("_lead") == 1).select(*df.columns, *held)


def runs(df: DataFrame, keys: list[str], order: str, mask: Column, *aggs: Column, chunk: int | None = None) -> DataFrame:
    """Maximal runs of rows that fulfil mask: keys, start, stop (exclusive), length. order must be consecutive integers.

    With chunk (and no aggs), runs are found within stretches of so many rows, and runs that touch are then joined, in stretches too.
    """
    held, by = df.where(mask), keys
    if chunk:
        held, by = held.withColumn("_chunk", F.floor(F.col(order) / chunk)), [*keys, "_chunk"]
    island = F.col(order) - F.row_number().over(within(by, order))
    found = held.withColumn("_island", island).groupBy(*by, "_island").agg(
        F.min(order).cast("long").alias("start"), (F.max(order) + 1).cast("long").alias("stop"), F.count("*").cast("long").alias("length"), *aggs
    ).drop("_island", "_chunk")
    return merge_runs(found, keys, 0, width=chunk) if chunk else found


def numbered(df: DataFrame, keys: list[str], order: list[str], stretch: Column, name: str = "i") -> DataFrame:
    """Number the rows of each sequence from 1, in stretches (see scan). order must be total."""
    return scan(df, keys, order, stretch, **{name: ("sum", F.lit(1).cast("long"))})


def islands_after(df: DataFrame, keys: list[str], order: list[str], stretch: Column, value: Column, breaks, name: str = "island") -> DataFrame:
    """islands in stretches (see scan): a new group where breaks(value of the row before), a column, is true; null there is the first row."""
    before = scan(df, keys, order, stretch, _before=("previous", value))
    flagged = before.withColumn("_new", F.coalesce(breaks(F.col("_before")).cast("long"), F.lit(0).cast("long"))).drop("_before")
    return scan(flagged, keys, order, stretch, **{name: ("sum", F.col("_new"))}).drop("_new")


def islands(df: DataFrame, keys: list[str], order: str | list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number groups of neighbouring rows: a new one where breaks is true (null: false). breaks may use lag over the same order."""
    w = within(keys, order)
    flagged = df.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(0)))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def merge_runs(found: DataFrame, keys: list[str], max_gap: int, min_length: int = 0, width: int | None = None) -> DataFrame:
    """Runs whose gap is at most max_gap become one; those of min_length or more stay: keys, start, stop, length. With width, in stretches of so many places (see scan)."""
    if width:
        joined = islands_after(found, keys, ["start"], F.floor(F.col("start") / width), F.col("stop"), lambda stop: F.col("start") - stop > max_gap)
    else:
        joined = islands(found, keys, "start", F.col("start") - F.lag("stop").over(within(keys, "start")) > max_gap)
    out = joined.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
    out = out.withColumn("length", F.col("stop") - F.col("start"))
    return out.where(F.col("length") >= min_length)


def envelope(df: DataFrame, keys: list[str], order: str, value: Column, size: int, name: str = "env", chunk: int | None = None) -> DataFrame:
    """Mean of `size` rows from each row on; the last size - 1 rows get the last whole mean. Sequences shorter than size have none.

    With chunk, stretches of so many rows are averaged each by itself, and the last rows find the last whole mean by a join.
    """
    by = [*keys, "_chunk"] if chunk else keys
    ahead = within(by, order).rowsBetween(0, size - 1)
    source = chunked(df, order, chunk, 0, size - 1) if chunk else df
    out = source.withColumn("_whole", F.when(F.count("*").over(ahead) == size, F.avg(value).over(ahead)))
    if not chunk:
        return out.withColumn(name, F.coalesce("_whole", F.last("_whole", True).over(within(keys, order).rowsBetween(W.unboundedPreceding, 0)))).drop("_whole")
    out = out.where("_own").drop("_chunk", "_own")
    last = out.where("_whole is not null").groupBy(*keys).agg(F.max_by("_whole", order).alias("_last"))
    return out.join(last, keys, "left").withColumn(name, F.coalesce("_whole", "_last")).drop("_whole", "_last")


def sliding(df: DataFrame, keys: list[str], order: str, how, before: int, after: int, name: str, chunk: int | None = None) -> DataFrame:
    """A clipped sliding aggregate over rows before..after; for max and min that equals repeating the edge values. With chunk, in stretches of so many rows."""
    if not chunk:
        return df.withColumn(name, how.over(within(keys, order).rowsBetween(before, after)))
    parts = chunked(df, order, chunk, max(0, -before), max(0, after))
    return parts.withColumn(name, how.over(within([*keys, "_chunk"], order).rowsBetween(before, after))).where("_own").drop("_chunk", "_own")


def sliding_range(df: DataFrame, keys: list[str], order: str, how, before: int, after: int, name: str, width: int) -> DataFrame:
    """An aggregate over the rows whose order lies `before` below to `after` above the row's, in stretches of so much (at least before and after)."""
    parts = chunked(df, order, width, max(0, before, -after), max(0, before, after))
    return parts.withColumn(name, how.over(within([*keys, "_chunk"], order).rangeBetween(-before, after))).where("_own").drop("_chunk", "_own")


def edge_mean(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, name: str) -> DataFrame:
    """Sliding mean over rows before..after with edge values repeated outside."""
    w = within(keys, order)
    every = W.partitionBy(*keys)
    size = after - before + 1
    frame = w.rowsBetween(before, after)
    at, n = F.row_number().over(w), F.count("*").over(every)
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    left = F.greatest(F.lit(0), -before - (at - 1))
    right = F.greatest(F.lit(0), after - (n - at))
    return df.withColumn(name, (F.sum(value).over(frame) + left * first + right * last) / size)


def cluster_1d(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Chained clusters of values: a new one where the step to the value before exceeds tolerance."""
    if not keys:
        raise ValueError("clusters of a whole table: clusters_1d")
    step = F.col(value) - F.lag(value).over(within(keys, value))
    return islands(df, keys, value, step > tolerance, "cluster")


def clusters_1d(df: DataFrame, value: str, tolerance: float, width: float) -> DataFrame:
    """Chained clusters of a whole table's values: low, high, members. Null values are left out.

    Values are clustered within stretches of `width` (more than tolerance) in parallel; then only the first and the last cluster of each stretch, which
    may go on in the next, are looked at in order: two rows a stretch.
    """
    banded = df.where(F.col(value).isNotNull()).select(F.col(value), F.floor(F.col(value) / width).alias("_band"))
    step = F.col(value) - F.lag(value).over(within(["_band"], value))
    parts = islands(banded, ["_band"], value, step > tolerance, "cluster").groupBy("_band", "cluster").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("members"))
    outer = (F.col("cluster") == 0) | (F.col("cluster") == F.max("cluster").over(W.partitionBy("_band")))
    parts = parts.withColumn("_outer", outer)
    ends = parts.where("_outer").withColumn("_all", F.lit(0))
    # clusters inside a stretch lie between its ends, so a gap between neighbours here is one in the whole, or wider
    gap = (F.col("low") - F.lag("high").over(within(["_all"], "low")) > tolerance) | ((F.col("cluster") > 0) & (F.lag("_band").over(within(["_all"], "low")) == F.col("_band")))
    chained = islands(ends, ["_all"], "low", gap, "_chain").groupBy("_chain").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("members"))
    return chained.select("low", "high", "members").unionByName(parts.where(~F.col("_outer")).select("low", "high", "members"))


def ladder(value: Column, cuts: list[float]) -> Column:
    """1 plus the number of cuts above the first that the value reaches; 1 below the first too."""
    return F.greatest(F.lit(1), sum((F.coalesce((value >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))).cast("long")


def falling_ladder(value: Column, three: float, two: float) -> Column:
    return F.when(value < three, 3).when(value < two, 2).otherwise(1).cast("long")
