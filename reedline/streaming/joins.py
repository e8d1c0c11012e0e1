"""Interval and as-of joins of two streams. Both sides carry a watermark, so what is kept of either is bounded by the interval and the lateness, and results are final when they come.

Times are timestamps; spans are texts such as '2 hours'. A row that comes later than the watermark (the greatest time seen less `late`, the lower of both sides, as of the step before last) is left out, as Spark's joins do; so a
stream that falls silent holds the other one's results back. The same on tables: operators.joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band(left: DataFrame, right: DataFrame, keys: list[str], time: str, before: str, after: str, late: str, how: str = "inner") -> DataFrame:
    """left rows and right rows of equal keys with -before <= right time - left time <= after.

    how: inner and left give the columns of left, and of right with match_ before them; semi and anti give left rows with or without a match. An unmatched row comes when no match can any more.
    Null keys and times match nothing; those of left rows are told by left and anti.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"how is {how!r}")
    l = left.withWatermark(time, late)
    r = right.withWatermark(time, late)
    r = r.select(*[F.col(c).alias(f"match_{c}") for c in r.columns])
    at, other = F.col(time), F.col(f"match_{time}")
    where = (other >= at - F.expr(f"interval {before}")) & (other <= at + F.expr(f"interval {after}"))
    for k in keys:
        where = where & (F.col(k) == F.col(f"match_{k}"))
    joined = l.join(r, where, {"inner": "inner", "left": "left_outer", "semi": "left_semi", "anti": "left_outer"}[how])
    return joined.where(other.isNull()).select(*left.columns) if how == "anti" else joined


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], tolerance: str, late: str) -> DataFrame:
    """Each left row with the last right row at or before it, at most tolerance before: match_<time> and match_<columns>, null where there is none.

    Where several right rows share that time, the one with the greatest columns counts. Left rows must differ from each other; equal ones are one. A result comes when the watermark has passed
    the left row, and needs no more state than the right rows of the tolerance. A tolerance is needed: without one every right row might still count.
    """
    kept = right.select(*keys, time, *columns)
    pairs = band(left, kept, keys, time, tolerance, "0 seconds", late, "left")
    found = F.max(F.when(F.col(f"match_{time}").isNotNull(), F.struct(f"match_{time}", *[f"match_{c}" for c in columns]))).alias("_hit")
    out = pairs.groupBy(*left.columns).agg(found)
    return out.select(*left.columns, *[F.col(f"_hit.match_{c}").alias(f"match_{c}") for c in (time, *columns)])
