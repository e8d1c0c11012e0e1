"""Queries by name, each with the SQL of the same result where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.operators import seq
from reedline.operators.seq import micros

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000
DAY = 24 * HOUR
#: A stretch of one user's time, and of one user's rows, that a task looks at: what comes before it is carried in as one row.
SPAN = 30 * DAY
ROWS = 1 << 16

#: The signal that the event table is read as: one sequence a user, in time order; errors are digital zeros, 60 or more is sound.
EV = """ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t_us, CAST(round(value * 100) AS BIGINT) AS c, value / 500.0 AS a,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        micros("ts").alias("t_us"),
        F.round(F.col("value") * 100).cast("long").alias("c"),
        (F.col("value") / 500.0).alias("a"),
    )
    return seq.numbered(events, ["user_id"], ["t_us", "event_id"], F.floor(F.col("t_us") / SPAN))


def rows_of(order: str = "i"):
    """The stretch of rows that a number lies in."""
    return F.floor(F.col(order) / ROWS)


def runs_sql(name: str, mask: str, source: str = "ev") -> str:
    return f"""{name} AS (SELECT user_id, min(i) AS start, max(i) + 1 AS stop, count(*) AS length FROM
 (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM {source} WHERE {mask}) GROUP BY user_id, g)"""


def merge_sql(name: str, source: str, gap: int, least: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT user_id, min(start) AS start, max(stop) AS stop, max(stop) - min(start) AS length FROM
 (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start) AS g FROM (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY user_id ORDER BY start) > {gap} THEN 1 ELSE 0 END AS n FROM {source}))
 GROUP BY user_id, g) WHERE length >= {least})"""
