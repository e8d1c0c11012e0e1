"""Joins, grades, aggregates and set operations over the event signal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.functions.grade import amplitude_decibels, decibels
from reedline.operators import joins, quantiles, seq
from reedline.operators.seq import within
from reedline.plans.registry import DAY, EV, HOUR, ROWS, SPAN, query, rows_of, runs_sql, signal, table
from reedline.plans.sequence import silence, sound, zero

U = ["user_id"]
_SOUND, _ERR = runs_sql("r", "value >= 60"), runs_sql("z", "event_type = 'error'")
_TIMED = """rt AS (SELECT r.*, a.t_us AS from_us, b.t_us AS to_us FROM r JOIN ev a ON a.user_id = r.user_id AND a.i = r.start JOIN ev b ON b.user_id = r.user_id AND b.i = r.stop - 1),
 zt AS (SELECT z.*, a.t_us AS from_us, b.t_us AS to_us FROM z JOIN ev a ON a.user_id = z.user_id AND a.i = z.start JOIN ev b ON b.user_id = z.user_id AND b.i = z.stop - 1)"""


def kind(s, name):
    return s.where(F.col("event_type") == name)


def timed(s, mask):
    return seq.runs(s, U, "i", mask, F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us"))


def asof_sql(limit: str) -> str:
    return f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase')
SELECT c.user_id, c.i, coalesce(p.t_us, -1) AS match_t_us, coalesce(p.i, -1) AS match_i FROM ev c ASOF LEFT JOIN p ON p.user_id = c.user_id AND p.t_us <= c.t_us {limit} WHERE c.event_type = 'click'"""


def _matched():
    """-1 where nothing matched."""
    return [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("match_t_us", "match_i")]


@query(asof_sql(""))
def join_asof_backward(spark, sf_dir):
    s = signal(spark, sf_dir)
    return joins.asof_backward(kind(s, "click").select("user_id", "i", "t_us"), kind(s, "purchase"), U, "t_us", ["i"], width=SPAN).select("user_id", "i", *_matched())


@query(f"""SELECT user_id, i, CASE WHEN t_us - match_t_us <= {DAY} THEN match_t_us ELSE -1 END AS match_t_us, CASE WHEN t_us - match_t_us <= {DAY} THEN match_i ELSE -1 END AS match_i
FROM ({asof_sql("").replace("SELECT c.user_id, c.i,", "SELECT c.user_id, c.i, c.t_us,")})""")
def join_asof_tolerance(spark, sf_dir):
    s = signal(spark, sf_dir)
    return joins.asof_backward(kind(s, "click").select("user_id", "i", "t_us"), kind(s, "purchase"), U, "t_us", ["i"], DAY, SPAN).select("user_id", "i", *_matched())


@query(f"""WITH {EV} SELECT user_id, i FROM ev v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = v.user_id AND e.event_type = 'error' AND abs(e.t_us - v.t_us) <= {2 * HOUR})""")
def join_anti_band(spark, sf_dir):
    s = signal(spark, sf_dir)
    return joins.band(kind(s, "view").select("user_id", "i", "t_us"), kind(s, "error").select("user_id", "t_us"), U, "t_us", 2 * HOUR, 2 * HOUR, "anti").select("user_id", "i")


def _overlap_sql(word: str) -> str:
    return f"""WITH {EV}, {_SOUND}, {_ERR}, {_TIMED} SELECT user_id, start, stop FROM rt WHERE {word} EXISTS
 (SELECT 1 FROM zt WHERE zt.user_id = rt.user_id AND zt.from_us < rt.to_us + {HOUR} AND zt.to_us > rt.from_us - {HOUR})"""


def _overlap(spark, sf_dir, how):
    s = signal(spark, sf_dir)
    a, b = F.col("from_us"), F.col("to_us")
    return joins.with_overlap(timed(s, sound()), timed(s, zero()), U, a - HOUR, b + HOUR, a, b, how, SPAN).select("user_id", "start", "stop")


@query(_overlap_sql("NOT"))
def join_anti_overlap(spark, sf_dir):
    return _overlap(spark, sf_dir, "anti")


@query(_overlap_sql(""))
def join_semi_overlap(spark, sf_dir):
    return _overlap(spark, sf_dir, "semi")


@query(f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase') SELECT user_id, i FROM p WHERE EXISTS
 (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.i <> p.i AND abs(q.t_us - p.t_us) <= {2 * DAY} AND abs(q.c - p.c) <= 500)""")
def join_self_twin(spark, sf_dir):
    p = kind(signal(spark, sf_dir), "purchase").select("user_id", "i", "t_us", "c")
    like = (F.col("l.i") != F.col("r.i")) & (F.abs(F.col("l.c") - F.col("r.c")) <= 500)
    return joins.band(p, p, U, "t_us", 2 * DAY, 2 * DAY, "semi", like).select("user_id", "i")


@query(f"""WITH {EV}, p AS (SELECT user_id, i, t_us, lag(t_us) OVER w AS b, lead(t_us) OVER w AS n FROM ev WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, CASE WHEN t_us - b <= {2 * DAY} THEN t_us - b ELSE -1 END AS since_us, CASE WHEN n - t_us <= {2 * DAY} THEN n - t_us ELSE -1 END AS until_us FROM p""")
def join_next_prev(spark, sf_dir):
    p = seq.scan(kind(signal(spark, sf_dir), "purchase"), U, ["i"], rows_of(), back=("previous", F.col("t_us")), ahead=("next", F.col("t_us")))
    p = p.select("user_id", "i", (F.col("t_us") - F.col("back")).alias("b"), (F.col("ahead") - F.col("t_us")).alias("n"))
    return p.select("user_id", "i", F.when(F.col("b") <= 2 * DAY, F.col("b")).otherwise(-1).alias("since_us"), F.when(F.col("n") <= 2 * DAY, F.col("n")).otherwise(-1).alias("until_us"))


@query(f"""WITH {EV}, x AS (SELECT user_id, t_us AS from_us, t_us + {6 * HOUR} AS to_us, c - 2000 AS low, c + 2000 AS high FROM ev WHERE event_type = 'error')
SELECT user_id, i FROM ev e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = e.user_id AND e.t_us >= x.from_us AND e.t_us < x.to_us AND e.c BETWEEN x.low AND x.high)""")
def join_range_2d(spark, sf_dir):
    s = signal(spark, sf_dir)
    inside = F.col("l.c").between(F.col("r.c") - 2000, F.col("r.c") + 2000)
    errors = kind(s, "error").select("user_id", "t_us", "c")
    return joins.band(s.where(~zero()).select("user_id", "i", "t_us", "c"), errors, U, "t_us", 6 * HOUR - 1, 0, "anti", inside).select("user_id", "i")


@query(f"""WITH {EV} SELECT user_id, i, event_type FROM ev e WHERE event_type NOT IN ('view', 'click') OR NOT EXISTS
 (SELECT 1 FROM ev b WHERE b.user_id = e.user_id AND b.value > 320 AND abs(b.i - e.i) <= 2)""")
def join_anti_conditional(spark, sf_dir):
    s = seq.sliding(signal(spark, sf_dir), U, "i", F.max("value"), -2, 2, "top", ROWS)
    return s.where(~F.col("event_type").isin("view", "click") | (F.col("top") <= 320)).select("user_id", "i", "event_type")


@query(f"""WITH {EV}, {_SOUND}, {_ERR}, {_TIMED} SELECT user_id, start, stop FROM zt WHERE NOT EXISTS
 (SELECT 1 FROM rt WHERE rt.user_id = zt.user_id AND rt.from_us < zt.from_us + {HOUR} AND rt.to_us > zt.from_us - {6 * HOUR})""")
def join_anti_asymmetric(spark, sf_dir):
    s = signal(spark, sf_dir)
    a, b = F.col("from_us"), F.col("to_us")
    return joins.with_overlap(timed(s, zero()), timed(s, sound()), U, a - 6 * HOUR, a + HOUR, a, b, "anti", SPAN).select("user_id", "start", "stop")


@query(f"WITH {EV}, {_SOUND} SELECT r.user_id, r.start, count(e.i) AS clicks, greatest(count(e.i), 1) AS inspected FROM r LEFT JOIN ev e ON e.user_id = r.user_id AND e.i >= r.start AND e.i < r.stop AND e.event_type = 'click' GROUP BY 1, 2")
def join_range_count(spark, sf_dir):
    found = seq.runs(signal(spark, sf_dir), U, "i", sound(), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return found.select("user_id", "start", "clicks", F.greatest("clicks", F.lit(1)).cast("long").alias("inspected"))


@query(f"WITH {EV} SELECT user_id, i FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING) AS top FROM ev) WHERE top < 10 * value")
def join_self_mask(spark, sf_dir):
    return seq.sliding_range(signal(spark, sf_dir), U, "t_us", F.max("value"), DAY, DAY, "top", SPAN).where("top < 10 * value").select("user_id", "i")


@query(f"WITH {EV} SELECT user_id, i, CASE WHEN value >= 200 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END AS severity FROM ev")
def grade_ladder(spark, sf_dir):
    return signal(spark, sf_dir).select("user_id", "i", seq.ladder(F.col("value"), [20, 80, 200]).alias("severity"))


@query(f"""WITH {EV}, f AS (SELECT user_id, CAST(floor(t_us / {DAY}.0) AS BIGINT) AS day, min(value) AS floor FROM ev WHERE event_type = 'error' GROUP BY 1, 2)
SELECT e.user_id, e.i, CASE WHEN f.floor IS NULL OR e.value - f.floor >= 30 THEN 3 ELSE 2 END AS severity FROM ev e LEFT JOIN f ON f.user_id = e.user_id AND f.day = CAST(floor(e.t_us / {DAY}.0) AS BIGINT)""")
def grade_case_null_floor(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("day", F.floor(F.col("t_us") / DAY))
    s = s.withColumn("floor", F.min(F.when(zero(), F.col("value"))).over(W.partitionBy("user_id", "day")))
    loud = F.col("floor").isNull() | (F.col("value") - F.col("floor") >= 30)
    return s.select("user_id", "i", F.when(loud, 3).otherwise(2).cast("long").alias("severity"))


@query(f"WITH {EV} SELECT user_id, i, CASE WHEN value < 25 THEN 3 WHEN value < 32 THEN 2 ELSE 1 END AS severity FROM ev")
def grade_gap_ladder(spark, sf_dir):
    return signal(spark, sf_dir).select("user_id", "i", seq.falling_ladder(F.col("value"), 25, 32).alias("severity"))


_DB = "20 * log10(greatest(a, 1e-10))"


@query(f"WITH {EV} SELECT user_id, i, CAST({_DB} >= -31.6 AS BIGINT) + CAST({_DB} >= -26.4 AS BIGINT) + CAST({_DB} >= -22.5 AS BIGINT) AS level FROM ev")
def grade_level_scale(spark, sf_dir):
    db = amplitude_decibels(F.col("a"))
    return signal(spark, sf_dir).select("user_id", "i", sum(((db >= x).cast("long") for x in (-31.6, -26.4, -22.5)), F.lit(0).cast("long")).alias("level"))


@query(f"""WITH {EV}, s AS (SELECT *, least(20, coalesce(i - max(CASE WHEN value >= 60 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20)) AS silence,
 abs(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY i), 0)) >= 100 AS step FROM ev)
SELECT user_id, i, CASE WHEN silence >= 5 AND {_DB} >= -20 THEN 3 WHEN silence >= 2 AND {_DB} >= -30 THEN 2 ELSE 0 END AS click, CASE WHEN {_DB} >= -10 AND step THEN 3 WHEN step OR {_DB} >= -6 THEN 2 ELSE 1 END AS hum FROM s""")
def grade_two_key(spark, sf_dir):
    s = silence(signal(spark, sf_dir)).withColumn("db", amplitude_decibels(F.col("a")))
    s = seq.scan(s, U, ["i"], rows_of(), before=("previous", F.col("value")))
    s = s.withColumn("step", F.abs(F.coalesce(F.col("value") - F.col("before"), F.lit(0.0))) >= 100)
    quiet, db, step = F.col("silence"), F.col("db"), F.col("step")
    click = F.when((quiet >= 5) & (db >= -20), 3).when((quiet >= 2) & (db >= -30), 2).otherwise(0)
    return s.select("user_id", "i", click.cast("long").alias("click"), F.when((db >= -10) & step, 3).when(step | (db >= -6), 2).otherwise(1).cast("long").alias("hum"))


_SEV = "CASE WHEN value >= 200 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END"


def severity():
    return seq.ladder(F.col("value"), [20, 80, 200])


@query(f"WITH {EV} SELECT user_id, i, {_SEV} AS severity FROM ev WHERE {_SEV} >= 2")
def filter_min_sev(spark, sf_dir):
    return signal(spark, sf_dir).select("user_id", "i", severity().alias("severity")).where("severity >= 2")


@query(f"""WITH {EV}, g AS (SELECT user_id, i, coalesce(t_us - lag(t_us) OVER w, -1) AS gap_us, CASE WHEN lag(t_us) OVER w IS NULL THEN 'head' WHEN lead(t_us) OVER w IS NULL THEN 'tail' ELSE 'inner' END AS place FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT * FROM g WHERE place <> 'inner' OR gap_us >= {12 * HOUR}""")
def filter_listed(spark, sf_dir):
    s = seq.scan(signal(spark, sf_dir), U, ["i"], rows_of(), back=("previous", F.col("t_us")), ahead=("next", F.col("t_us")))
    back, ahead = F.col("back"), F.col("ahead")
    g = s.select("user_id", "i", F.coalesce(F.col("t_us") - back, F.lit(-1)).alias("gap_us"), F.when(back.isNull(), "head").when(ahead.isNull(), "tail").otherwise("inner").alias("place"))
    return g.where((F.col("place") != "inner") | (F.col("gap_us") >= 12 * HOUR))


@query(f"""WITH {EV} SELECT user_id, count(*) AS events, {", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase", "signup", "view"))},
 {", ".join(f"count(*) FILTER (WHERE {_SEV} = {k}) AS sev_{k}" for k in (1, 2, 3))} FROM ev GROUP BY 1""")
def agg_counts_pivot(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("severity", severity())
    kinds = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "error", "purchase", "signup", "view")]
    return s.groupBy("user_id").agg(F.count("*").alias("events"), *kinds, *[F.count_if(F.col("severity") == k).alias(f"sev_{k}") for k in (1, 2, 3)])


@query(f"WITH {EV} SELECT event_type, round(10 * log10(avg(pow(10, value / 100))), 6) AS level FROM ev GROUP BY 1")
def agg_powermean(spark, sf_dir):
    return signal(spark, sf_dir).groupBy("event_type").agg(F.round(10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("value") / 100))), 6).alias("level"))


@query(f"""WITH {EV}, d AS (SELECT user_id, event_type, CAST(floor(t_us / {DAY}.0) AS BIGINT) AS day FROM ev), n AS (SELECT user_id, count(DISTINCT day) AS days FROM d GROUP BY 1)
SELECT d.user_id, d.event_type, count(DISTINCT d.day) AS seen, any_value(n.days) AS days FROM d JOIN n ON n.user_id = d.user_id GROUP BY 1, 2 HAVING count(DISTINCT d.day) >= ceil(any_value(n.days) / 2.0)""")
def agg_quorum(spark, sf_dir):
    d = signal(spark, sf_dir).select("user_id", "event_type", F.floor(F.col("t_us") / DAY).alias("day")).distinct()
    days = d.groupBy("user_id").agg(F.countDistinct("day").alias("days"))
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("seen")).join(days, "user_id").where("seen >= ceil(days / 2)")


@query(f"WITH {EV} SELECT event_type, {', '.join(f'round(quantile_cont(value, {p / 100}), 6) AS p{p}' for p in (10, 50, 90))} FROM ev GROUP BY 1")
def agg_percentiles(spark, sf_dir):
    found = quantiles.percentiles(signal(spark, sf_dir), ["event_type"], "value", {f"p{p}": p / 100 for p in (10, 50, 90)})
    return found.select("event_type", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (10, 50, 90)])


@query(f"""WITH {EV} SELECT user_id, min(value) AS low, max(value) AS high, coalesce(min(i) FILTER (WHERE value >= 200), -1) AS first_hit, coalesce(max(i) FILTER (WHERE value >= 200), -1) AS last_hit, max({_SEV}) AS worst, arg_max(i, (value, -i)) AS top_i FROM ev GROUP BY 1""")
def agg_extremes(spark, sf_dir):
    hit = F.when(F.col("value") >= 200, F.col("i"))
    return signal(spark, sf_dir).groupBy("user_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.coalesce(F.min(hit), F.lit(-1)).alias("first_hit"), F.coalesce(F.max(hit), F.lit(-1)).alias("last_hit"), F.max(severity()).alias("worst"), F.max_by("i", F.struct("value", -F.col("i"))).alias("top_i")
    )


@query(f"WITH {EV} SELECT user_id, round(avg(CAST(value >= 60 AS INT)), 6) AS share, round(1 - avg(CAST(value >= 60 AS INT)), 6) AS silent FROM ev GROUP BY 1")
def agg_share(spark, sf_dir):
    loud = F.avg(sound().cast("int"))
    return signal(spark, sf_dir).groupBy("user_id").agg(F.round(loud, 6).alias("share"), F.round(1 - loud, 6).alias("silent"))


@query(f"WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, median(value) FILTER (WHERE i <= 3) AS first3, median(value) FILTER (WHERE i > n - 3) AS last3 FROM n GROUP BY 1")
def agg_list_slices(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    return s.groupBy("user_id").agg(F.percentile(F.when(F.col("i") <= 3, F.col("value")), 0.5).alias("first3"), F.percentile(F.when(F.col("i") > F.col("n") - 3, F.col("value")), 0.5).alias("last3"))


@query(f"""WITH {EV}, d AS (SELECT DISTINCT event_type, c FROM ev), g AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY c) AS k FROM (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY event_type ORDER BY c) > 5 THEN 1 ELSE 0 END AS n FROM d))
SELECT event_type, min(c) AS low, max(c) AS high, count(*) AS members, median(c) AS middle FROM g GROUP BY event_type, k""")
def cluster_1d(spark, sf_dir):
    d = signal(spark, sf_dir).select("event_type", "c").distinct()
    g = seq.cluster_1d(d, ["event_type"], "c", 5)
    return g.groupBy("event_type", "cluster").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"), F.percentile("c", 0.5).alias("middle")).drop("cluster")


@query(f"""WITH {EV}, d AS (SELECT DISTINCT CAST(floor(value / 10) AS BIGINT) AS line, CAST(floor(t_us / {DAY}.0) AS BIGINT) AS day FROM ev WHERE value >= 150),
 g AS (SELECT *, sum(n) OVER (PARTITION BY line ORDER BY day) AS k FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY line ORDER BY day) > 10 THEN 1 ELSE 0 END AS n FROM d))
SELECT line, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY line, k HAVING count(*) >= 2 AND max(day) - min(day) >= 3""")
def hidden_lines(spark, sf_dir):
    d = signal(spark, sf_dir).where("value >= 150").select(F.floor(F.col("value") / 10).alias("line"), F.floor(F.col("t_us") / DAY).alias("day")).distinct()
    g = seq.islands(d, ["line"], "day", F.col("day") - F.lag("day").over(within(["line"], "day")) > 10)
    out = g.groupBy("line", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")
    return out.where("days >= 2 and last_day - first_day >= 3")


@query(f"""WITH {EV}, d AS (SELECT DISTINCT user_id, CAST(floor(t_us / {DAY}.0) AS BIGINT) AS day FROM ev WHERE value >= 60),
 g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS k FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS n FROM d)),
 x AS (SELECT e.user_id, arg_max(CAST(floor(t_us / {DAY}.0) AS BIGINT), (value, -i)) AS seed FROM ev e GROUP BY 1)
SELECT g.user_id, any_value(x.seed) AS seed, min(g.day) AS first_day, max(g.day) AS last_day, count(*) AS days FROM g JOIN x ON x.user_id = g.user_id GROUP BY g.user_id, g.k HAVING any_value(x.seed) BETWEEN min(g.day) AND max(g.day)""")
def cluster_expand(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("day", F.floor(F.col("t_us") / DAY))
    seed = s.groupBy("user_id").agg(F.max_by("day", F.struct("value", -F.col("i"))).alias("seed"))
    d = s.where(sound()).select("user_id", "day").distinct()
    g = seq.islands(d, U, "day", F.col("day") - F.lag("day").over(within(U, "day")) > 2)
    out = g.groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    return out.join(seed, "user_id").where("seed between first_day and last_day").select("user_id", "seed", "first_day", "last_day", "days")


@query(f"WITH {EV} SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY c // 1000, {_SEV} DESC, event_type, i) AS place FROM ev")
def sort_stable(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy(F.expr("c div 1000"), F.desc("severity"), "event_type", "i")
    return signal(spark, sf_dir).withColumn("severity", severity()).select("user_id", "i", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {EV}, {_SOUND}, a AS (SELECT user_id, start AS pos, 'run' AS kind, length AS size FROM r UNION ALL SELECT user_id, i, 'error', c FROM ev WHERE event_type = 'error')
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos, kind, size) AS place FROM a""")
def sort_merge_rows(spark, sf_dir):
    s = signal(spark, sf_dir)
    a = seq.runs(s, U, "i", sound()).select("user_id", F.col("start").alias("pos"), F.lit("run").alias("kind"), F.col("length").alias("size"))
    a = a.unionByName(s.where(zero()).select("user_id", F.col("i").alias("pos"), F.lit("error").alias("kind"), F.col("c").alias("size")))
    return a.withColumn("place", F.row_number().over(within(U, ["pos", "kind", "size"])).cast("long"))


@query(f"""WITH {EV}, {_SOUND}, n AS (SELECT *, least(row_number() OVER (PARTITION BY user_id ORDER BY start), 5) AS part FROM r)
SELECT user_id, part, min(start) AS start, max(stop) AS stop, CAST(sum(length) AS BIGINT) AS length FROM n GROUP BY 1, 2""")
def limit_caps(spark, sf_dir):
    r = seq.runs(signal(spark, sf_dir), U, "i", sound())
    r = r.withColumn("part", F.least(F.row_number().over(within(U, "start")), F.lit(5)).cast("long"))
    return r.groupBy("user_id", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"))


@query(f"""WITH {EV}, d AS (SELECT min(CAST(floor(t_us / {DAY}.0) AS BIGINT)) AS day FROM ev)
SELECT u.user_id, k.event_type FROM (SELECT DISTINCT user_id FROM ev) u, (SELECT DISTINCT event_type FROM ev) k
EXCEPT SELECT user_id, event_type FROM ev, d WHERE CAST(floor(t_us / {DAY}.0) AS BIGINT) = d.day""")
def setop_difference(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("day", F.floor(F.col("t_us") / DAY))
    kinds = s.agg(F.collect_set("event_type").alias("kinds"), F.min("day").alias("first_day"))  # one row
    users = s.select("user_id").distinct().join(F.broadcast(kinds))
    expected = users.select("user_id", F.explode("kinds").alias("event_type"))
    present = s.join(F.broadcast(kinds), F.col("day") == F.col("first_day")).select("user_id", "event_type")
    return expected.subtract(present)


@query("""WITH u AS (SELECT CAST(round(p_retailprice) AS BIGINT) AS v FROM part UNION SELECT CAST(round(value) AS BIGINT) FROM events),
 g AS (SELECT v, CASE WHEN v - lag(v) OVER (ORDER BY v) > 2 THEN 1 ELSE 0 END AS n FROM u), k AS (SELECT *, sum(n) OVER (ORDER BY v) AS c FROM g)
SELECT min(v) // 1000 AS band, min(v) AS low, max(v) AS high, count(*) AS members FROM k GROUP BY c""")
def setop_union_merge(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.round("p_retailprice").cast("long").alias("v"))
    b = table(spark, sf_dir, "events").select(F.round("value").cast("long").alias("v"))
    found = seq.clusters_1d(a.union(b).distinct(), "v", 2, 1000)
    return found.select(F.expr("low div 1000").alias("band"), "low", "high", "members")


@query(f"WITH {EV} SELECT user_id, i, CASE WHEN value > 320 THEN 0 ELSE value END AS value, value > 320 AS invalid FROM ev")
def scalar_mask_invalid(spark, sf_dir):
    bad = F.col("value") > 320
    return signal(spark, sf_dir).select("user_id", "i", F.when(bad, 0.0).otherwise(F.col("value")).alias("value"), bad.alias("invalid"))


@query(f"WITH {EV} SELECT user_id, i, round(10 * log10(greatest(a * a, 1e-20)), 6) AS power_db, round({_DB}, 6) AS amplitude_db FROM ev")
def scalar_db(spark, sf_dir):
    return signal(spark, sf_dir).select("user_id", "i", F.round(decibels(F.col("a") * F.col("a")), 6).alias("power_db"), F.round(amplitude_decibels(F.col("a")), 6).alias("amplitude_db"))


@query(f"""WITH {EV}, m AS (SELECT user_id, i, (t_us - {DAY} * CAST(floor(t_us / {DAY}.0) AS BIGINT)) // 1000 AS ms FROM ev)
SELECT user_id, i, (ms // 3600000) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS clock FROM m""")
def scalar_clock(spark, sf_dir):
    ms = F.expr(f"(t_us - {DAY} * floor(t_us / {DAY})) div 1000")
    s = signal(spark, sf_dir).withColumn("ms", ms)
    return s.select("user_id", "i", F.format_string("%d:%02d:%02d.%03d", F.expr("ms div 3600000"), F.expr("ms div 60000 % 60"), F.expr("ms div 1000 % 60"), F.expr("ms % 1000")).alias("clock"))


@query(f"WITH {EV}, n AS (SELECT user_id, i, value, round_even(value / 12.3, 0) AS n FROM ev) SELECT user_id, i, n >= 2 AND abs(value - n * 12.3) <= greatest(0.5, 0.02 * n) AS multiple FROM n")
def pred_multiple(spark, sf_dir):
    n = F.bround(F.col("value") / 12.3)
    return signal(spark, sf_dir).select("user_id", "i", ((n >= 2) & (F.abs(F.col("value") - n * 12.3) <= F.greatest(F.lit(0.5), 0.02 * n))).alias("multiple"))


@query(f"""WITH {EV}, {_SOUND}, {_ERR}, {_TIMED} SELECT rt.user_id, rt.start, zt.start AS z_start, zt.from_us >= rt.from_us - {HOUR} AND zt.to_us <= rt.to_us + {HOUR} AS within,
 2 * (least(zt.to_us, rt.to_us + {HOUR}) - greatest(zt.from_us, rt.from_us - {HOUR})) >= zt.to_us - zt.from_us AS mostly FROM rt JOIN zt ON zt.user_id = rt.user_id AND zt.from_us < rt.to_us + {HOUR} AND zt.to_us > rt.from_us - {HOUR}""")
def pred_interval(spark, sf_dir):
    s = signal(spark, sf_dir)
    a, b = F.col("l.from_us") - HOUR, F.col("l.to_us") + HOUR
    x, y = F.col("r.from_us"), F.col("r.to_us")
    # spans without length are given one microsecond to meet by, so the exact condition follows
    here, there = (F.col("from_us") - HOUR, F.col("to_us") + HOUR), (F.col("from_us"), F.col("to_us") + 1)
    hits = joins.overlapping_pairs(timed(s, sound()), timed(s, zero()), U, here, there, DAY).where((x < b) & (y > a))
    return hits.select(F.col("l.user_id"), F.col("l.start"), F.col("r.start").alias("z_start"), ((x >= a) & (y <= b)).alias("within"), (2 * (F.least(y, b) - F.greatest(x, a)) >= y - x).alias("mostly"))


@query(f"WITH {EV} SELECT user_id, i, round(CASE WHEN value * 20 < 1000 THEN value * 20 / (200.0 / 3) ELSE 15 + ln(value * 20 / 1000) / (ln(6.4) / 27) END, 6) AS mel FROM ev")
def scalar_mel(spark, sf_dir):
    hz = F.col("value") * 20
    mel = F.when(hz < 1000, hz / (200.0 / 3)).otherwise(15 + F.log(hz / 1000) / (F.log(F.lit(6.4)) / 27))
    return signal(spark, sf_dir).select("user_id", "i", F.round(mel, 6).alias("mel"))


@query(f"WITH {EV} SELECT user_id, i, event_type, CASE WHEN value < 20 THEN '' ELSE CAST({_SEV} AS VARCHAR) END AS severity FROM ev")
def report_row(spark, sf_dir):
    return signal(spark, sf_dir).select("user_id", "i", "event_type", F.when(F.col("value") < 20, "").otherwise(severity().cast("string")).alias("severity"))


@query(f"WITH {EV} SELECT user_id, {' || '.join(f'count(*) FILTER (WHERE {_SEV} = {k}) || {chr(39)} x sev {k}{chr(39)}' + (f' || {chr(39)}, {chr(39)}' if k > 1 else '') for k in (3, 2, 1))} AS tally FROM ev GROUP BY 1")
def report_tally(spark, sf_dir):
    n = [F.count_if(F.col("severity") == k) for k in (3, 2, 1)]
    return signal(spark, sf_dir).withColumn("severity", severity()).groupBy("user_id").agg(F.format_string("%d x sev 3, %d x sev 2, %d x sev 1", *n).alias("tally"))


@query(f"""WITH {EV} SELECT user_id, i, CASE event_type WHEN 'error' THEN 'cents=' || c || '; at=' || i WHEN 'purchase' THEN 'cents=' || c ELSE 'cents=' || c || '; at=' || i || '; kind=' || event_type END AS measures FROM ev""")
def report_measures(spark, sf_dir):
    cents, at, what = F.concat(F.lit("cents="), F.col("c")), F.concat(F.lit("at="), F.col("i")), F.concat(F.lit("kind="), F.col("event_type"))
    text = F.when(zero(), F.concat_ws("; ", cents, at)).when(F.col("event_type") == "purchase", cents).otherwise(F.concat_ws("; ", cents, at, what))
    return signal(spark, sf_dir).select("user_id", "i", text.alias("measures"))


@query(f"WITH {EV} SELECT user_id, count(*) AS issues, string_agg(i || ':' || event_type, ' ' ORDER BY i) AS listing FROM ev WHERE {_SEV} >= 2 GROUP BY 1")
def report_issues(spark, sf_dir):
    s = signal(spark, sf_dir).where(severity() >= 2)
    rows = F.sort_array(F.collect_list(F.struct("i", "event_type")))
    return s.groupBy("user_id").agg(F.count("*").alias("issues"), F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["i"].cast("string"), r["event_type"])), " ").alias("listing"))


@query(f"WITH {EV} SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, max({_SEV}) AS worst, round(max(value), 2) AS top FROM ev GROUP BY 1")
def report_summary(spark, sf_dir):
    s = signal(spark, sf_dir)
    return s.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(zero()).alias("errors"), F.max(severity()).alias("worst"), F.round(F.max("value"), 2).alias("top"))


@query("SELECT d.source, count(*) AS files, count(l.doc_id) AS labelled, coalesce(CAST(sum(l.quality) AS BIGINT), 0) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def report_assemble(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return d.join(l.withColumn("seen", F.lit(1)), "doc_id", "left").groupBy("source").agg(F.count("*").alias("files"), F.count("seen").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


@query()
def report_json(spark, sf_dir):
    """JSON lines of at most 1000 findings, so that no row grows with a user."""
    s = signal(spark, sf_dir).withColumn("severity", severity()).withColumn("chunk", F.floor((F.col("i") - 1) / 1000))
    rows = F.sort_array(F.collect_list(F.struct("i", "event_type", "c", "severity")))
    return s.groupBy("user_id", "chunk").agg(F.to_json(F.struct(F.count("*").alias("events"), rows.alias("findings"))).alias("report"))


@query(f"""WITH {EV}, s(name, head_us, tolerance_us) AS (VALUES ('short', {6 * HOUR}, {HOUR}), ('long', {DAY}, {2 * HOUR})), g AS (SELECT user_id, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY i) AS gap_us FROM ev)
SELECT name, count(*) FILTER (WHERE abs(gap_us - head_us) <= tolerance_us) AS matching, count(gap_us) AS pauses FROM g, s GROUP BY 1""")
def rule_sets(spark, sf_dir):
    from reedline.plans.sequence import gaps

    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("head_us"), F.lit(t).alias("tolerance_us")) for n, h, t in (("short", 6 * HOUR, HOUR), ("long", DAY, 2 * HOUR))])
    g = gaps(spark, sf_dir).select("gap_us", F.inline(rules))
    return g.groupBy("name").agg(F.count_if(F.abs(F.col("gap_us") - F.col("head_us")) <= F.col("tolerance_us")).alias("matching"), F.count("gap_us").alias("pauses"))


@query("""SELECT doc_id, n_chars >= 200 AS breath, lang <> 'fr' AS dropout, n_chars >= 400 AND lang <> 'de' AS plosive, n_chars >= 100 AS ticks,
 CASE WHEN n_chars < 100 THEN 'skipped' WHEN n_chars < 400 OR lang IN ('fr', 'de') THEN 'partly' ELSE 'all' END AS checked FROM documents""")
def file_gates(spark, sf_dir):
    n, lang = F.col("n_chars"), F.col("lang")
    checked = F.when(n < 100, "skipped").when((n < 400) | lang.isin("fr", "de"), "partly").otherwise("all")
    return table(spark, sf_dir, "documents").select("doc_id", (n >= 200).alias("breath"), (lang != "fr").alias("dropout"), ((n >= 400) & (lang != "de")).alias("plosive"), (n >= 100).alias("ticks"), checked.alias("checked"))
