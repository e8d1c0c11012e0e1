"""Framing, runs, windows, peaks and gaps over the event signal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.functions.grade import pause_guess
from reedline.operators import quantiles, seq
from reedline.operators.seq import within
from reedline.plans.registry import DAY, EV, HOUR, ROWS, SPAN, merge_sql, query, rows_of, runs_sql, signal

U = ["user_id"]
def sound():
    return F.col("value") >= 60


def zero():
    return F.col("event_type") == "error"


RUN = ("user_id", "start", "stop", "length")

_GUESS = f"""CASE WHEN gap_us BETWEEN {22 * HOUR} AND {26 * HOUR} THEN 'section' WHEN gap_us > {26 * HOUR} THEN 'longer'
 WHEN gap_us > {12 * HOUR} THEN 'between' WHEN gap_us >= {6 * HOUR} THEN 'paragraph' ELSE 'shorter' END"""
_GAPS = f"{EV}, g AS (SELECT user_id, i, t_us, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY i) AS gap_us FROM ev)"


def gaps(spark, sf_dir):
    s = signal(spark, sf_dir)
    return seq.scan(s, U, ["i"], rows_of(), before=("previous", F.col("t_us"))).withColumn("gap_us", F.col("t_us") - F.col("before")).where("gap_us is not null")


@query(f"WITH {_GAPS} SELECT {_GUESS} AS guess, count(*) AS pauses FROM g WHERE gap_us IS NOT NULL GROUP BY 1")
def seq_pause_map(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy(pause_guess(F.col("gap_us")).alias("guess")).agg(F.count("*").alias("pauses"))


@query(f"""WITH {_GAPS}, h AS (SELECT *, {_GUESS} AS guess FROM g WHERE gap_us IS NOT NULL)
SELECT user_id, i, t_us - gap_us AS start_us, gap_us, CASE WHEN guess = 'section' AND NOT coalesce(max(CAST(guess = 'section' AS INT)) OVER
 (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'heading' ELSE guess END AS guess FROM h""")
def seq_pause_rows(spark, sf_dir):
    found = gaps(spark, sf_dir).withColumn("guess", pause_guess(F.col("gap_us")))
    found = seq.scan(found, U, ["i"], rows_of(), sections=("sum", (F.col("guess") == "section").cast("long")))
    heading = (F.col("guess") == "section") & (F.col("sections") == 1)
    return found.select("user_id", "i", (F.col("t_us") - F.col("gap_us")).alias("start_us"), "gap_us", F.when(heading, "heading").otherwise(F.col("guess")).alias("guess"))


@query(f"""WITH {EV}, b AS (SELECT user_id, min(t_us) AS first_us, max(t_us) AS last_us FROM ev GROUP BY 1), w AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM ev)
SELECT user_id, first_us - lo AS head_us, hi - last_us AS tail_us,
 CASE WHEN abs(first_us - lo - {DAY}) <= {6 * HOUR} THEN 'as expected' WHEN first_us - lo > {DAY} THEN 'longer' ELSE 'shorter' END AS head_note,
 CASE WHEN abs(hi - last_us - {DAY}) <= {6 * HOUR} THEN 'as expected' WHEN hi - last_us > {DAY} THEN 'longer' ELSE 'shorter' END AS tail_note FROM b, w""")
def seq_head_tail(spark, sf_dir):
    s = signal(spark, sf_dir)
    whole = s.agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    ends = s.groupBy("user_id").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")).join(F.broadcast(whole))  # one row
    head, tail = F.col("first_us") - F.col("lo"), F.col("hi") - F.col("last_us")

    def note(x):
        return F.when(F.abs(x - DAY) <= 6 * HOUR, "as expected").when(x > DAY, "longer").otherwise("shorter")

    return ends.select("user_id", head.alias("head_us"), tail.alias("tail_us"), note(head).alias("head_note"), note(tail).alias("tail_note"))


@query(f"WITH {EV}, {runs_sql('r', 'value >= 60')} SELECT * FROM r")
def seq_runs(spark, sf_dir):
    return seq.runs(signal(spark, sf_dir), U, "i", sound(), chunk=ROWS)


@query(f"WITH {EV}, {runs_sql('r', chr(39).join(['event_type = ', 'error', '']))} SELECT * FROM r")
def seq_zero_runs(spark, sf_dir):
    return seq.runs(signal(spark, sf_dir), U, "i", zero(), chunk=ROWS)


@query(f"WITH {EV}, {runs_sql('r', 'value >= 60')}, {merge_sql('m', 'r', 2, 3)} SELECT * FROM m")
def seq_merge_runs(spark, sf_dir):
    return seq.merge_runs(seq.runs(signal(spark, sf_dir), U, "i", sound(), chunk=ROWS), U, 2, 3, ROWS).select(*RUN)


@query(f"WITH {EV}, {runs_sql('r', 'value >= 60')}, {merge_sql('m', '(SELECT * FROM r WHERE length > 1)', 0, 1)} SELECT * FROM m")
def seq_erode_runs(spark, sf_dir):
    return seq.merge_runs(seq.runs(signal(spark, sf_dir), U, "i", sound(), chunk=ROWS).where("length > 1"), U, 0, width=ROWS).select(*RUN)


_ERR = runs_sql("z", "event_type = 'error'")


@query(f"""WITH {EV}, {_ERR} SELECT z.user_id, z.start, z.length, p.value AS before, n.value AS after FROM z
 JOIN ev p ON p.user_id = z.user_id AND p.i = z.start - 1 JOIN ev n ON n.user_id = z.user_id AND n.i = z.stop WHERE z.length <= 2 AND p.value >= 40 AND n.value >= 40""")
def seq_dropouts(spark, sf_dir):
    s = signal(spark, sf_dir)
    w = within(U, "i")
    s = s.withColumn("before", F.lag("value").over(w)).withColumn("after", F.lead("value").over(w))
    found = seq.runs(s, U, "i", zero(), F.min_by("before", "i").alias("before"), F.max_by("after", "i").alias("after"))
    return found.where("length <= 2 and before >= 40 and after >= 40").select("user_id", "start", "length", "before", "after")


@query(f"WITH {EV}, {_ERR} SELECT user_id, start, length FROM z WHERE length >= 2 AND start > 1")
def seq_clip_ends(spark, sf_dir):
    return seq.runs(signal(spark, sf_dir), U, "i", zero(), chunk=ROWS).where("length >= 2 and start > 1").select("user_id", "start", "length")


@query(f"WITH {EV} SELECT user_id, CAST(floor(t_us / {DAY}.0) AS BIGINT) AS day, CAST(sum(c * c) AS BIGINT) AS energy FROM ev GROUP BY 1, 2")
def seq_bins(spark, sf_dir):
    return signal(spark, sf_dir).groupBy("user_id", F.floor(F.col("t_us") / DAY).alias("day")).agg(F.sum(F.col("c") * F.col("c")).alias("energy"))


_ENV = """e AS (SELECT *, last_value(w IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS env FROM
 (SELECT *, CASE WHEN count(*) OVER f = 5 THEN avg(value * value) OVER f END AS w FROM ev WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)))"""


@query(f"WITH {EV}, {_ENV} SELECT user_id, i, round(env, 6) AS env FROM e")
def seq_envelope(spark, sf_dir):
    return seq.envelope(signal(spark, sf_dir), U, "i", F.col("value") * F.col("value"), 5, chunk=ROWS).select("user_id", "i", F.round("env", 6).alias("env"))


@query(f"WITH {EV} SELECT user_id, i, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM ev) WHERE value = top AND value >= 150")
def seq_peaks(spark, sf_dir):
    return peaks(signal(spark, sf_dir)).select("user_id", "i", "value")


def peaks(s):
    return seq.sliding(s, U, "i", F.max("value"), -5, 5, "top", ROWS).where("value = top and value >= 150")


@query(f"""WITH {EV} SELECT user_id, i, round(value - greatest(coalesce(l, r), coalesce(r, l)), 6) AS rise FROM (SELECT *,
 max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS l,
 max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 FOLLOWING AND 8 FOLLOWING) AS r FROM ev)""")
def seq_rise_guard(spark, sf_dir):
    s = seq.sliding(signal(spark, sf_dir), U, "i", F.max("value"), -8, -3, "l", ROWS)
    s = seq.sliding(s, U, "i", F.max("value"), 3, 8, "r", ROWS)
    return s.select("user_id", "i", F.round(F.col("value") - F.greatest("l", "r"), 6).alias("rise"))


_N = "count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS v1, last_value(value) OVER w AS vn"
_WHOLE = "WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"""WITH {EV} SELECT user_id, i, round((coalesce(lag(value) OVER w, value) + value + coalesce(lead(value) OVER w, value)) / 3, 6) AS smooth
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def seq_smooth3_edge(spark, sf_dir):
    return seq.edge_mean(signal(spark, sf_dir), U, "i", "value", -1, 1, "m").select("user_id", "i", F.round("m", 6).alias("smooth"))


@query(f"""WITH {EV}, x AS (SELECT *, {_N}, min(value) OVER f AS low, sum(value) OVER f AS s FROM ev
 WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT user_id, i, round(least(low * 1.5, (s + greatest(0, 12 - (i - 1)) * v1 + greatest(0, 11 - (n - i)) * vn) / 24), 6) AS floor FROM x""")
def seq_min_floor(spark, sf_dir):
    s = seq.sliding(signal(spark, sf_dir), U, "i", F.min("value"), -12, 11, "low", ROWS)
    s = seq.edge_mean(s, U, "i", "value", -12, 11, "mean")
    return s.select("user_id", "i", F.round(F.least(F.col("low") * 1.5, "mean"), 6).alias("floor"))


_THR = """p AS (SELECT user_id, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM ev GROUP BY 1),
 th AS (SELECT user_id, p10, least(greatest(p10 + 8, p90 - 45), p90 - 10) AS threshold FROM p)"""


def threshold(s):
    cut = quantiles.percentiles(s, U, "value", {"p10": 0.1, "p90": 0.9})
    return cut.select("user_id", "p10", F.least(F.greatest(F.col("p10") + 8, F.col("p90") - 45), F.col("p90") - 10).alias("threshold"))


@query(f"""WITH {EV}, {_THR} SELECT e.user_id, round(any_value(p10), 6) AS p10, round(any_value(threshold), 6) AS threshold,
 round(avg(CAST(value >= threshold AS INT)), 6) AS share FROM ev e JOIN th USING (user_id) GROUP BY 1""")
def seq_percentile_threshold(spark, sf_dir):
    s = signal(spark, sf_dir)
    both = s.join(threshold(s), "user_id").groupBy("user_id", "p10", "threshold").agg(F.avg((F.col("value") >= F.col("threshold")).cast("int")).alias("share"))
    return both.select("user_id", *[F.round(c, 6).alias(c) for c in ("p10", "threshold", "share")])


@query(f"""WITH {EV}, m AS (SELECT *, median(value) OVER f AS near, count(*) OVER f AS n, median(value) OVER (PARTITION BY user_id) AS whole FROM ev
 WINDOW f AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING))
SELECT user_id, i, round(CASE WHEN n >= 3 THEN near ELSE whole END, 6) AS level FROM m""")
def seq_local_median(spark, sf_dir):
    s = signal(spark, sf_dir).select("user_id", "i", "t_us", "value")
    whole = quantiles.percentiles(s, U, "value", {"whole": 0.5})
    s = seq.sliding_range(s, U, "t_us", F.collect_list("value"), DAY, DAY, "values", SPAN).withColumn("values", F.sort_array("values"))  # of two days
    n = F.size("values")
    near = (F.element_at("values", F.floor((n + 1) / 2).cast("int")) + F.element_at("values", F.ceil((n + 1) / 2).cast("int"))) / 2
    s = s.select("user_id", "i", n.alias("n"), near.alias("near")).join(whole, "user_id")
    return s.select("user_id", "i", F.round(F.when(F.col("n") >= 3, F.col("near")).otherwise(F.col("whole")), 6).alias("level"))


@query(f"""WITH {EV}, d AS (SELECT user_id, i, round(lead(value, 3) OVER (PARTITION BY user_id ORDER BY i) - value, 6) AS step FROM ev)
SELECT user_id, max(step) AS rise, min(step) AS drop, coalesce(min(CASE WHEN abs(step) >= 100 THEN i END), -1) AS first_hit FROM d GROUP BY 1""")
def seq_step_edges(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("step", F.round(F.lead("value", 3).over(within(U, "i")) - F.col("value"), 6))
    return s.groupBy("user_id").agg(F.max("step").alias("rise"), F.min("step").alias("drop"), F.coalesce(F.min(F.when(F.abs("step") >= 100, F.col("i"))), F.lit(-1)).alias("first_hit"))


@query(f"""WITH {EV} SELECT user_id, i, least(20, coalesce(i - max(CASE WHEN value >= 60 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20)) AS silence FROM ev""")
def seq_silence_before(spark, sf_dir):
    return silence(signal(spark, sf_dir)).select("user_id", "i", "silence")


def silence(s):
    s = seq.scan(s, U, ["i"], rows_of(), heard=("max", F.when(sound(), F.col("i"))))
    s = seq.scan(s, U, ["i"], rows_of(), last=("previous", F.col("heard")))
    return s.withColumn("silence", F.least(F.lit(20), F.coalesce(F.col("i") - F.col("last"), F.lit(20))).cast("long"))


@query(f"""WITH {EV} SELECT p.user_id, p.i, count(c.i) AS confirmed FROM ev p LEFT JOIN ev c ON c.user_id = p.user_id AND c.event_type = 'click'
 AND c.t_us > p.t_us AND c.t_us <= p.t_us + {HOUR} WHERE p.event_type = 'purchase' GROUP BY 1, 2""")
def seq_confirmed(spark, sf_dir):
    s = seq.sliding_range(signal(spark, sf_dir), U, "t_us", F.sum((F.col("event_type") == "click").cast("long")), -1, HOUR, "clicks", SPAN)
    s = s.withColumn("confirmed", F.coalesce("clicks", F.lit(0)).cast("long"))
    return s.where("event_type = 'purchase'").select("user_id", "i", "confirmed")


@query(f"""WITH {EV}, g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS island FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY i) > {6 * HOUR} THEN 1 ELSE 0 END AS n FROM ev))
SELECT user_id, min(i) AS start, count(*) AS length, max(value) AS top, arg_max(i, (value, -i)) AS top_i FROM g GROUP BY user_id, island""")
def seq_burst_argmax(spark, sf_dir):
    s = signal(spark, sf_dir)
    s = seq.islands_after(s, U, ["i"], rows_of(), F.col("t_us"), lambda before: F.col("t_us") - before > 6 * HOUR)
    return s.groupBy("user_id", "island").agg(
        F.min("i").alias("start"), F.count("*").alias("length"), F.max("value").alias("top"), F.max_by("i", F.struct("value", -F.col("i"))).alias("top_i")
    ).drop("island")


@query(f"""WITH {EV}, v AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS pi FROM ev WHERE value > 320),
 g AS (SELECT user_id, i, sum(CASE WHEN i - pi > 20 OR pi IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS k FROM v)
SELECT user_id, least(k, 5) AS stretch, min(i) AS start, max(i) AS last, count(*) AS samples FROM g GROUP BY 1, 2""")
def seq_invalid_stretches(spark, sf_dir):
    s = signal(spark, sf_dir).where("value > 320")
    s = seq.islands_after(s, U, ["i"], rows_of(), F.col("i"), lambda before: before.isNull() | (F.col("i") - before > 20))
    return s.groupBy("user_id", F.least("island", F.lit(5)).cast("long").alias("stretch")).agg(F.min("i").alias("start"), F.max("i").alias("last"), F.count("*").alias("samples"))


@query(f"WITH {EV}, b AS (SELECT user_id, (i - 1) // 4 AS block, avg(a * a) AS m, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, block, round(10 * log10(greatest(m, 1e-20)), 6) AS db FROM b WHERE n = 4")
def seq_block_db(spark, sf_dir):
    b = signal(spark, sf_dir).groupBy("user_id", F.floor((F.col("i") - 1) / 4).alias("block")).agg(F.avg(F.col("a") * F.col("a")).alias("m"), F.count("*").alias("n"))
    return b.where("n = 4").select("user_id", "block", F.round(10 * F.log10(F.greatest("m", F.lit(1e-20))), 6).alias("db"))


@query(f"WITH {EV} SELECT user_id, i FROM (SELECT *, max(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM ev) WHERE x = 0")
def seq_mask_spans(spark, sf_dir):
    return seq.sliding(signal(spark, sf_dir), U, "i", F.max(zero().cast("int")), -1, 1, "x", ROWS).where("x = 0").select("user_id", "i")


@query(f"""WITH {EV}, {_ENV}, {runs_sql('q', 'env <= 2500', 'e')}, n AS (SELECT user_id, max(i) AS n FROM ev GROUP BY 1)
SELECT user_id, start, least(stop + 4, n + 1) AS stop FROM q JOIN n USING (user_id) WHERE length >= 3""")
def seq_quiet_runs(spark, sf_dir):
    s = seq.envelope(signal(spark, sf_dir), U, "i", F.col("value") * F.col("value"), 5)
    s = s.withColumn("n", F.max("i").over(W.partitionBy("user_id")))
    found = seq.runs(s, U, "i", F.col("env") <= 2500, F.max("n").alias("n"))
    return found.where("length >= 3").select("user_id", "start", F.least(F.col("stop") + 4, F.col("n") + 1).alias("stop"))


@query(f"""WITH {EV}, t AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)) AS high, max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM ev)
, x AS (SELECT *, max(CASE WHEN value < 0.3 * top THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l,
 min(CASE WHEN value < 0.3 * top THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r,
 max(high) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS word FROM t)
SELECT user_id, i, value, r - l AS width, round(word, 6) AS word FROM x WHERE value = top AND value >= 150 AND l IS NOT NULL AND r IS NOT NULL AND word >= 20""")
def seq_pop_rule(spark, sf_dir):
    s = signal(spark, sf_dir)
    s = s.withColumn("high", F.abs(F.col("value") - F.lag("value").over(within(U, "i"))))
    s = seq.sliding(s, U, "i", F.max("value"), -5, 5, "top", ROWS)
    low = F.when(F.col("value") < 0.3 * F.col("top"), F.col("i"))
    s = seq.sliding(s, U, "i", F.max(low), -4, -1, "l", ROWS)
    s = seq.sliding(s, U, "i", F.min(low), 1, 4, "r", ROWS)
    s = seq.sliding(s, U, "i", F.max("high"), 2, 6, "word", ROWS)
    found = s.where("value = top and value >= 150 and l is not null and r is not null and word >= 20")
    return found.select("user_id", "i", "value", (F.col("r") - F.col("l")).alias("width"), F.round("word", 6).alias("word"))


@query(f"""WITH {EV} SELECT user_id, i, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS l,
 max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS r,
 greatest(coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY i), 0), coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY i), 0)) AS side FROM ev)
 WHERE value >= 3 * greatest(coalesce(l, r), coalesce(r, l)) AND side < value / 2""")
def seq_isolated_spike(spark, sf_dir):
    s = seq.sliding(signal(spark, sf_dir), U, "i", F.max("value"), -6, -2, "l", ROWS)
    s = seq.sliding(s, U, "i", F.max("value"), 2, 6, "r", ROWS)
    w = within(U, "i")
    side = F.greatest(F.coalesce(F.lag("value").over(w), F.lit(0.0)), F.coalesce(F.lead("value").over(w), F.lit(0.0)))
    s = s.withColumn("side", side)
    return s.where((F.col("value") >= 3 * F.greatest("l", "r")) & (F.col("side") < F.col("value") / 2)).select("user_id", "i", "value")


@query(f"""WITH {EV}, {runs_sql('r', 'value >= 60')}, {merge_sql('m', 'r', 1, 1)}, {_ERR}
SELECT m.user_id, m.start, m.stop, min(z.start) AS hole FROM m JOIN z ON z.user_id = m.user_id AND z.start - m.stop BETWEEN 0 AND 2 GROUP BY 1, 2, 3""")
def seq_merge_dips(spark, sf_dir):
    s = signal(spark, sf_dir)
    m = seq.merge_runs(seq.runs(s, U, "i", sound(), chunk=ROWS), U, 1, width=ROWS)
    z = seq.runs(s, U, "i", zero(), chunk=ROWS).select("user_id", F.col("start").alias("hole"))
    near = z.withColumn("stop", F.explode(F.array(F.col("hole"), F.col("hole") - 1, F.col("hole") - 2)))
    return m.join(near, ["user_id", "stop"]).groupBy("user_id", "start", "stop").agg(F.min("hole").alias("hole"))


@query(f"""WITH {EV}, k AS (SELECT e.user_id, e.i, n.i AS j, n.value FROM ev e JOIN ev n ON n.user_id = e.user_id AND n.i BETWEEN e.i - 2 AND e.i + 1 WHERE e.event_type = 'error')
SELECT user_id, i, arg_max(j, (value, -j)) AS sharpest, max(value) AS top FROM k GROUP BY 1, 2""")
def seq_sharpest_near(spark, sf_dir):
    frame = within(U, "i").rowsBetween(-2, 1)
    s = signal(spark, sf_dir).withColumn("best", F.max(F.struct("value", (-F.col("i")).alias("less"))).over(frame))
    return s.where(zero()).select("user_id", "i", (-F.col("best.less")).alias("sharpest"), F.col("best.value").alias("top"))


@query(f"""WITH {EV}, w AS (SELECT user_id, i, value, k FROM ev, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((i - 30) / 20.0) AS BIGINT)), (i - 1) // 20 + 1)) AS k)),
 x AS (SELECT user_id, k, i, value, max(value) OVER (PARTITION BY user_id, k) AS top FROM w)
SELECT user_id, i, k, round(value / top, 6) AS scaled FROM x WHERE i - 1 - k * 20 BETWEEN 5 AND 24""")
def seq_overlap_windows(spark, sf_dir):
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - 30) / 20))
    last = F.floor((F.col("i") - 1) / 20)
    s = signal(spark, sf_dir).withColumn("k", F.explode(F.sequence(first, last)))
    s = s.withColumn("top", F.max("value").over(W.partitionBy("user_id", "k")))
    return s.where((F.col("i") - 1 - F.col("k") * 20).between(5, 24)).select("user_id", "i", "k", F.round(F.col("value") / F.col("top"), 6).alias("scaled"))


@query(f"""WITH {EV}, {_ERR}, o AS (SELECT unnest(range(1, 6)) AS k)
SELECT z.user_id, z.start, string_agg(CAST(coalesce(e.c, 0) AS VARCHAR), ',' ORDER BY o.k DESC) AS context FROM z CROSS JOIN o
 LEFT JOIN ev e ON e.user_id = z.user_id AND e.i = z.start - o.k WHERE z.length >= 2 AND z.start > 1 GROUP BY 1, 2""")
def seq_left_pad(spark, sf_dir):
    w = within(U, "i")
    s = signal(spark, sf_dir).withColumn("context", F.concat_ws(",", *[F.coalesce(F.lag("c", k).over(w), F.lit(0)).cast("string") for k in (5, 4, 3, 2, 1)]))
    found = seq.runs(s, U, "i", zero(), F.min_by("context", "i").alias("context"))
    return found.where("length >= 2 and start > 1").select("user_id", "start", "context")


@query(f"""WITH {EV}, {_THR}, x AS (SELECT e.* FROM ev e JOIN th USING (user_id) WHERE value >= threshold), {runs_sql('r', 'true', 'x')}, {merge_sql('m', '(SELECT * FROM r WHERE length > 1)', 0, 1)}
SELECT * FROM (SELECT user_id, lag(stop) OVER (PARTITION BY user_id ORDER BY start) AS gap_start, start AS gap_stop FROM m) WHERE gap_start IS NOT NULL""")
def seq_activity(spark, sf_dir):
    s = signal(spark, sf_dir)
    loud = s.join(threshold(s), "user_id")
    m = seq.merge_runs(seq.runs(loud, U, "i", F.col("value") >= F.col("threshold"), chunk=ROWS).where("length > 1"), U, 0, width=ROWS)
    m = seq.scan(m, U, ["start"], rows_of("start"), gap_start=("previous", F.col("stop")))
    return m.select("user_id", "gap_start", F.col("start").alias("gap_stop")).where("gap_start is not null")


@query(f"""WITH {EV}, d AS (SELECT CAST(floor(t_us / {DAY}.0) AS BIGINT) AS day, event_type, CAST(sum(c * c) AS DOUBLE) AS e FROM ev GROUP BY 1, 2),
 m AS (SELECT *, (coalesce(lag(e) OVER w, e) + e + coalesce(lead(e) OVER w, e)) / 3 AS s FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
 l AS (SELECT *, min(s) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS low FROM m)
SELECT day, round(10 * log10(greatest(sum(CASE WHEN event_type = 'error' AND day % 7 = 0 THEN 0 ELSE low END), 1e-20)), 6) AS floor_db FROM l GROUP BY day""")
def seq_floor_bands(spark, sf_dir):
    d = signal(spark, sf_dir).groupBy(F.floor(F.col("t_us") / DAY).alias("day"), "event_type").agg(F.sum(F.col("c") * F.col("c")).cast("double").alias("e"))
    m = seq.edge_mean(d, ["event_type"], "day", "e", -1, 1, "s")
    m = seq.sliding(m, ["event_type"], "day", F.min("s"), -2, 1, "low")
    kept = F.when(zero() & (F.col("day") % 7 == 0), 0.0).otherwise(F.col("low"))
    return m.groupBy("day").agg(F.round(10 * F.log10(F.greatest(F.sum(kept), F.lit(1e-20))), 6).alias("floor_db"))


@query(f"""WITH {EV}, t AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top,
 t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY i) AS gap, max(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {2 * HOUR} PRECEDING AND {2 * HOUR} FOLLOWING) AS err FROM ev)
SELECT user_id, i, value, CASE WHEN value >= 300 THEN 3 ELSE 2 END AS severity FROM t WHERE value = top AND value >= 150 AND gap >= {6 * HOUR} AND err = 0""")
def seq_clicks_in_gaps(spark, sf_dir):
    s = seq.scan(signal(spark, sf_dir), U, ["i"], rows_of(), before=("previous", F.col("t_us"))).withColumn("gap", F.col("t_us") - F.col("before"))
    found = peaks(seq.sliding_range(s, U, "t_us", F.max(zero().cast("int")), 2 * HOUR, 2 * HOUR, "err", SPAN)).where((F.col("gap") >= 6 * HOUR) & (F.col("err") == 0))
    return found.select("user_id", "i", "value", F.when(F.col("value") >= 300, 3).otherwise(2).cast("long").alias("severity"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 'no narration' WHEN n_chars < 200 THEN 'short' ELSE 'normal' END AS event, CASE WHEN n_chars < 200 THEN 3 ELSE 0 END AS severity FROM documents")
def seq_file_events(spark, sf_dir):
    n = F.col("n_chars")
    from reedline.plans.registry import table

    return table(spark, sf_dir, "documents").select("doc_id", F.when(n == 0, "no narration").when(n < 200, "short").otherwise("normal").alias("event"), F.when(n < 200, 3).otherwise(0).cast("long").alias("severity"))
