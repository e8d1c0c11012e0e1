"""Frames, spectra and text of embeddings, parts, pages and documents.

The spectra and the small network are defined for vectors of SIZE components, each a frame of that length; a vector of another length is no frame and has no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.operators import seq
from reedline.plans.registry import query, table

SIZE = 64
#: Vectors that the network takes at once: a square of SIZE for each, a few at a time, is all that a worker holds of them.
AT_ONCE = 256
_X = "x AS (SELECT vec_id, unnest(range(1, 65)) AS n, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_P = f"""{_X}, k AS (SELECT unnest(range(0, 33)) AS k), p AS (SELECT vec_id, k, pow(sum(v * cos(2 * pi() * k * (n - 1) / 64)), 2) + pow(sum(v * sin(2 * pi() * k * (n - 1) / 64)), 2) AS power FROM x, k GROUP BY 1, 2)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def spectrum(spark, sf_dir, lines, schema):
    """lines(powers) of a batch of spectra (vectors x 33) gives arrays of row number and values; no row leaves its task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            row, *values = lines(np.abs(np.fft.rfft(v, axis=1)) ** 2)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), *map(pa.array, values)], ["vec_id", *names])

    source = vectors(spark, sf_dir).where(F.size("v") == SIZE)
    key = source.schema["vec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"vec_id {key}, {schema}")


def _every(values):
    """Row number, place and value of each element."""
    import numpy as np

    n, m = values.shape
    return np.repeat(np.arange(n), m), np.tile(np.arange(m), n), values.ravel()


def _decibels(power):
    import numpy as np

    return 10 * np.log10(np.maximum(power, 1e-20))


def _peaks(power):
    import numpy as np

    row, k = np.nonzero((power[:, 1:-1] > power[:, :-2]) & (power[:, 1:-1] >= power[:, 2:]))
    left, mid, right = power[row, k], power[row, k + 1], power[row, k + 2]
    return row, k + 1, 0.5 * (left - right) / (left - 2 * mid + right)


def _octaves(power):
    import numpy as np

    return _every(_decibels(np.stack([power[:, 1 << b : 2 << b].sum(axis=1) for b in range(6)], axis=1)))


def _prominences(power):
    import numpy as np

    db = np.pad(_decibels(power), [(0, 0), (5, 5)], constant_values=np.nan)
    around = np.nanmedian(np.lib.stride_tricks.sliding_window_view(db, 11, axis=1), axis=2)
    return _every(db[:, 5:-5] - around)


@query(f"WITH {_P} SELECT vec_id, k, round(power, 6) AS power FROM p")
def spec_dft(spark, sf_dir):
    return spectrum(spark, sf_dir, _every, "k long, power double").select("vec_id", "k", F.round("power", 6).alias("power"))


@query(f"""WITH {_P}, d AS (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS r FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k))
SELECT vec_id, k, round(0.5 * (l - r) / (l - 2 * power + r), 6) AS shift FROM d WHERE power > l AND power >= r""")
def spec_peaks(spark, sf_dir):
    return spectrum(spark, sf_dir, _peaks, "k long, shift double").select("vec_id", "k", F.round("shift", 6).alias("shift"))


@query(f"WITH {_P} SELECT vec_id, CAST(floor(log2(k)) AS BIGINT) AS band, round(10 * log10(greatest(sum(power), 1e-20)), 6) AS db FROM p WHERE k > 0 GROUP BY 1, 2")
def spec_bands(spark, sf_dir):
    return spectrum(spark, sf_dir, _octaves, "band long, db double").select("vec_id", "band", F.round("db", 6).alias("db"))


@query(f"""WITH {_P}, d AS (SELECT vec_id, k, 10 * log10(greatest(power, 1e-20)) AS db FROM p)
SELECT vec_id, k, round(db - median(db) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS prominence FROM d""")
def spec_prominence(spark, sf_dir):
    return spectrum(spark, sf_dir, _prominences, "k long, prominence double").select("vec_id", "k", F.round("prominence", 6).alias("prominence"))


@query(f"""WITH {_X}, d AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY n) AS b FROM x)
SELECT vec_id, round(avg(CAST((v >= 0) <> (b >= 0) AS INT)), 6) AS zcr, round(var_samp(v), 6) AS variance FROM d GROUP BY 1""")
def frame_zcr_var(spark, sf_dir):
    v = F.col("v")
    turns = F.zip_with(F.slice(v, 1, SIZE - 1), F.slice(v, 2, SIZE - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / SIZE
    square = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    zcr = F.aggregate(turns, F.lit(0.0), lambda s, x: s + x) / (SIZE - 1)
    return vectors(spark, sf_dir).select("vec_id", F.round(zcr, 6).alias("zcr"), F.round(square / (SIZE - 1), 6).alias("variance"))


@query(f"""WITH {_X}, r AS (SELECT *, v / sqrt(avg(v * v) OVER (PARTITION BY vec_id) + 1e-6) AS u FROM x)
SELECT vec_id, round(max(exp(u)) / sum(exp(u)), 6) AS best FROM r GROUP BY 1""")
def tensor_rms_softmax(spark, sf_dir):
    v = F.col("v")
    rms = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x) / SIZE + 1e-6)
    grown = F.transform(v, lambda x: F.exp(x / F.col("rms")))
    out = vectors(spark, sf_dir).withColumn("rms", rms).withColumn("e", grown)
    return out.select("vec_id", F.round(F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("best"))


@query(f"""WITH {_X} SELECT vec_id, round(max(abs(a.v - b.v)), 6) AS apart, max(abs(a.v - b.v)) <= 0.3 AS mono FROM (SELECT vec_id, n, v FROM x WHERE n <= 32) a JOIN (SELECT vec_id AS w, n - 32 AS m, v FROM x WHERE n > 32) b ON b.w = a.vec_id AND b.m = a.n GROUP BY 1""")
def mono_check(spark, sf_dir):
    apart = F.array_max(F.zip_with(F.slice("v", 1, 32), F.slice("v", 33, 32), lambda a, b: F.abs(a - b)))
    return vectors(spark, sf_dir).select("vec_id", F.round(apart, 6).alias("apart"), (apart <= 0.3).alias("mono"))


@query(f"WITH {_X}, f AS (SELECT unnest(range(0, 7)) AS f) SELECT vec_id, f AS frame, round(avg(v * v), 6) AS power FROM x, f WHERE n > f * 8 AND n <= f * 8 + 16 GROUP BY 1, 2")
def seq_frames(spark, sf_dir):
    frames = vectors(spark, sf_dir).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("frame"))
    power = F.aggregate(F.transform(F.slice("v", F.col("frame") * 8 + 1, F.lit(16)), lambda x: x * x), F.lit(0.0), lambda s, x: s + x) / 16
    return frames.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(power, 6).alias("power"))


@query()
def model_forward(spark, sf_dir):
    """A fixed small network: convolution, one attention head, mean; three numbers a vector, in Arrow batches."""
    import numpy as np

    rng = np.random.default_rng(5)
    kernel, q, k, out = (rng.normal(size=s) for s in ((3, 8), (8, 8), (8, 8), (8, 3)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
                h = np.tanh(np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (1, 1))), 3, axis=1) @ kernel)
                a = (h @ q) @ np.swapaxes(h @ k, 1, 2) / np.sqrt(8)
                a = np.exp(a - a.max(axis=2, keepdims=True))
                y = ((a / a.sum(axis=2, keepdims=True)) @ h).mean(axis=1) @ out
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), *(pa.array(np.round(y[:, c], 6)) for c in range(3))], ["vec_id", "y0", "y1", "y2"])

    return vectors(spark, sf_dir).where(F.size("v") == SIZE).mapInArrow(run, "vec_id long, y0 double, y1 double, y2 double")


#: A 19-point table: sizes and factors, doubling from 1.
POINTS = [(2 ** (k / 3), 1 + 1 / (k + 1)) for k in range(19)]


@query(f"""WITH t(x, y) AS (VALUES {', '.join(f'({x!r}::DOUBLE, {y!r}::DOUBLE)' for x, y in POINTS)}), b AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM t)
SELECT p_partkey, round(exp(ln(y) + (ln(p_size) - ln(x)) * (ln(y2) - ln(y)) / (ln(x2) - ln(x))), 6) AS factor FROM part JOIN b ON p_size >= x AND p_size < x2""")
def scalar_interp_loglog(spark, sf_dir):
    size = F.log(F.col("p_size").cast("double"))
    out = F.lit(math.log(POINTS[-1][1]))
    for (x, y), (x2, y2) in reversed(list(zip(POINTS, POINTS[1:]))):
        slope = (math.log(y2) - math.log(y)) / (math.log(x2) - math.log(x))
        out = F.when(F.col("p_size") < x2, math.log(y) + (size - math.log(x)) * slope).otherwise(out)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.exp(F.when(F.col("p_size") < 1, math.log(POINTS[0][1])).otherwise(out)), 6).alias("factor"))


@query(r"SELECT doc_id, replace(replace(replace(text, chr(10), '\n'), chr(9), '\t'), chr(13), '\r') AS shown FROM documents")
def text_escape(spark, sf_dir):
    shown = F.col("text")
    for raw, mark in (("\n", r"\n"), ("\t", r"\t"), ("\r", r"\r")):
        shown = F.replace(shown, F.lit(raw), F.lit(mark))
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("shown"))


@query("""WITH c AS (SELECT doc_id, substr('=+-@' || chr(39) || 'ab', CAST(doc_id % 7 AS INT) + 1, 1) || text AS cell FROM documents)
SELECT doc_id, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(39)) THEN chr(39) || cell ELSE cell END AS guarded FROM c""")
def text_formula_guard(spark, sf_dir):
    cell = F.concat(F.substring(F.lit("=+-@'ab"), (F.col("doc_id") % 7 + 1).cast("int"), F.lit(1)), F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", cell.alias("cell"))
    return d.select("doc_id", F.when(F.substring("cell", 1, 1).isin("=", "+", "-", "@", "\t", "\r", "'"), F.concat(F.lit("'"), "cell")).otherwise(F.col("cell")).alias("guarded"))


_CLEAN = "regexp_replace(url, '[?#].*$', '')"


@query(f"""SELECT {_CLEAN} AS path, min(page_id) AS page_id FROM pages WHERE regexp_extract({_CLEAN}, '^[a-z]+://[^/]+/([a-z]+)', 1) IN ('en', 'de') GROUP BY 1""")
def path_expand(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return p.where(F.regexp_extract("path", "^[a-z]+://[^/]+/([a-z]+)", 1).isin("en", "de")).groupBy("path").agg(F.min("page_id").alias("page_id"))


@query(f"""WITH n AS (SELECT page_id, lower(regexp_extract(rtrim({_CLEAN}, '/'), '([^/]+)$', 1)) AS key FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS k FROM n)
SELECT page_id, CASE WHEN k = 1 THEN key ELSE key || ' (' || k || ')' END AS name FROM r""")
def name_plan(spark, sf_dir):
    clean = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    n = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(clean, "([^/]+)$", 1)).alias("key"))
    k = F.row_number().over(W.partitionBy("key").orderBy("page_id"))
    n = n.withColumn("k", k)
    return n.select("page_id", F.when(F.col("k") == 1, F.col("key")).otherwise(F.format_string("%s (%d)", "key", "k")).alias("name"))


@query()
def track_lines(spark, sf_dir):
    """Greedy tracking of daily lines, a fold over days: each line joins the nearest open track within 2, which closes after two days without.

    A user's days are cut where no track can stay open. Stretches are folded row by row in the order that the sort gives, so a task holds the open tracks of one stretch and never its rows.
    """
    from reedline.plans.registry import DAY

    events = table(spark, sf_dir, "events").where("value >= 60").select("user_id", F.floor(seq.micros("ts") / DAY).alias("day"), "value").where("day is not null")
    quiet = F.col("day") - F.lag("day").over(W.partitionBy("user_id").orderBy("day")) > 3
    lines = seq.islands(events, ["user_id"], ["day"], quiet, "stretch").repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "day", F.desc("value"))
    return lines.mapInArrow(_followed(), "user_id long, first_day long, last_day long, last_value double, members long")


def _followed():
    """The fold of track_lines over rows sorted by user, stretch and day, the greatest values first."""

    def run(batches):
        from bisect import bisect_left

        import pyarrow as pa

        key, today, tracks, free, done = None, None, [], [], []  # tracks: first day, last day, last value, members, in the order they opened
        for batch in batches:
            for user, stretch, day, v in zip(*(batch.column(c).to_pylist() for c in ("user_id", "stretch", "day", "value"))):
                if key != (user, stretch):
                    done += [(key[0], *t) for t in tracks if t[3] > 1]
                    key, today, tracks = (user, stretch), None, []
                if day != today:
                    done += [(user, *t) for t in tracks if day - t[1] > 3 and t[3] > 1]
                    tracks = [t for t in tracks if day - t[1] <= 3]
                    today, free = day, sorted((t[2], n) for n, t in enumerate(tracks) if t[2] == t[2])
                # the nearest values at or above and below, of equal ones the track that opened first
                at = bisect_left(free, (v,))
                near = [(abs(free[p][0] - v), free[p][1], p) for p in ([at] if at < len(free) else []) + ([bisect_left(free, (free[at - 1][0],))] if at else [])]
                near = min((x for x in near if x[0] <= 2), default=None)
                if near:
                    t = tracks[near[1]]
                    t[1], t[2], t[3] = day, v, t[3] + 1
                    del free[near[2]]
                else:
                    tracks.append([day, day, v, 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*done)) or [[]] * 5, kinds)], names)
            done = []
        if key:
            done = [(key[0], *t) for t in tracks if t[3] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*done)) or [[]] * 5, kinds)], names)

    import pyarrow as pa

    names = ["user_id", "first_day", "last_day", "last_value", "members"]
    kinds = [pa.int64()] * 3 + [pa.float64(), pa.int64()]
    return run
