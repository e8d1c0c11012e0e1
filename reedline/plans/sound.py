"""Kernels of the checks on sound, with each embedding as a short sound of its own length, in SQL as sums over samples and bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reedline.operators import hum, kernels
from reedline.plans.registry import query, table

RATE = 1000.0
#: Vectors whose rows a worker holds at once.
AT_ONCE = 256
_V = "s AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n FROM embeddings WHERE len(embedding) >= 2)"
_LONG = f"""{_V}, l AS MATERIALIZED (SELECT vec_id, n, 3 * n - 2 AS m, unnest(range(3 * n - 2)) AS t, unnest(list_concat(list_transform(range(n - 1, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v, list_transform(range(n - 2, -1, -1), lambda i: 2 * v[n] - v[i + 1]))) AS w FROM s)"""


def _each(spark, sf_dir, of, schema: str, least: int = 2):
    """of(samples) of every vector gives the columns of schema; no row leaves its task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = [of(np.asarray(v, np.float64)) for v in part.column("v").to_pylist()]
                keys = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(c)) for c in zip(*found))], ["vec_id", *names])

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") >= least)
    return rows.mapInArrow(run, f"vec_id long, {schema}")


def _numbered(values):
    return np.arange(len(values)), np.round(values, 6) + 0.0


def _zero_phase_sql(power: str) -> str:
    """A filter without delay: the mirrored sound, folded with the response at each of its frequencies; power is of o, the warped frequency."""
    return f"""WITH {_LONG}, k AS (SELECT m, unnest(range(m)) AS k FROM (SELECT DISTINCT m FROM l)),
 r AS (SELECT m, k, tan(pi() * least(greatest(least(k, m - k) / m::DOUBLE, 1e-9 / {RATE}), 0.5 * (1 - 1e-9))) AS o FROM k),
 g AS MATERIALIZED (SELECT r.m, d.k AS d, sum({power} * cos(2 * pi() * r.k * d.k / r.m)) / r.m AS g FROM r JOIN k AS d ON d.m = r.m GROUP BY 1, 2)
SELECT vec_id, j.k - (n - 1) AS i, round(sum(w * g), 6) + 0 AS v FROM l JOIN k AS j ON j.m = l.m AND j.k BETWEEN n - 1 AND 2 * n - 2 JOIN g ON g.m = l.m AND g.d = (t - j.k + l.m) % l.m GROUP BY 1, 2"""


@query(_zero_phase_sql(f"1 / (1 + pow(tan(pi() * 200 / {RATE}) / o, 16))"))
def sound_highpass(spark, sf_dir):
    """Order 8 from 200 Hz, forwards and backwards."""
    return _each(spark, sf_dir, lambda x: _numbered(kernels.filtered(x, RATE, 8, low=200.0)), "i long, v double")


_A, _B = f"tan(pi() * 100 / {RATE})", f"tan(pi() * 300 / {RATE})"


@query(_zero_phase_sql(f"1 / (1 + pow((o * o - {_A} * {_B}) / (o * ({_B} - {_A})), 8))"))
def sound_bandpass(spark, sf_dir):
    """Order 4 from 100 to 300 Hz, forwards and backwards."""
    return _each(spark, sf_dir, lambda x: _numbered(kernels.filtered(x, RATE, 4, 100.0, 300.0)), "i long, v double")


def _bessel(z: str) -> str:
    return f"list_sum(list_transform(range(0, 40), lambda q: exp(2 * (q * ln(greatest({z}, 1e-300) / 2) - lgamma(q + 1)))))"


def _resampled_sql(up: int, down: int) -> str:
    half = 10 * max(up, down)
    return f"""WITH {_V}, d AS (SELECT unnest(range(-{half}, {half} + 1)) AS d),
 h0 AS (SELECT d, CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d / {max(up, down)}.0) / (pi() * d / {max(up, down)}.0) END * {_bessel(f"(5 * sqrt(1 - (d / {half}.0) * (d / {half}.0)))")} AS h FROM d),
 h AS MATERIALIZED (SELECT d, {up} * h / sum(h) OVER () AS h FROM h0),
 x AS MATERIALIZED (SELECT vec_id, n, unnest(range(n)) AS i, unnest(v) AS v FROM s)
SELECT x.vec_id, k.k AS i, round(sum(x.v * h.h), 6) + 0 AS v FROM (SELECT vec_id, unnest(range(CAST(ceil(n * {up} / {down}.0) AS BIGINT))) AS k FROM s) k JOIN x USING (vec_id) JOIN h ON h.d = k.k * {down} - x.i * {up} GROUP BY 1, 2"""


@query(_resampled_sql(1, 4))
def sound_decimated(spark, sf_dir):
    """A quarter of the rate, through a Kaiser-windowed sinc."""
    return _each(spark, sf_dir, lambda x: _numbered(kernels.resampled(x, 1, 4)), "i long, v double")


@query(_resampled_sql(3, 2))
def sound_resampled(spark, sf_dir):
    """Three halves of the rate."""
    return _each(spark, sf_dir, lambda x: _numbered(kernels.resampled(x, 3, 2)), "i long, v double")


@query(f"""WITH {_V}, x AS MATERIALIZED (SELECT vec_id, unnest(range(n)) AS i, unnest(v) AS v FROM s), k AS (SELECT vec_id, unnest(range(CAST(ceil(CAST(160 * n / 441.0 AS FLOAT)) AS BIGINT))) AS k FROM s),
 t AS (SELECT vec_id, k, v, least(6, greatest(-6, (i - k * 441 / 160.0) / 441 * 158.4)) AS t FROM k JOIN x USING (vec_id))
SELECT vec_id, k AS i, round(sum(v * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * pow(cos(t * pi() / 12), 2) * 158.4 / 441), 6) + 0 AS v FROM t GROUP BY 1, 2""")
def sound_sinc_resampled(spark, sf_dir):
    """160 of 441 samples, through a Hann-windowed sinc."""
    return _each(spark, sf_dir, lambda x: _numbered(kernels.torch_like_resampled(x, 441, 160)), "i long, v double")


#: Of the spectrum of a whole pause: Hann-windowed, padded eightfold to a power of two.
def _pause_sql(fs: float, low: float, high: float, tone: float = 0.0) -> str:
    return f"""{_V}, w AS MATERIALIZED (SELECT vec_id, n, CAST(pow(2, ceil(log2(8 * n))) AS BIGINT) AS z, unnest(range(n)) AS t, unnest(list_transform(range(n), lambda i: v[i + 1] + {tone} * cos(2 * pi() * 0.45 * i))) AS v, 0.5 - 0.5 * cos(2 * pi() * unnest(range(n)) / (n - 1)) AS hann FROM s WHERE n >= 0.2 * {fs}),
 b AS (SELECT z, unnest(range(z // 2 + 1)) AS b FROM (SELECT DISTINCT z FROM w)),
 p AS MATERIALIZED (SELECT vec_id, n, w.z, b, b * {fs} / w.z AS f, sqrt(pow(sum(v * hann * cos(2 * pi() * b * t / w.z)), 2) + pow(sum(v * hann * sin(2 * pi() * b * t / w.z)), 2)) * sqrt(2) / sum(hann) AS level
  FROM w JOIN b ON b.z = w.z AND b * {fs} / w.z BETWEEN {low} AND {high} GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_pause_sql(100.0, 19.0, 21.0)} SELECT vec_id, 20.0::DOUBLE AS hz, round(20 * log10(max(level) + 1e-12), 6) AS level_db FROM p GROUP BY 1")
def sound_pause_level(spark, sf_dir):
    """The level of 20 Hz in each vector as a pause at 100 Hz."""
    return _each(spark, sf_dir, lambda x: ([20.0], np.round(hum.levels_of(x, 100.0, [20.0]), 6)), "hz double, level_db double", 20)


_FS = 100.0


@query(f"""WITH {_pause_sql(_FS, 30.0, 1010.0, 2.0)}, d AS MATERIALIZED (SELECT vec_id, n, z, b, f, 20 * log10(level + 1e-12) AS db, row_number() OVER (PARTITION BY vec_id ORDER BY b) AS r, count(*) OVER (PARTITION BY vec_id) AS c FROM p),
 o AS (SELECT d.vec_id, d.b, median(e.db) AS around FROM (SELECT *, unnest(range(-CAST(round(10 * z / {_FS}) AS BIGINT), CAST(round(10 * z / {_FS}) AS BIGINT) + 1)) AS o FROM d) d JOIN d AS e ON e.vec_id = d.vec_id AND e.r = greatest(1, least(d.c, d.r + d.o)) GROUP BY 1, 2),
 t AS MATERIALIZED (SELECT q.vec_id, q.n, q.f, q.db FROM (SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS g FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY b)) q JOIN o USING (vec_id, b) WHERE db >= l AND db > g AND db - around >= 12 AND f >= 40 - {_FS} / z)
SELECT vec_id, round(f, 7) AS hz, round(db, 6) AS line_db FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.vec_id = t.vec_id AND abs(u.f - t.f) <= 6 * {_FS} / t.n AND u.db - t.db >= 25)""")
def sound_pause_lines(spark, sf_dir):
    """The lines of each vector as a pause at 100 Hz, with a tone of 45 Hz in it."""
    return _each(spark, sf_dir, lambda x: [np.round(c, places) for places, c in zip((7, 6), hum.lines_of(x + 2.0 * np.cos(2 * np.pi * 0.45 * np.arange(len(x))), _FS))], "hz double, line_db double", 20)
