import hashlib
import math

import numpy as np
import pytest

from reedline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, x string, total string, dim string, h string, inertia string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["?"] * 7) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, clusters, rounds, d):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    now = [list(v) for _, v in order[:clusters]]

    def places():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        at = places()
        for k in range(len(now)):
            mine = [v for (_, v), (_, j) in zip(kept, at) if j == k]
            if mine:
                now[k] = [sum(c) // len(mine) for c in zip(*mine)]
    at = places()
    inertia = {k: sum(dist for dist, j in at if j == k) for k in range(len(now))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, k, dist, inertia[k], sum(inertia.values()), sha[k]) for (i, _), (dist, k) in zip(kept, at)), key=repr)


def got(spark, rows, **more):
    out = centroids.digested(*centroids.cluster(spark, table(spark, rows), **more)).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out), key=repr)


def test_equals_whole_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.3, 64) + (i % 5)).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a third of the rows are copies
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [float("nan")] + [1.0] * 63), (505, [float("inf")] * 64), (506, [None] + [1.0] * 63), (7, rows[9][1]), (None, rows[8][1]), (None, rows[8][1])]
    assert got(spark, rows) == brute(rows, 8, 10, 64)


def test_ties_few_rows_and_no_rows(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(6)]  # two places, eight centroids: empty ones stay, ties go to the smaller number
    assert got(spark, rows, dimensions=4) == brute(rows, 8, 10, 4)
    assert got(spark, rows[:1], dimensions=4) == brute(rows[:1], 8, 10, 4)
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []


def test_a_component_too_large_has_no_cluster(spark):
    rows = [(1, [1.0] * 64), (2, [3e38] * 64), (3, [131_072.0] * 64)]
    assert {r[0]: r[1] for r in got(spark, rows, clusters=2)} == {1: 0, 2: None, 3: 1} or {r[0]: r[1] for r in got(spark, rows, clusters=2)} == {1: 1, 2: None, 3: 0}
    with pytest.raises(ValueError):
        centroids.cluster(spark, table(spark, rows), clusters=1 << 20)


@pytest.mark.parametrize("spread", [3, 1 << 12, 1 << 26])
def test_intervals_never_lose_the_nearest(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread + 1, (40, 64))
    c[20:] = c[:20]  # each centroid twice
    c[30:, 0] += 1  # and some off by one: float32 can't tell them apart
    x = np.concatenate([c + rng.integers(-1, 2, c.shape), rng.integers(-spread, spread + 1, (200, 64)), (c[:20] + c[1:21]) // 2])
    best, distance, decided = centroids.nearest(x, c)
    exact = np.square(x[:, None, :] - c[None, :, :]).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and decided > 0
