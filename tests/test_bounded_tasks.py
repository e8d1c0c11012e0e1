"""Queries whose tasks hold a few vectors, or the open tracks of a user, however many rows a batch or a user has."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from reedline.plans import sound, spectral


class Taken:
    """Stands for a table and keeps the function that its tasks would run."""

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, run, schema):
        return run


def batch(n):
    v = np.random.default_rng(3).normal(size=(n, spectral.SIZE))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(v), pa.list_(pa.float64()))], ["vec_id", "v"])


def peak_mb(run, rows):
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([rows]))) > 0
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_network_holds_a_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(spectral, "vectors", lambda *_: Taken())
    assert peak_mb(spectral.model_forward(None, ""), batch(3000)) < 60


def test_sounds_go_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sound, "table", lambda *_: Taken())
    found = list(sound.sound_resampled(None, "")(iter([batch(700)])))
    assert [b.num_rows for b in found] == [96 * 256, 96 * 256, 96 * 188]
    assert pa.Table.from_batches(found)["vec_id"].to_pylist() == [k for k in range(700) for _ in range(96)]


def plain(rows):
    out = []
    for user in sorted({r[0] for r in rows}):
        days: dict[int, list[float]] = {}
        for _, day, v in (r for r in rows if r[0] == user and r[2] >= 60):
            days.setdefault(day, []).append(v)
        tracks = []
        for day in sorted(days):
            used = set()
            for v in sorted(days[day], reverse=True):
                near = min(((abs(t[2] - v), n) for n, t in enumerate(tracks) if day - t[1] <= 3 and n not in used and abs(t[2] - v) <= 2), default=None)
                if near:
                    used.add(near[1])
                    tracks[near[1]] = [tracks[near[1]][0], day, v, tracks[near[1]][3] + 1]
                else:
                    used.add(len(tracks))
                    tracks.append([day, day, v, 1])
        out += [(user, *t) for t in tracks if t[3] > 1]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_tracks_equal_a_plain_fold_and_no_group_is_one_frame(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.randrange(4), r.choice([r.randrange(5), r.randrange(30)]), r.choice([r.randrange(120, 160) / 2, 55.0])) for _ in range(600)]
    spark.createDataFrame(rows, "user_id long, day long, value double").selectExpr("user_id", "timestamp_ntz'1970-01-01' + make_dt_interval(cast(day as int), 5) as ts", "value", "'x' as event_type", "monotonically_increasing_id() as event_id").write.parquet(f"{tmp_path}/events.parquet")
    found = spectral.track_lines(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == plain(rows)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
