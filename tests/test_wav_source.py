"""The splittable source of sound files: any cut of a file into tasks gives the same chunks."""

import io
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from sounds import RATE, write

from reedline.sources import wav


def noise(n, seed=1):
    return np.random.default_rng(seed).uniform(-0.5, 0.5, n)


def long_file(path, frames):
    """An RF64 file of silence, with nothing but its ends on the disk."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE * 2, 2, 16)
    ds64 = struct.pack("<4sIQQQI", b"ds64", 28, 0, frames * 2, frames, 0)
    head = b"RF64" + b"\xff" * 4 + b"WAVE" + ds64 + form + b"data" + b"\xff" * 4
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + frames * 2)
        f.seek(len(head) + frames * 2 - 2)
        f.write(struct.pack("<h", 16384))


@pytest.mark.parametrize("split", [10, 999, 20_000, 1 << 20])
@pytest.mark.parametrize("size", [64, 5000])
def test_any_split_gives_the_same_chunks(spark, tmp_path, split, size):
    x = noise(9001)
    write(tmp_path / "a.wav", x)
    write(tmp_path / "b.wav", x[:100])
    got = wav.chunks(spark, str(tmp_path), size, 0.01, split).orderBy("file", "chunk").collect()
    back = np.round(x * 2**23) / 2**23
    margin = round(0.01 * RATE)
    for name, n in (("a", 9001), ("b", 100)):
        mine = [r for r in got if r.file.endswith(f"/{name}.wav")]
        assert [(r.chunk, r.start, r.core_stop) for r in mine] == [(k, a, min(n, a + size)) for k, a in enumerate(range(0, n, size))]
        for r in mine:
            assert r.window_start == max(0, r.start - margin) and r.n_samples == n
            assert np.allclose(r.samples, back[r.window_start : min(n, r.core_stop + margin)], atol=1e-7)


def test_a_file_beyond_two_gigabytes_is_many_tasks(spark, tmp_path):
    frames = 1_200_000_000
    long_file(tmp_path / "long.wav", frames)
    row = wav.files(spark, str(tmp_path)).first()
    assert row.error is None and row.n_samples == frames and row.bytes_actual == 2 * frames
    reader = wav.WavReader({"path": str(tmp_path / "long.wav"), "size": str(1 << 20), "rows": "chunks"})
    parts = reader.partitions()
    assert len(parts) == -(-(os.path.getsize(tmp_path / "long.wav")) // wav.SPLIT_BYTES)
    numbers = [b.column("chunk")[0].as_py() for b in reader.read(parts[1])]
    assert numbers == list(range(numbers[0], numbers[0] + 32)) and numbers[0] == 32
    last = list(reader.read(parts[-1]))[-1]
    assert last.column("core_stop")[0].as_py() == frames and last.column("samples")[0].as_py()[-1] == 0.5


def test_headers_are_read_by_a_few_bytes(tmp_path):
    long_file(tmp_path / "long.wav", 1_000_000)

    class Counted(io.FileIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.total += len(out)
            return out

    with Counted(tmp_path / "long.wav") as f:
        assert wav.header(f, os.path.getsize(tmp_path / "long.wav"))["n_samples"] == 1_000_000
    assert Counted.total < 1000


def test_a_filter_on_file_reaches_the_source(spark, tmp_path):
    for k in range(5):
        write(tmp_path / f"{k}.wav", noise(500, k))
    wav.register(spark)
    every = spark.read.format("wav").option("rows", "files").load(str(tmp_path))
    names = sorted(r.file for r in every.collect())
    reader = wav.WavReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("file",), (names[0], names[3])), EqualTo(("file",), names[3]), GreaterThan(("chunk",), 1)]))
    assert left == [GreaterThan(("chunk",), 1)] and [p.value[0][0] for p in reader.partitions()] == [names[3]]
    assert [r.file for r in every.where(F.col("file") == names[2]).collect()] == [names[2]]
    assert spark.read.format("wav").option("size", 100).load(str(tmp_path)).where(F.col("file").isin(names[:2])).count() == 10


def test_each_file_once_whichever_path_leads_to_it(spark, tmp_path):
    write(tmp_path / "a.wav", noise(300))
    (tmp_path / "sub").mkdir()
    os.symlink(tmp_path / "a.wav", tmp_path / "sub" / "link.wav")
    os.link(tmp_path / "a.wav", tmp_path / "sub" / "same.wav")
    (tmp_path / "sub" / "nothing.wav").write_bytes(b"")
    (tmp_path / "sub" / ".hidden.wav").write_bytes(b"")
    rows = wav.files(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "a.wav"), f"{tmp_path}/sub/../a.wav"]).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.error) for r in rows) == [("a.wav", None), ("nothing.wav", "not a WAV file")]


def test_channels_that_differ_late_refuse_the_whole_file(spark, tmp_path):
    both = np.repeat(noise(4000)[:, None], 2, axis=1)
    late = both.copy()
    late[3990, 1] += 0.01
    for name, x in (("equal", both), ("late", late)):
        body = np.round(x * 2**15).astype("<i2").tobytes()
        form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, RATE, RATE * 4, 4, 16)
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + form + b"data" + struct.pack("<I", len(body)) + body)
    found = {r.file.rsplit("/", 1)[1]: r for r in wav.files(spark, str(tmp_path)).collect()}
    assert found["late.wav"].error == "2 channels that differ" and found["late.wav"].n_samples is None
    assert found["equal.wav"].note == "2 equal channels: the first is used" and found["equal.wav"].error is None
    assert {r.file.rsplit("/", 1)[1] for r in wav.chunks(spark, str(tmp_path), 100, 0.0, 300).select("file").distinct().collect()} == {"equal.wav"}
