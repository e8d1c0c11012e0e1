"""Sound files as DataFrames: one row a file, or one row a chunk of samples with a margin on both sides.

The source splits: a task reads a range of bytes of a file, finds the format by a few kB at the file's start, and makes the chunks whose own first sample lies in its range, so a file
of any size (RF64 too) is many tasks' work and a task holds one chunk. Checks that look only a little way around a sample then run on chunks alone, without a shuffle.
A filter on file is pushed into the source. A file that can't be read gives a row with its error, and never fails a task.

    wav.register(spark)
    spark.read.format("wav").option("size", 65536).load(folder).where("file = ...")
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Channels may differ by this much and count as one; a sample beyond this is not a sound.
CHANNEL_TOLERANCE = 4 / 32768
LARGEST_SAMPLE = 16.0

FILES = "file string, sample_rate int, bit_depth int, channels int, n_samples long, block_align int, bytes_claimed long, bytes_actual long, note string, error string"
CHUNKS = "file string, sample_rate int, bit_depth int, n_samples long, chunk long, start long, core_stop long, window_start long, samples array<float>, invalid array<long>"
DIFFERENCES = "file string, channels int, differ boolean"
_SCHEMAS = {"chunks": CHUNKS, "files": FILES, "differences": DIFFERENCES}
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64())}

#: Bytes of files that one task reads, and headers that it looks at.
SPLIT_BYTES = 64 << 20
HEADERS = 2_000
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


class NotReadable(ValueError):
    """Why a file gives no samples."""


def register(spark: SparkSession) -> None:
    """Make the format "wav" known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sound files of folders, or single files: see FILES. Null error: readable.

    Names that start with a dot are left out, as other suffixes are; a file of 0 bytes is a row with its error. A file that several local paths lead to, links too, is
    one row, by the first path in order. Only headers are read, but of files of several channels all samples, to tell whether the channels are equal.
    """
    heads = _load(spark, path, rows="files")
    return heads.join(_unequal(spark, path).withColumn("_differ", F.lit(True)), "file", "left").select(*[_refused(c).alias(c) for c in heads.columns])


def _refused(name: str):
    if name == "file":
        return F.col(name)
    if name == "error":
        return F.when(F.col("_differ"), F.format_string("%d channels that differ", "channels")).otherwise(F.col(name))
    return F.when(F.col("_differ").isNull(), F.col(name))


def chunks(spark: SparkSession, path: str | list[str], size: int = 65_536, margin_s: float = 0.05, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Samples of all readable files: see CHUNKS.

    Chunk k has the samples start to core_stop as its own; samples also holds margin_s seconds on either side where the file has them, from
    window_start on. Invalid samples (not finite, or beyond LARGEST_SAMPLE) are 0, and listed in invalid if they are the chunk's own.
    """
    if size < 1 or margin_s < 0 or split_bytes < 1:
        raise ValueError("size and split_bytes must be 1 or more, margin_s 0 or more")
    found = _load(spark, path, rows="chunks", size=size, margin_s=margin_s, split_bytes=split_bytes)
    return found.join(_unequal(spark, path), "file", "left_anti")


def samples(cut: DataFrame) -> DataFrame:
    """Chunks as one row a sample: file, i, v; margins left out."""
    own = F.slice("samples", (F.col("start") - F.col("window_start") + 1).cast("int"), (F.col("core_stop") - F.col("start")).cast("int"))
    return cut.select("file", "start", F.posexplode(own).alias("at", "v")).select("file", (F.col("start") + F.col("at")).alias("i"), F.col("v").cast("double").alias("v"))


def _load(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    register(spark)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("wav").options(**{k: str(v) for k, v in options.items()}, paths=json.dumps(paths)).load()


def _unequal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files whose channels differ anywhere."""
    return _load(spark, path, rows="differences").where("differ").select("file").distinct()


class WavSource(DataSource):
    """Options: path, or paths (a JSON list); rows (chunks, files or differences); size and margin_s of chunks; split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("rows", "chunks")]

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


@dataclass
class Ranges(InputPartition):
    """Ranges of bytes of files: (name, where, size of the file, from, to)."""

    value: list[tuple[str, str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.rows = options.get("rows", "chunks")
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.size, self.margin_s = int(options.get("size", 65_536)), float(options.get("margin_s", 0.05))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        for one in filters:
            wanted = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if wanted is None or one.attribute != ("file",):
                yield one
            else:
                self.only = wanted if self.only is None else self.only & wanted

    def partitions(self) -> list[Ranges]:
        """Small files together, long ones in pieces. Nothing of a file is read here."""
        out: list[list] = [[]]
        room = self.split_bytes
        for name, where, size in listed(self.paths):
            if self.only is not None and name not in self.only:
                continue
            for low in range(0, max(size, 1), self.split_bytes) if self.rows != "files" else (0,):
                high = min(size, low + self.split_bytes)
                if out[-1] and (high - low > room and self.rows != "files" or len(out[-1]) >= HEADERS):
                    out.append([])
                    room = self.split_bytes
                out[-1].append((name, where, size, low, high))
                room -= high - low
        return [Ranges(part) for part in out if part]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        columns = [c.split() for c in _SCHEMAS[self.rows].split(", ")]
        schema = pa.schema([(c, _TYPES[t]) for c, t in columns])
        make = {"chunks": self._chunks, "files": self._files, "differences": self._differences}[self.rows]
        for name, where, size, low, high in partition.value:
            for row in make(name, where, size, low, high):
                yield pa.RecordBatch.from_pylist([row], schema=schema) if self.rows != "chunks" else pa.RecordBatch.from_arrays([pa.array([row[c]], _TYPES[t]) for c, t in columns], schema=schema)

    def _files(self, name, where, size, low, high):
        try:
            with _opened(where) as f:
                head = header(f, size)
            count = head["channels"]
            yield {c: head[c] for c in ("sample_rate", "bit_depth", "channels", "block_align", "bytes_claimed", "bytes_actual", "n_samples")} | {"file": name, "note": f"{count} equal channels: the first is used" if count > 1 else None}
        except (NotReadable, OSError) as why:
            yield {"file": name, "error": str(why)}

    def _windows(self, name, where, size, low, high, several: bool):
        """Header, number and samples of each chunk that begins in the range."""
        try:
            with _opened(where) as f:
                head = header(f, size)
                if several and head["channels"] == 1:
                    return
                block, n = head["block_align"], head["n_samples"]
                first, last = (max(0, -(-(b - head["data_at"]) // (block * self.size))) for b in (low, high))
                margin = 0 if several else int(round(self.margin_s * head["sample_rate"]))
                for k in range(first, min(last, -(-n // self.size))):
                    a, b = max(0, k * self.size - margin), min(n, (k + 1) * self.size + margin)
                    f.seek(head["data_at"] + a * block)
                    yield head, k, a, _table(f.read((b - a) * block), head)
        except (NotReadable, OSError):
            return

    def _chunks(self, name, where, size, low, high):
        for head, k, first, table in self._windows(name, where, size, low, high, False):
            x, bad = mono(table)
            start, stop = k * self.size, min(head["n_samples"], (k + 1) * self.size)
            own = np.flatnonzero(bad) + first
            yield {"file": name, "sample_rate": head["sample_rate"], "bit_depth": head["bit_depth"], "n_samples": head["n_samples"], "chunk": k, "start": start, "core_stop": stop, "window_start": first, "samples": x, "invalid": own[(own >= start) & (own < stop)]}

    def _differences(self, name, where, size, low, high):
        for head, _, _, table in self._windows(name, where, size, low, high, True):
            whole = np.isfinite(table).all(axis=1)
            if whole.any() and np.abs(table[whole] - table[whole, :1]).max() > CHANNEL_TOLERANCE:
                yield {"file": name, "channels": head["channels"], "differ": True}
                return


def listed(paths: list[str]) -> list[tuple[str, str, int]]:
    """(name, where, size) of the sound files that paths lead to, in order of names. Local files are told apart by device and number, others by their address."""
    found = {}
    for path in paths:
        address = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path)
        if address and address[0] != "file:":
            store, at = fs.FileSystem.from_uri(path)
            prefix = path[: len(path.rstrip("/")) - len(at.rstrip("/").lstrip("/"))]
        else:
            store, at, prefix = fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//)?", "", path)), "file:"
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        for one in every:
            if one.type != fs.FileType.File or not re.fullmatch(r"[^.].*\.(wav|bwf)", one.base_name, re.IGNORECASE):
                continue
            name = prefix + (one.path if prefix == "file:" else one.path.lstrip("/"))
            key = (lambda s: (s.st_dev, s.st_ino))(os.stat(one.path)) if prefix == "file:" else name
            found[key] = min(found.get(key, (name, name, one.size)), (name, name, one.size))
    return sorted(found.values())


def _opened(where: str):
    if where.startswith("file:"):
        return open(where.removeprefix("file:"), "rb")
    store, at = fs.FileSystem.from_uri(where)
    return store.open_input_file(at)


def header(f, size: int) -> dict:
    """The format, the place of the data and the length that the header claims for it; a claim beyond the file's end means a cut file. Only headers of parts are read."""
    start = f.read(12)
    if len(start) < 12 or start[:4] not in (b"RIFF", b"RF64") or start[8:12] != b"WAVE":
        raise NotReadable("not a WAV file")
    at, form, long_data = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        at += 8
        if name == b"fmt ":
            form = f.read(min(length, 64))
        elif name == b"ds64":
            long_data = struct.unpack_from("<Q", f.read(16).ljust(16, b"\0"), 8)[0]
        elif name == b"data":
            if form is None or len(form) < 16:
                break
            claimed = long_data if length == 0xFFFFFFFF and long_data is not None else length
            return _known(form) | {"data_at": at, "bytes_claimed": claimed, "bytes_actual": min(claimed, size - at)} | _length(form, min(claimed, size - at))
        at += length + length % 2
    raise NotReadable("no format or no data")


def _known(form: bytes) -> dict:
    kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", form)
    if kind == _EXTENSIBLE and len(form) >= 26:
        kind = struct.unpack_from("<H", form, 24)[0]
    if not channels or not rate or block != channels * ((bits + 7) // 8):
        raise NotReadable("header fields don't fit each other")
    if not (kind == _FLOAT and bits in (32, 64) or kind == _PCM and bits in (8, 16, 24, 32)):
        raise NotReadable(f"format {kind} with {bits} bits is not known")
    return {"kind": kind, "channels": channels, "sample_rate": rate, "block_align": block, "bit_depth": bits}


def _length(form: bytes, actual: int) -> dict:
    n = actual // _known(form)["block_align"]
    if not n:
        raise NotReadable("no samples in the data part")
    return {"n_samples": n}


def _table(data: bytes, head: dict) -> np.ndarray:
    """Samples by channel, -1 to 1."""
    data = data[: len(data) // head["block_align"] * head["block_align"]]
    bits = head["bit_depth"]
    if head["kind"] == _FLOAT:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8) - 128.0) / 128
    elif bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0] / 2.0**31
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return x.reshape(-1, head["channels"])


def mono(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first channel, and where it is invalid: not finite in any channel, or too large. Invalid samples are 0."""
    x = table[:, 0].copy()
    if table.shape[1] > 1:
        x[~np.isfinite(table).all(axis=1)] = np.nan
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(x) <= LARGEST_SAMPLE)
    x[bad] = 0
    return x.astype(np.float32), bad
