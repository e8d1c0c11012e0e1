"""Tensor files (the public safetensors form) as a DataFrame, one row a tensor; a file that breaks rules gives one row that names all of them.

The form: eight bytes of header length (little-endian), a JSON object of tensors, then the data part. Only float32 is read, and the tensors must fill
the data part without gaps. The rules are checked on one table of all entries of a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENSORS = "file string, sha256 string, name string, shape array<long>, offset long, values array<float>, error string"
_WIDTH = {"F32": 4}


def tensors(spark: SparkSession, path: str, sha256: str | None = None, size: int | None = None, metadata: bool = True) -> DataFrame:
    """See TENSORS. With sha256 or size, a file that has another is one row with that error and no values; metadata=False refuses files that carry any.

    The checksum is of the very bytes that are parsed.
    """
    raw = spark.read.format("binaryFile").load(path)
    found = F.sha2("content", 256)
    wrong = F.array_compact(F.array(
        F.when(F.lit(sha256 is not None) & (found != F.lit(sha256 or "")), "checksum is not the expected one"),
        F.when(F.lit(size is not None) & (F.length("content") != F.lit(size or 0)), F.format_string("%d bytes are not the expected size", F.length("content"))),
    ))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in TENSORS.split(", ")]
        for batch in batches:
            for file, sha, content, known in batch.itertuples(index=False):
                start, table, broken = entries(content)
                broken = [*known, *broken, *(["metadata is not allowed"] if not metadata and table.attrs.get("metadata") else [])]
                if broken:
                    yield pd.DataFrame([(file, sha, None, None, None, None, "; ".join(broken))], columns=columns).astype({"offset": "Int64"})
                    continue
                for entry in table.itertuples(index=False):
                    values = np.frombuffer(content, "<f4", (entry.stop - entry.start) // 4, start + entry.start)
                    yield pd.DataFrame([(file, sha, entry.name, entry.shape, entry.start, values, None)], columns=columns)

    return raw.select(F.col("path").alias("file"), found.alias("sha256"), "content", wrong.alias("wrong")).mapInPandas(rows, TENSORS)


def entries(content: bytes) -> tuple[int, pd.DataFrame, list[str]]:
    """Where the data part begins, the table of tensors (name, dtype, shape, start, stop; in order of start), and every rule that the file breaks."""
    none = pd.DataFrame(columns=["name", "dtype", "shape", "start", "stop"])
    length = int.from_bytes(content[:8], "little") if len(content) >= 8 else -1
    begin = 8 + length
    if length < 0 or begin > len(content):
        return 0, none, ["the header is longer than the file"]
    try:
        header = json.loads(content[8:begin])
        assert isinstance(header, dict)
    except (ValueError, AssertionError, RecursionError):
        return 0, none, ["the header is no JSON object"]
    extra = header.pop("__metadata__", None)
    broken = [] if extra is None or (isinstance(extra, dict) and set(map(type, extra.values())) <= {str}) else ["metadata holds other than texts"]
    table = pd.DataFrame([_row(name, spec) for name, spec in header.items()], columns=none.columns)
    table.attrs["metadata"] = extra is not None
    odd = table["start"].isna() | ~table["dtype"].isin(_WIDTH)
    broken += [f"{name}: not a float32 tensor with whole shape and offsets" for name in table.loc[odd, "name"]]
    if odd.any():
        return begin, table, broken
    table = table.astype({"start": np.int64, "stop": np.int64}).sort_values(["start", "stop"], kind="stable").reset_index(drop=True)
    table.attrs["metadata"] = extra is not None
    wanted = np.array([_WIDTH[d] * int(np.prod(s, dtype=object)) for d, s in zip(table["dtype"], table["shape"])], dtype=object)
    broken += [f"{name}: shape and offsets differ" for name in table.loc[(table["stop"] - table["start"]).to_numpy() != wanted, "name"]]
    edges = np.concatenate([[0], table["stop"], [len(content) - begin]])
    places = np.concatenate([table["start"], [len(content) - begin]])
    names = [*table["name"], "end of the data"]
    broken += [f"{names[k]}: overlap or gap before it" for k in np.flatnonzero(places != edges[:-1])]
    return begin, table, broken


def _row(name: str, spec: object) -> tuple:
    """An entry of the header as a row; nulls where it isn't one."""
    spec = spec if isinstance(spec, dict) else {}
    shape, ends = spec.get("shape"), spec.get("data_offsets")
    numbers = [x for part in (shape, ends) if isinstance(part, list) for x in part]
    fine = isinstance(shape, list) and isinstance(ends, list) and len(ends) == 2 and all(type(x) is int and 0 <= x < 1 << 62 for x in numbers)
    return (name, spec.get("dtype"), shape, *(ends if fine else (None, None)))
