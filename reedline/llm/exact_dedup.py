"""Exact deduplication with an extendible-hash index on shared files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import fresh_path, small_batches, stored, tidy

#: The characters [\x20\x09-\x0D], which don't count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
BUCKET_BYTES = 16 << 20
#: The deepest directory: 2^20 prefixes. A bucket overfull even there is left as it is, its owner reads it in order.
MAX_DEPTH = 20
#: An owner task has the buckets of one range of prefixes: 2^OWNED of them once the directory is deeper than FEW.
OWNED, FEW = 4, 8
COMBINE_BYTES = 32 << 20


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def directory(spark: SparkSession, keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The extendible-hash directory over (h, bytes), one row a distinct key: (prefix, bucket, owner, local_depth, depth), and its depth.

    It starts with two entries and doubles while a bucket is overfull, that is, holds more than bucket_bytes in two or more keys, up to
    max_depth. A bucket is the shortest prefix that isn't overfull, so entries of a deep directory share shallow buckets. Keys are summed once by
    their first max_depth bits, a table of bounded size; each doubling sums that table again.
    """
    fine = keys.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys"))
    fine = stored(spark, fine, "hash-prefixes")

    def at(depth: int) -> DataFrame:
        return fine.groupBy(F.shiftright("prefix", max_depth - depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("keys").alias("keys"))

    overfull = (F.col("bytes") > bucket_bytes) & (F.col("keys") > 1)
    depth = 1
    while depth < max_depth and not at(depth).where(overfull).isEmpty():
        depth += 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = at(depth).select("prefix", "bytes", "keys", levels).withColumn("node", F.expr(f"shiftright(prefix, {depth} - level)"))
    sums = nodes.groupBy("level", "node").agg(F.sum("bytes").alias("bytes"), F.sum("keys").alias("keys"))
    fits = sums.where(~overfull | (F.col("level") == depth)).select("level", "node")
    chosen = nodes.join(fits, ["level", "node"]).groupBy("prefix").agg(F.min("level").alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftright(prefix, {depth} - local_depth), {depth} - local_depth)")
    owner = F.shiftright("bucket", depth - max(min(depth, FEW), depth - OWNED))
    return chosen.select("prefix", bucket.alias("bucket"), "local_depth", F.lit(depth).alias("depth")).withColumn("owner", owner), depth


def _combine(batches):
    """Within one task, rows with the same bytes become one (the copies that arrive together), in bounded memory."""
    schema = None
    held: dict[tuple, list] = {}
    size = 0

    def flush():
        rows = [(*k[:3], *v, k[3]) for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([("owner", pa.int64()), ("bucket", pa.int64()), ("h", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("keep_id", pa.int64()), ("norm", pa.string())])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("owner", "bucket", "h", "n", "doc_id", "norm")]
        for owner, bucket, h, n, doc_id, norm in zip(*columns):
            entry = held.get((owner, bucket, h, norm))
            if entry is None:
                held[(owner, bucket, h, norm)] = [1, n, doc_id]
                size += 4 * len(norm) + 200
            else:
                entry[0] += 1
                if _better(n, doc_id, entry[1], entry[2]):
                    entry[1:] = n, doc_id
        if size > COMBINE_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _better(n: int, doc_id: int | None, n2: int, id2: int | None) -> bool:
    """More code points first, then the smaller id; a row without an id comes last."""
    return (n, doc_id is not None, -(doc_id or 0)) > (n2, id2 is not None, -(id2 or 0))


def _chain(batches):
    """An owner task: keys arrive in order; under each key the chain of different texts, compared byte by byte."""
    schema = pa.schema([("owner", pa.int64()), ("bucket", pa.int64()), ("h", pa.int64()), ("chain", pa.int32()), ("copies", pa.int64()), ("n", pa.int64()), ("keep_id", pa.int64()), ("norm", pa.string())])
    at, chain = None, {}

    def entries():
        return [(*at, i, *v, norm) for i, (norm, v) in enumerate(chain.items())]

    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("owner", "bucket", "h", "copies", "n", "keep_id", "norm")]
        for owner, bucket, h, copies, n, keep_id, norm in zip(*columns):
            if (owner, bucket, h) != at:
                if at is not None:
                    done += entries()
                at, chain = (owner, bucket, h), {}
            entry = chain.get(norm)
            if entry is None:
                chain[norm] = [copies, n, keep_id]
            else:
                entry[0] += copies
                if _better(n, keep_id, entry[1], entry[2]):
                    entry[1:] = n, keep_id
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries()), schema.types)], schema=schema)


def _marked(docs: DataFrame, text: str, hashed) -> DataFrame:
    """doc_id, h, text_sha256 and bytes of the normalised text of every row."""
    rows = docs.select("doc_id", normalised(text).alias("norm"))
    return rows.select("doc_id", hashed("norm").alias("h"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("bytes"))


def _placed(rows: DataFrame, parts: DataFrame, depth: int) -> DataFrame:
    """Rows with a hash h, with the bucket and owner that the directory names. It is sent to all while it has at most 2^16 rows, else joined."""
    keyed = rows.withColumn("prefix", F.shiftrightunsigned("h", 64 - depth))
    parts = parts.select("prefix", "bucket", "owner")
    return keyed.join(F.broadcast(parts) if depth <= 16 else parts, "prefix", "left").drop("prefix")


def build_index(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, text: str = "text", hashed=None, path: str | None = None) -> tuple[DataFrame, str]:
    """Writes the index: the directory, and a folder for each owner with the files of its buckets; returns (members, path).

    members: doc_id, h, text_sha256 of every row. path: where the index is to stay; else it lies in the shared folder while the session lasts.
    hashed: another hash of a column, for tests of collisions.
    """
    small_batches(spark)
    path = path or fresh_path(spark, "hash-index")
    hashed = hashed or F.xxhash64
    members = stored(spark, _marked(docs, text, hashed), "hash-members")
    parts, depth = directory(spark, members.groupBy("h").agg((F.max("bytes") + 64).alias("bytes")), bucket_bytes)
    parts.write.parquet(f"{path}/directory")
    parts = spark.read.parquet(f"{path}/directory")
    norm = normalised(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"), norm.alias("norm"), hashed(norm).alias("h"))
    keyed = _placed(rows, parts, depth).select("owner", "bucket", "h", "n", "doc_id", "norm")
    combined = keyed.mapInArrow(tidy(_combine), "owner long, bucket long, h long, copies long, n long, keep_id long, norm string")
    owned = combined.repartition("owner").sortWithinPartitions("owner", "bucket", "h")
    chained = owned.mapInArrow(tidy(_chain), "owner long, bucket long, h long, chain int, copies long, n long, keep_id long, norm string")
    entries = chained.select(
        "owner", "bucket", "h", "chain", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), "keep_id", F.col("copies").alias("group_size")
    )
    entries.write.partitionBy("owner").parquet(f"{path}/buckets")
    return members, path


_ENTRIES = "bucket long, h long, chain int, text_sha256 string, keep_id long, group_size long, owner long"


def find_entries(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """rows (h, text_sha256 and others) with the entry of their text in the index at path, or nulls: each row goes to its bucket by the directory."""
    parts = spark.read.parquet(f"{path}/directory")
    found = parts.select("depth").first()
    if found is None:  # an index of no rows
        entries = spark.createDataFrame([], _ENTRIES)
        return rows.join(entries.drop("owner", "bucket"), ["h", "text_sha256"], "left").withColumn("bucket", F.lit(None).cast("long"))
    entries = spark.read.schema(_ENTRIES).parquet(f"{path}/buckets")
    return _placed(rows, parts, found[0]).join(entries, ["owner", "bucket", "h", "text_sha256"], "left").drop("owner")


def lookup(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", hashed=None) -> DataFrame:
    """Which rows of other documents have their text in a stored index: doc_id, keep_id, group_size (nulls where it is new)."""
    rows = _marked(docs, text, hashed or F.xxhash64).drop("bytes")
    return find_entries(spark, rows, path).select("doc_id", "keep_id", "group_size")


def exact_dedup(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, text: str = "text", hashed=None) -> DataFrame:
    """Groups of equal texts: one row a document with doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when the same after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row
    with the most code points in the original text stays, then the smallest doc_id; a row without doc_id comes last.

    First every row's 64-bit hash and checksum go to a shared table. Their bytes by hash prefix give the directory, whose buckets
    are key ranges of bounded size. Texts then go to the task that owns their range of buckets, copies in one map task combined before;
    owners read keys in order and compare the bytes of each text with the chain of texts under that key. So a group of copies of any size
    costs its owner one row for each map task, and no task holds more than one key's different texts. The entries are
    stored in files by owner, and members find theirs through the directory by an equi-join on bucket, hash and checksum, whose large keys Spark can split.

    Rows repeated with the same doc_id count as copies and share the answer. An empty table gives no rows. Columns other than
    doc_id and the text are not read.
    """
    members, path = build_index(spark, docs, bucket_bytes, text, hashed)
    return find_entries(spark, members.drop("bytes"), path).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain"
    )
