import hashlib

import pytest
from helpers import AWKWARD, documents, prose
from pyspark.sql import functions as F

from reedline.llm import exact_dedup
from reedline.llm.exact_dedup import BLANKS


def brute(ids, texts):
    groups = {}
    for i, t in zip(ids, texts):
        norm = (t or "").translate({ord(c): None for c in BLANKS})
        groups.setdefault(norm, []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        for _, i in members:
            out[i] = (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hashed", [None, lambda c: F.lit(7).cast("long"), lambda c: F.xxhash64(F.substring(c, 1, 1))])
@pytest.mark.parametrize("bucket_bytes", [1 << 20, 300])
def test_equals_brute_force_even_when_all_hashes_collide(spark, hashed, bucket_bytes):
    texts = [prose(5, k % 40, 20) + " " * (k % 3) for k in range(150)] + AWKWARD
    got = exact_dedup.exact_dedup(spark, documents(spark, texts), bucket_bytes, hashed=hashed).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == brute(range(len(texts)), texts)
    assert len(got) == len(texts)


def test_directory_splits_overfull_buckets_only(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"), F.lit(100).cast("long").alias("bytes"))
    parts, depth = exact_dedup.directory(spark, keys, 10_000)
    got = parts.toPandas()
    assert got.prefix.between(0, 2**depth - 1).all()
    held = keys.select(F.shiftrightunsigned("h", 64 - depth).alias("prefix"), "bytes").join(parts, "prefix").groupBy("bucket").agg(F.sum("bytes").alias("b"), F.max("local_depth").alias("d")).toPandas()
    assert held.b.sum() == 200_000 and held.b.max() <= 10_000 and 20 <= len(held) <= 80


def test_no_rows_and_repeated_rows(spark):
    assert exact_dedup.exact_dedup(spark, documents(spark, [], parts=1)).count() == 0
    got = exact_dedup.exact_dedup(spark, documents(spark, ["x y", "xy", "x y"], ids=[3, None, 3])).toPandas()
    assert set(got.keep_id) == {3} and set(got.group_size) == {3} and got.kept.sum() == 2


def test_directory_doubles_until_keys_with_a_shared_prefix_fit(spark):
    keys = spark.range(2000).select(F.shiftrightunsigned(F.xxhash64("id"), 9).alias("h"), F.lit(100).cast("long").alias("bytes"))
    parts, depth = exact_dedup.directory(spark, keys, 10_000)
    held = keys.select(F.shiftrightunsigned("h", 64 - depth).alias("prefix"), "bytes").join(parts, "prefix").groupBy("bucket").agg(F.sum("bytes").alias("b")).toPandas()
    assert 9 < depth <= 20 and held.b.sum() == 200_000 and held.b.max() <= 10_000
    one = exact_dedup.directory(spark, keys.limit(1).withColumn("bytes", F.lit(50_000).cast("long")), 10_000)
    assert one[1] == 1 and one[0].count() == 1  # one key can't be split


def test_a_stored_index_finds_texts_later(spark, tmp_path):
    path = str(tmp_path / "index")
    exact_dedup.build_index(spark, documents(spark, ["a b", "ab", "c", None]), 100, path=path)
    got = exact_dedup.lookup(spark, documents(spark, ["A", " c ", "ab", ""], ids=[10, 11, 12, 13]), path).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {10: (None, None), 11: (2, 1), 12: (0, 2), 13: (3, 1)}
    empty = str(tmp_path / "empty")
    exact_dedup.build_index(spark, documents(spark, [], parts=1), path=empty)
    assert [r.keep_id for r in exact_dedup.lookup(spark, documents(spark, ["A"]), empty).collect()] == [None]
