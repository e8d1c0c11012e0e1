"""Documents to packed training sequences: STAGES in order, each reading what the one before wrote.

A stage takes documents with at least doc_id, text and lang, and any other columns but _row_key, _file and _row; all but the last return the same
columns. Null and empty texts have no language and go at the first stage; null, equal or repeated doc_ids are rows like others. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from reedline.llm.common import stored

#: Stages decide by row: a number of each row, since doc_id may be null or repeat.
KEY = "_row_key"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter go on, however sure their language is. Null texts and texts without a letter are rejected."""
    columns = docs.columns
    model = language_id.train(spark, docs.select("doc_id", "text", "lang"))
    if not model.langs:  # nothing to learn from: all would be 'und'
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = language_id.identify(spark, docs, model)
    return known.where(F.col("lang_pred") != language_id.UNKNOWN).select(*columns)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the most code points goes on, then the least doc_id (null last), then any one."""
    rows = _keyed(spark, docs)
    found = exact_dedup.exact_dedup(spark, _by_key(rows)).where("group_size > 1")
    size = F.length(F.coalesce("text", F.lit("")))
    return _without(docs, rows, _later(rows, found.select(F.col("doc_id").alias(KEY), F.col("keep_id").alias("_class")), -size))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id (null last) goes on, then any one."""
    rows = _keyed(spark, docs)
    found = jaccard_join.near_duplicates(spark, _by_key(rows)).where("n_links > 0")
    return _without(docs, rows, _later(rows, found.select(F.col("doc_id").alias(KEY), F.col("class_id").alias("_class")), F.lit(0)))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str, least_words: int = 1) -> DataFrame:
    """Documents that hold no test item of least_words or more go on: none at all, unless more is asked for."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(spark, docs)
    found = decontaminate.contaminated(spark, _by_key(rows), benchmark, least_words=least_words)
    return _without(docs, rows, found.select(F.col("doc_id").alias(KEY)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the token ids of each document, or of each piece of a long one, lie in the training sequences."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), lean=True)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number of each row, the same at every reading: where a row lies in its file, or else docs are stored with numbers."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return stored(spark, docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    names = sorted(r[0] for r in rows.select("_file").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(names)), "_number long, _file string")
    return rows.join(F.broadcast(numbers), "_file").select(*docs.columns, F.expr("shiftleft(_number, 40) + _row").alias(KEY))


def _by_key(rows: DataFrame) -> DataFrame:
    """Rows as the operators read them, with their own number as doc_id: no two rows share one, none is null."""
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def _later(rows: DataFrame, classes: DataFrame, first: Column) -> DataFrame:
    """The keys of all rows of each class but one: the least by first, doc_id (null last), key."""
    order = F.struct(first.alias("first"), F.col("doc_id").isNull().alias("without"), "doc_id", KEY)
    kept = classes.join(rows.select(KEY, order.alias("place")), KEY).groupBy("_class").agg(F.min("place").alias("place"))
    return classes.join(kept.select(f"place.{KEY}"), KEY, "left_anti").select(KEY)


def _without(docs: DataFrame, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those whose key is in gone, in the columns of docs."""
    return rows.join(gone.select(KEY).distinct(), KEY, "left_anti").select(*docs.columns)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_copies),
    ("jaccard_join", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Language ID and alignment aren't SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored in the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
