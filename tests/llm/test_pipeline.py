import re
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from helpers import prose
from test_decontaminate import brute as leaks
from test_exact_dedup import brute as equal_groups
from test_jaccard_join import brute as near_groups
from test_packing import ids_of

from reedline.llm import common, jaccard_join, language_id, packing

SF = "/root/testdata/sf0.001"


def test_stages_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at = docs
    kept = {i: t for i, t in rows.items() if re.search(r"[^\W\d_]", t or "")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).toPandas(), docs.schema)
        if name == "exact_dedup":
            groups = equal_groups(list(kept), list(kept.values()))
            kept = {i: t for i, t in kept.items() if groups[i][2]}
        elif name == "jaccard_join":
            ids = sorted(kept)
            groups = near_groups([kept[i] for i in ids])
            kept = {ids[k]: kept[ids[k]] for k in groups if groups[k][0] == k}
        elif name == "decontamination":
            ids = sorted(kept)
            held = {ids[d] for d, _, _ in leaks([kept[i] for i in ids], items)}
            kept = {i: t for i, t in kept.items() if i not in held}
        assert {r["doc_id"] for r in at.select("doc_id").collect()} == set(kept), name
        assert at.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: len(ids_of(t)) for i, t in kept.items()}
    assert set(packed.bin_length) <= set(packing.LENGTHS)


def test_rows_without_id_and_with_the_same_id(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = prose(200, 3)
    rows = [
        (None, "a copy of a text"), (None, "a copy of a text"), (7, "a copy of a text"), (8, "twice the same row"), (8, "twice the same row"),
        (9, "a copy of a text"), (9, "clean text beside it"), (10, f"{item} leaked"), (10, "clean text beside a leak"), (None, f"leaked {item}"),
        (None, near), (11, near + " more"), (11, near + " other"), (None, "no id and no copy"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(7, "a copy of a text"), (8, "twice the same row"), (9, "clean text beside it"), (10, "clean text beside a leak"), (None, "no id and no copy")]
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for at in (docs, spark.read.parquet(f"{tmp_path}/documents.parquet")):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            at = stage(spark, at, str(tmp_path))
        got = [(r["doc_id"], r["text"]) for r in at.collect()]
        assert len(got) == 6 and {r for r in got if not r[1].startswith(near)} == set(want)
        assert [r[0] for r in got if r[1].startswith(near)] == [11]


def test_every_document_with_a_letter_has_a_language(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for langs in (["en", "de", "fr", "it"], [None] * 4):
        rows = [(k, "same words", lang, "s", 10) for k, lang in enumerate(langs)] + [(8, "12 ...", "en", "s", 6), (9, None, None, "s", 0)]
        got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), "")
        assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3]


def test_clashing_columns_a_very_long_text_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, place long, class_id long"
    rows = [(1, prose(700_000, 1), "en", None, 0, "a", 0.5, 1, 2), (2, "short text", "en", None, 0, None, None, None, None), (3, "short  text", None, None, 0, "b", 0.1, 1, 2), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame([(1, "nothing of this is anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {1: len(ids_of(rows[0][1])), 3: 3}
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_items_of_one_and_two_words_count(spark, tmp_path):
    spark.createDataFrame([(1, "zyzzogeton"), (2, "quixotic zebras"), (3, "a longer item of several words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["clean text of some words", "it holds Zyzzogeton once", "two quixotic zebras ran", "quixotic ideas and zebras", "so a longer item of several words here"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {least: sorted(r.doc_id for r in corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path), least).collect()) for least in (1, 3)}
    assert kept == {1: [0, 3], 3: [0, 1, 2, 3]} and sorted(r.doc_id for r in corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).collect()) == [0, 3]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_tasks_get_texts_in_small_batches(spark, tmp_path, stage):
    spark.createDataFrame([(1, "nothing of this is anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat(concat('text ', id, ' '), 2500) as text", "'en' as lang")  # 9 MB in one task

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    before = spark.conf.get(common._BATCH, None)
    spark.conf.unset(common._BATCH)
    try:
        corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * common.BATCH_BYTES
        spark.conf.set(common._BATCH, "1m")  # a session's own bound stays
        common.small_batches(spark)
        assert spark.conf.get(common._BATCH) == "1m"
    finally:
        spark.conf.set(common._BATCH, before) if before else spark.conf.unset(common._BATCH)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_texts_are_scored_in_parts():
    model = language_id.Model(["de", "en"], np.random.default_rng(1).normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    assert peak_mb(lambda: language_id.score_texts(model, [prose(2000, k) for k in range(5)] * 40)) < 30


def test_far_members_are_held_against_few_sets_at_a_time():
    sketch = np.random.default_rng(2).integers(0, 256, (3000, jaccard_join.COORDINATES), np.uint8)
    far = [{"rep": k, "sketch": sketch[k].tobytes()} for k in range(jaccard_join.SMALL)]
    lead = {"path": 1, "part": 0, "first": 0, "far": far, "rep": None, "near": None, "sketch": None}
    rows = [{"path": 1, "part": 0, "first": 1, "far": None, "rep": k, "near": k >= 1024, "sketch": s.tobytes()} for k, s in enumerate(sketch)]
    batch, found = pa.RecordBatch.from_pylist([lead, *rows]), []
    assert peak_mb(lambda: found.extend(jaccard_join._against_far(0.8)(iter([batch])))) < 20
    assert sorted(zip(*(found[0].column(c).to_pylist() for c in "uv"))) == [(k, k) for k in range(jaccard_join.SMALL)]


def test_a_worker_gives_freed_memory_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024

    def run(batches, pins):
        for _ in batches:
            blocks = [bytes(1000) for _ in range(150_000)]
            pins.append(bytes(1000))  # lies behind them, so that the heap can't shrink
            yield len(blocks)

    before, pins = held(), []
    assert list(common.tidy(lambda batches: run(batches, pins))([1])) == [150_000]
    assert held() - before < 60
