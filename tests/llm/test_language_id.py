import math
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents, prose

from reedline.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.train(spark, docs.where("not held_out"))
    got = language_id.identify(spark, docs.where("held_out"), model, ["doc_id", "lang"]).toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_scores_equal_a_plain_sum(spark):
    rng = np.random.default_rng(1)
    model = language_id.Model(["x", "y"], rng.normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.log([0.3, 0.7]))
    texts = ["Some words, 12 and more", "b", "a" * 1000]
    langs, scores = language_id.score_texts(model, texts)
    for text, lang, score in zip(texts, langs, scores):
        total = model.prior + model.weights[language_id._grams(language_id._codes(text))].astype(float).sum(axis=0)
        odds = np.exp(total - total.max())
        assert lang == model.langs[total.argmax()] and score == pytest.approx(odds.max() / odds.sum())


def plain_grams(text):
    """Bucket counts of all n-grams, by plain string slices and integers."""
    out = Counter()
    letters = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    for size in language_id.SIZES if letters.strip() else ():
        for k in range(len(letters) - size + 1):
            state = 0
            for i, c in enumerate(letters[k : k + size], 1):
                state = (state + ord(c) + i) * 0x9E3779B97F4A7C15 % (1 << 64)
                state ^= state >> 31
            out[(state >> 20) % language_id.BUCKETS] += 1
    return out


def test_model_and_predictions_equal_plain_counting(spark):
    texts = ["Der Hund, 3 Katzen", "the dog and the cat", "le chien", "ein Haus", "a house on a hill", "l'été à la mer", None, "…!", "das und die", "xyz"]
    langs = ["de", "en", "fr", "de", "en", "fr", "en", "fr", None, None]
    docs = documents(spark, texts, langs)
    model = language_id.train(spark, docs)
    counts = {x: sum((plain_grams(t) for t, y in zip(texts, langs) if y == x and t is not None), Counter()) for x in ("de", "en", "fr")}
    rows = Counter(y for t, y in zip(texts, langs) if y and t is not None)
    assert model.langs == ["de", "en", "fr"] and model.prior == pytest.approx([math.log(rows[x] / rows.total()) for x in model.langs])
    plain = {x: [math.log((c[b] + language_id.SMOOTHING) / (c.total() + language_id.SMOOTHING * language_id.BUCKETS)) for b in range(language_id.BUCKETS)] for x, c in counts.items()}
    for k, x in enumerate(model.langs):
        assert model.weights[:, k] == pytest.approx(plain[x], rel=1e-5)
    for row in language_id.identify(spark, docs, model).collect():
        grams = plain_grams(texts[row.doc_id])
        if not grams:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        total = {x: math.log(rows[x] / rows.total()) + sum(n * plain[x][b] for b, n in grams.items()) for x in plain}
        best = max(total, key=total.get)
        assert row.lang_pred == best and row.score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), rel=1e-3)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "der hund", "de", "a", 2.0, "b", "c")], "doc_id long, text string, lang string, _text string, score double, `a.b` string, c0 string")
    got = language_id.identify(spark, docs, language_id.train(spark, docs))
    assert got.columns == ["doc_id", "text", "lang", "_text", "a.b", "c0", "lang_pred", "score"]
    assert tuple(got.first())[:-1] == (1, "der hund", "de", "a", "b", "c", "de")


def test_long_texts_count_every_gram_once():
    codes = language_id._codes("abc def " * 100_000)
    grams = sum(np.bincount(language_id._grams(p), minlength=language_id.BUCKETS) for p in language_id._pieces(codes))
    whole = np.bincount(language_id._grams(codes, starts=len(codes)), minlength=language_id.BUCKETS)
    assert (grams == whole).all()


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, ["en", None, "fr"] + ["en"] * (len(AWKWARD) - 3))
    model = language_id.train(spark, docs)
    got = language_id.identify(spark, docs, model).toPandas().set_index("doc_id")
    assert len(got) == len(AWKWARD) and list(got.loc[[0, 1, 2, 3]].lang_pred) == ["und"] * 4 and (got.loc[[0, 1, 2, 3]].score == 0).all()
    assert list(got.columns)[:4] == ["text", "lang", "source", "n_chars"]
    nothing = language_id.train(spark, docs.where("false"))
    assert set(language_id.identify(spark, docs, nothing, ["doc_id"]).toPandas().lang_pred) == {"und"}
    assert language_id.identify(spark, docs.where("false"), model).count() == 0


@pytest.mark.parametrize("ids", [[None] * 3000, [5] * 3000, list(range(3000))])
def test_the_sample_is_bounded_with_and_without_ids(spark, monkeypatch, ids):
    real = language_id._count
    docs = documents(spark, [prose(5, k) for k in range(3000)], ids=ids)
    taken = docs.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        def each():
            for batch in batches:
                taken.add(batch.num_rows)
                yield batch

        yield from real(each())

    monkeypatch.setattr(language_id, "_count", counted)
    language_id.train(spark, docs, 100)
    assert 50 <= taken.value <= 160


def test_equal_rows_without_id_are_sampled_too(spark, monkeypatch):
    docs = documents(spark, ["the very same text"] * 3000, ids=[None] * 3000)
    model = language_id.train(spark, docs, 100)
    assert model.langs == ["en"]
