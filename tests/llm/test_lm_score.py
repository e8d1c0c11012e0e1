import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents

from reedline.llm import lm_score


def plain(texts, ids, good, counted=None):
    """Both losses and the score of every text by plain counting, each text's own words left out."""

    def counts(rows):
        one, two, starts = Counter(), Counter(), 0
        for words in rows:
            one.update(words)
            two.update(zip([None, *words], words))
            starts += bool(words)
        return one, two, starts

    words = [t.lower().split() if t else [] for t in texts]
    counted = counted or [True] * len(texts)
    flags = {"background": counted, "target": [c and i in good for c, i in zip(counted, ids)]}
    models = {m: counts([w for w, f in zip(words, flags[m]) if f]) for m in flags}
    out = []
    for k, row in enumerate(words):
        losses = {}
        for m, (one, two, starts) in models.items():
            mine_one, mine_two, mine_starts = counts([row] if flags[m][k] else [])
            n = sum(one.values()) - sum(mine_one.values())
            total = 0.0
            for a, b in zip([None, *row], row):
                p1 = (one[b] - mine_one[b] + lm_score.PRIOR_WORDS / lm_score.OPEN_WORDS) / (n + lm_score.PRIOR_WORDS)
                before = starts - mine_starts if a is None else one[a] - mine_one[a]
                total -= math.log((two[a, b] - mine_two[a, b] + lm_score.PRIOR_PAIRS * p1) / (before + lm_score.PRIOR_PAIRS))
            losses[m] = total / len(row) if row else None
        out.append((ids[k], len(row), losses["target"], losses["background"]))
    return out


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.loss_target, r.loss_background) for r in df.collect()), key=repr)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


@pytest.mark.parametrize("block_bytes", [1, 60, 1 << 20])
def test_losses_equal_a_plain_model(spark, block_bytes):
    texts = ["the cat sat on the mat", "a dog sat on a log", "the dog", "rare words only once", None, "", "the the the the"] * 3
    ids = [*range(len(texts) - 3), 0, 1, None]
    good = {0, 4, 8, 12, 99}
    target = spark.createDataFrame([(g,) for g in sorted(good)] + [(None,)], "doc_id long")
    got = lm_score.cross_entropy_difference(spark, documents(spark, texts, ids=ids), target, block_bytes=block_bytes, part_bytes=50)
    same(rows(got), plain(texts, ids, good))
    assert all(r.score is None or r.score == pytest.approx(r.loss_target - r.loss_background) for r in got.collect())


def test_every_word_and_pair_counts_as_itself(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(70_000)}" for _ in range(600)) for _ in range(250)] + ["often seen words"] * 50 + ["x"] * 3
    others = ["never seen w1 w2", "often seen words"]
    ids, more = list(range(len(texts))), [5000, 5001]
    target = spark.createDataFrame([(i,) for i in ids[::2]], "doc_id long")
    got = lm_score.cross_entropy_difference(spark, documents(spark, texts), target, documents(spark, others, ids=more), block_bytes=200_000, part_bytes=300_000)
    same(rows(got), plain(texts + others, ids + more, set(ids[::2]), [True] * len(texts) + [False] * 2))


def test_target_documents_are_not_known_by_heart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").orderBy("doc_id").collect()]
    half = spark.createDataFrame([(g,) for g in good[::2]], "doc_id long")
    got = lm_score.cross_entropy_difference(spark, docs, half).toPandas().set_index("doc_id").score
    seen, unseen = got.reindex(good[::2]).dropna(), got.reindex(good[1::2]).dropna()
    assert abs(np.median(seen) - np.median(unseen)) < 0.3


def test_target_like_texts_score_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_score.cross_entropy_difference(spark, docs, docs.where("lang = 'fr' and doc_id % 2 = 0")).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").toPandas()
    assert got[got.lang == "fr"].score.mean() < got[got.lang != "fr"].score.mean() - 0.5


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    got = lm_score.cross_entropy_difference(spark, docs, docs.where("false")).toPandas().set_index("doc_id").sort_index()
    assert len(got) == len(AWKWARD) and list(got.n_words[:4]) == [0] * 4 and got.score[:4].isna().all() and got.score[4:].notna().all()
    empty = documents(spark, [], parts=1)
    assert lm_score.cross_entropy_difference(spark, empty, empty).count() == 0
