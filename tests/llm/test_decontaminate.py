import random

import numpy as np
from helpers import AWKWARD, documents, prose

from reedline.llm import decontaminate


def edited(text, share, seed):
    r = random.Random(seed)
    out = []
    for w in text.split():
        x = r.random()
        out += [] if x < share / 3 else [f"other{r.randrange(10**6)}"] if x < 2 * share / 3 else [w, f"more{r.randrange(10**6)}"] if x < share else [w]
    return " ".join(out)


def full_table(item, window):
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        item, window = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        assert decontaminate.align(item, window)[0] == full_table(item, window)


def test_copies_and_edited_copies_are_found_and_nothing_else(spark):
    items = [prose(15 + 5 * k, 500 + k) for k in range(12)]
    clean = [prose(200, 900 + k) for k in range(40)]
    texts, want = list(clean) + AWKWARD, set()
    for k, item in enumerate(items):
        for copy in (item, edited(item, 0.15, k), item.upper().replace(" ", "  ")):
            want.add((len(texts), k))
            texts.append(f"{prose(50, 7000 + len(texts))} {copy} {prose(50, 8000 + len(texts))}")
    # one item leaked into very many documents
    for _ in range(200):
        want.add((len(texts), 3))
        texts.append(f"{prose(20, 9000 + len(texts))} {items[3]}")
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, "two words"), (None, items[0]), (102, "")], "item_id long, text string")
    for block_words in (10**6, 60):
        got = decontaminate.contaminated(spark, documents(spark, texts), bench, block_words=block_words).toPandas()
        assert set(zip(got.doc_id, got.item_id)) == want and len(got) == len(want)
    whole = got[got.score == 1]
    for r in whole.itertuples():
        words = decontaminate.WORD.findall(texts[r.doc_id].lower())
        assert " ".join(words[r.first_word : r.last_word]) == items[r.item_id]


def test_no_rows(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark, documents(spark, ["a b c d"], parts=1), bench).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontaminate.contaminated(spark, documents(spark, [], parts=1), one).count() == 0
    assert decontaminate.contaminated(spark, documents(spark, ["a b c d", "a b c d"], ids=[1, 1]), one).count() == 2


def brute(texts, items, threshold=0.5):
    """Every document against every item, over the whole text, without seeds or blocks."""
    out = set()
    for d, text in enumerate(texts):
        words = decontaminate.WORD.findall((text or "").lower())
        for i, item in items:
            wanted = decontaminate.WORD.findall((item or "").lower())
            number = {w: k for k, w in enumerate(dict.fromkeys(wanted), 1)}
            if not wanted:
                continue
            best = decontaminate.align(np.array([number[w] for w in wanted]), np.array([number.get(w, 0) for w in words], int))[0]
            if best >= decontaminate._least_score(len(wanted), threshold):
                out.add((d, i, round(best / (2 * len(wanted)), 6)))
    return out


def test_equals_brute_force_over_all_pairs(spark):
    long = prose(400, 77, 100_000)
    items = [(f"i{k}", prose(12 + 7 * k, 600 + k, 100_000)) for k in range(10)] + [("long", long), ("one", "onlyword"), ("two", "twin words"), ("five", "fa fb fc fd fe"), ("four", "ga gb gc gd")]
    r = random.Random(1)
    texts = AWKWARD[:5] + [prose(150, 40 + k, 100_000) for k in range(30)]
    for k, (_, item) in enumerate(items):
        for share in (0, 0.1, 0.2, 0.3):
            texts.append(f"{prose(40, 300 + k, 100_000)} {edited(item, share, k) if len(item) > 20 else item} {prose(40, 350 + k, 100_000)}")
    words = long.split()
    texts += [f"pre {' '.join(words[a : a + n])} post" for a, n in ((0, 49), (100, 50), (310, 90), (5, 190))]
    texts += ["xx fa fb q fd fe yy", "fa q fb q fc q fd q fe", "fa fb q fc fd q fe", "ga gb x gc gd", "ga gb", "twin q words", "words twin", "so Twin WORDS."]
    texts += [" ".join(w for k, x in enumerate(items[3][1].split()) for w in ([x, f"in{k}"] if k % 2 else [x]))]
    r.shuffle(texts)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute(texts, items)
    for block_words in (10**6, 100):
        got = {(x.doc_id, x.item_id, round(x.score, 6)) for x in decontaminate.contaminated(spark, documents(spark, texts), bench, block_words=block_words).collect()}
        assert got == want
    assert {x[1] for x in want} >= {i for i, _ in items}
    some = decontaminate.contaminated(spark, documents(spark, texts), bench, least_words=3).collect()
    assert {x.item_id for x in some} == {x[1] for x in want} - {"one", "two"}


def test_a_very_long_text_is_read_to_its_end(spark):
    text = prose(300_000, 5, 50_000)
    bench = spark.createDataFrame([(1, "quite unlikely words of a test item here")], "item_id long, text string")
    got = decontaminate.contaminated(spark, documents(spark, [text + " quite unlikely words of a test item here", text]), bench).collect()
    assert [(x.doc_id, x.score, x.first_word) for x in got] == [(0, 1.0, 300_000)]


def test_the_exact_path_finds_items_without_two_words_side_by_side(spark):
    items = [(k, prose(12 + k, 600 + k, 300)) for k in range(8)]  # a small vocabulary: words of items are everywhere
    r = random.Random(2)
    texts = [prose(80, 40 + k, 300) for k in range(25)] + AWKWARD[:6]
    for _, item in items:
        words = item.split()
        texts.append(" ".join(w for k, x in enumerate(words) for w in ([x, f"in{k}"])))
        texts.append(" ".join(f"other{k}" if k % 3 == 2 else w for k, w in enumerate(words)))
    r.shuffle(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for hits in (decontaminate.HITS, 50):
        decontaminate.HITS, before = hits, decontaminate.HITS
        try:
            got = {(x.doc_id, x.item_id, round(x.score, 6)) for x in decontaminate.contaminated(spark, documents(spark, texts), bench, exact=True).collect()}
        finally:
            decontaminate.HITS = before
        assert got == want and len(want) >= 16


def test_a_text_full_of_seeds_takes_little_time(spark):
    import time

    items = [(k, prose(30, k, 200)) for k in range(63)]
    block = decontaminate._items([(i, t.split()) for i, t in items], True)
    text = prose(20_000, 5, 240)
    began = time.time()
    spans = decontaminate._spans(block, block.numbers(text), True)
    assert len(spans) and time.time() - began < 10
