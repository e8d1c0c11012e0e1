import random

import public_tokenizers
import pytest
from helpers import AWKWARD, documents, prose
from tokenizers import Tokenizer

from reedline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(got, sizes, lengths):
    assert sorted(set(got.doc_id)) == sorted(sizes)
    for doc_id, part in got.sort_values("piece").groupby("doc_id"):
        assert part.length.sum() == sizes[doc_id] and list(part.start) == [sum(part.length[:k]) for k in range(len(part))]
    for _, part in got.groupby("bin_id"):
        part = part.sort_values("bin_offset")
        assert list(part.bin_offset) == [sum(part.length[:k]) for k in range(len(part))]
        used = part.length.sum()
        assert (part.bin_used == used).all() and (part.bin_length == min(c for c in lengths if c >= used)).all()


def test_every_token_is_packed_once(spark):
    texts = [prose(random.Random(k).randrange(1, 900), k) for k in range(300)] + AWKWARD
    got = packing.pack_documents(spark, documents(spark, texts), PATH, group_pieces=60).toPandas()
    check(got, {i: len(ids_of(t)) for i, t in enumerate(texts)}, packing.LENGTHS)
    assert got.length.sum() / got.drop_duplicates("bin_id").bin_length.sum() > 0.9


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_a_plain_search(seed):
    r = random.Random(seed)
    sizes = sorted((r.randrange(1, 65) for _ in range(200)), reverse=True)
    where, used, opened = packing._fit(sizes, (16, 32, 64), lambda c: c)
    free = []
    for size, b in zip(sizes, where):
        fits = [x for x in free if x >= size]
        if fits:
            left = min(fits)
            free.remove(left)
        else:
            left = min(c for c in (16, 32, 64) if c >= size)
        free.append(left - size)
    assert sorted(free) == sorted(o - u for o, u in zip(opened, used))
    costs = []
    for some in ((64,), (16, 64), (32, 64), (16, 32, 64)):
        _, u, _ = packing._fit(sizes, some, lambda c: c + 4)
        costs.append(sum(min(c for c in (16, 32, 64) if c >= x) + 4 for x in u))
    _, used, final = packing.pack_sizes(sizes, (16, 32, 64), 4)
    assert sum(final) + 4 * len(final) == min(costs)


def test_no_rows_and_repeated_rows(spark):
    assert packing.pack_documents(spark, documents(spark, [], parts=1), PATH).count() == 0
    got = packing.pack_documents(spark, documents(spark, ["a b", "a b", None], ids=[1, 1, None]), PATH).toPandas()
    assert sorted(got.length) == [1, 3, 3] and got.bin_used.iloc[0] == 7


def test_groups_follow_pieces_not_documents(spark):
    sizes = spark.createDataFrame([(0, 4096 * 400), (1, 4096 * 400), (2, None), (3, 0)], "doc_id long, tokens long")
    got = packing.best_fit_pack(spark, sizes, group_pieces=50).toPandas()
    groups = got.groupby(got.bin_id // 2**32).size()
    assert len(got) == 800 and len(groups) > 8 and groups.max() < 150
    check(got, {0: 4096 * 400, 1: 4096 * 400}, packing.LENGTHS)


def test_sequences_hold_every_token_once_in_order(spark):
    texts = [prose(random.Random(k).randrange(1, 90), k) for k in range(40)] + ["", None, "same", "same"]
    ids = [*range(40), None, None, 7, 7]
    got = packing.token_sequences(spark, documents(spark, texts, ids=ids), PATH, (16, 32, 64), 4, 30).collect()
    found = []
    for row in got:
        assert len(row.ids) <= row.bin_length and sum(p.length for p in row.pieces) == len(row.ids)
        at = 0
        for p in row.pieces:
            found.append((p.doc_id, p.start, tuple(row.ids[at : at + p.length])))
            at += p.length
    want = [(i, k, tuple(ids_of(t)[k : k + 64])) for i, t in zip(ids, texts) for k in range(0, len(ids_of(t)), 64)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_a_bin_of_least_cost_is_opened():
    costs = {16: 30, 32: 20, 64: 100}
    where, used, opened = packing._fit([40, 10, 9, 30], (16, 32, 64), costs.get)
    assert opened == [64, 32] and used == [50, 39] or opened[0] == 64 and 32 in opened and 16 not in opened
    assert packing.pack_sizes([10, 9], (16, 32, 64), cost=costs.get)[2] == [32]
    many = tuple(range(8, 129, 10))
    r = random.Random(1)
    sizes = sorted((r.randrange(1, 120) for _ in range(100)), reverse=True)
    _, used, final = packing.pack_sizes(sizes, many)
    assert sum(used) == sum(sizes) and all(f == min(c for c in many if c >= u) for u, f in zip(used, final))
