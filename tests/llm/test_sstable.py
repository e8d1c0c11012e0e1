import io
import zlib

import numpy as np
import public_tokenizers
from helpers import AWKWARD, documents, prose
from tokenizers import Tokenizer

from reedline.llm import sstable

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_equals_the_library(spark):
    texts = [prose(k % 30, k) for k in range(200)] + AWKWARD + ["<|endoftext|> it's"]
    rows, folder = sstable.token_table(spark, documents(spark, texts, ids=[3 * k - 90 for k in range(len(texts))]), PATH, shard_rows=40)
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    for r, text in zip(rows.orderBy("doc_id").collect(), texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        found = sstable.lookup(folder, r["shard"], r["doc_id"])
        assert [list(x) for x in found] == [ids]
        assert sstable.lookup(folder, r["shard"], r["doc_id"] + 1) == []
        start += len(ids)


def test_blocks_filter_and_repeated_keys():
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, 4, block_bytes=64)
    keys = [sstable.key_of(k) for k in (None, -5, 0, *[7] * 40, 2**62)]
    for k, key in enumerate(keys):
        writer.add(key, bytes([k]) * 8)
    writer.close()
    reader = sstable.ShardReader(out, len(out.getvalue()))
    assert [k for k, _ in reader] == keys and reader.entries == len(keys) and len(reader.blocks) > 5
    assert len(reader.lookup(sstable.key_of(7))) == 40 and len(reader.lookup(b"")) == 1
    assert sum(reader.may_hold(sstable.key_of(k)) for k in range(1000, 2000)) < 50
    assert [sstable.id_of(sstable.key_of(x)) for x in (None, -(2**63), 2**63 - 1)] == [None, -(2**63), 2**63 - 1]


def test_no_rows_and_repeated_rows(spark):
    assert sstable.token_table(spark, documents(spark, [], parts=1), PATH)[0].count() == 0
    got = sstable.token_table(spark, documents(spark, ["b", "a", "b", "c"], ids=[2, 2, 2, None]), PATH)[0].toPandas()
    assert list(got.sort_values("start").doc_id.fillna(-1)) == [-1, 2, 2, 2] and got.n_tokens.sum() == 8


def test_chunk_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from reedline.llm.sstable import ChunkIds

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["it's We'LL x'' o'", "İstanbul Straße, Éa. éa É.", "a×b ÷ ǅab ŉx ªº", "a.b ... (x) wow!!!*** a-b a_b_ _", "x<|endoftext|> <|startoftext|>", "Σας ΑΣ 日本 x1 12,  y z", "It's it's IT, it, It"]
    known = ChunkIds(tokenizer, 2)
    for text in texts:
        chunks = text.split(" ")
        known.learn(list(set(chunks).difference(known)))
        assert b"".join(known[c] for c in chunks) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text


def test_an_id_of_many_rows_gets_several_shards(spark):
    texts = [prose(5 + k % 7, k) for k in range(600)]
    ids = [None if k % 3 == 0 else 50 if k % 3 == 1 else k for k in range(600)]
    rows, folder = sstable.token_table(spark, documents(spark, texts, ids=ids), PATH, shard_rows=30)
    got = rows.toPandas().sort_values("start")
    assert len(got) == 600 and list(got.start) == [0, *got.n_tokens.cumsum()[:-1]]
    keys = got.doc_id.fillna(-1)
    assert keys.is_monotonic_increasing and got[keys == -1].shard.nunique() > 3 and got[keys == 50].shard.nunique() > 3
    assert got.groupby("shard").size().max() < 120
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(zlib.crc32(np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for t in texts)
    assert sorted(got.ids_crc32) == want


def test_other_tokenizers_are_refused():
    import pytest

    with pytest.raises(ValueError):
        sstable.checked_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_texts_equal_the_library():
    import random

    import pyarrow as pa

    r = random.Random(8)
    pieces = ["it's", "We'LL", "Straße,", "日本", "x1", "(so)", "<|endoftext|>", "a\u00a0b", "\x0b", "\x0c", "\t", "\n", "  ", "...", "É.", "\u2003", "№5", "\x1c", "\x85", "c\u200bd", "ſ", "İx"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", " "]) for _ in range(r.randrange(30))) for _ in range(400)] + [None, "", " ", prose(50, 1)]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u2").tobytes() for t in texts]
    known = sstable.ChunkIds(tokenizer, 2)
    assert sstable._encoded(known, pa.array(texts), 2, b"\x01\x00") == want
    assert sstable._encoded(known, pa.array(["x", *texts]).slice(1), 2, b"\x01\x00") == want


def test_very_long_texts_are_cut_at_blanks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sstable, "SLICE_BYTES", 100)
    tokenizer = Tokenizer.from_file(PATH)
    for text in (prose(300, 2), "w" * 500, "w" * 150 + " " + prose(40, 3), " " * 450):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u2").tobytes()
        assert sstable._encoded(sstable.ChunkIds(tokenizer, 2), pa.array([text]), 2, b"\x01\x00") == [want]
