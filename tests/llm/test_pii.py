import re

import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from reedline.llm import pii

CIPHER = pii.Feistel(b"k")
CARD = "4111 1111-1111 1111"
VALUES = ["anna.b42@mail7.example.com", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "161.17.88.162", "2021-02-28", "28/02/2021", "03/04/1999", "1.2.1987", "219-09-9999", CARD, "+1 (487) 555-7209", "+49 30 1234567"]
INVALID = ["4111111111111112", "GB83WEST12345698765432", "300.1.1.1", "2021-02-30", "000-12-3456", "1234567", "v1.2.3.4.5"]


@pytest.mark.parametrize("value", VALUES)
def test_a_value_keeps_its_format_stays_valid_and_comes_back(value):
    text = f"say {value}, then {value}."
    found = pii.find(text, CIPHER)
    assert len(found) == 2 and found[0][3] == found[1][3] != value and text[found[0][1] : found[0][2]] == value
    new = found[0][3]
    shape = lambda s: re.sub(r"\d+" if found[0][0] == "ip" else r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    assert shape(new) == shape(value) or found[0][0] in ("iban", "date")
    again = pii.find(f"say {new}.", CIPHER, back=True)
    assert [a[3] for a in again] == [value]


@pytest.mark.parametrize("value", INVALID)
def test_what_fails_validation_stays(value):
    assert pii.find(f"say {value} now", CIPHER) == []


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 3000), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(n, key):
    cipher = pii.Feistel(key)
    some = range(min(n, 200))
    assert all(cipher.permute(cipher.permute(x, n), n, back=True) == x for x in some)
    if n <= 200:
        assert sorted(cipher.permute(x, n) for x in range(n)) == list(range(n))


def test_documents(spark):
    texts = [f"mail {VALUES[0]} or {CARD}", f"again {VALUES[0]}", "clean text, 12 of 345"] + AWKWARD
    got = pii.pseudonymise(documents(spark, texts), b"secret").toPandas().set_index("doc_id").sort_index()
    assert list(got.n_found[:3]) == [2, 1, 0] and got.n_found[3:].sum() == 0
    assert [got.text[k] for k in range(2, len(texts))] == texts[2:]
    assert VALUES[0] not in got.text[0] and got.text[0].split()[1] == got.text[1].split()[1]
    back = pii.pseudonymise(pii.pseudonymise(documents(spark, texts), b"secret"), b"secret", back=True).toPandas().set_index("doc_id").sort_index()
    assert [back.text[k] for k in range(len(texts))] == texts
    assert pii.pseudonymise(documents(spark, [], parts=1), b"k").count() == 0


def test_personal_data_of_the_table_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[A-Z]{2}\d{2}[A-Z]{4}\d{14}\b")
    before = {r["doc_id"]: seen.findall(r["text"]) for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, b"k").collect()}
    values = [(d, v) for d, found in before.items() for v in found]
    assert len(values) > 20 and not [v for d, v in values if v in after[d]]


BESIDE = [
    ("pay {} 43 ok", "4111111111111111"), ("12 {}", "4111111111111111"), ("{} 123", "4111 1111 1111 1111"), ("1 22 333 {} 123 4", "4111111111111111"),
    ("{} USD", "ES91 2100 0418 4502 0005 1332"), ("ID13 CODE {}", "GB82 WEST 1234 5698 7654 32"), ("at {}T03:04:05Z", "2024-01-02"),
]


@pytest.mark.parametrize("around, value", BESIDE)
def test_a_value_beside_others_goes_and_comes_back(around, value):
    text = around.format(value)
    for key in range(60):
        cipher = pii.Feistel(b"%d" % key)
        ((kind, a, b, new),) = pii.find(text, cipher)
        assert text[a:b] == value != new
        assert [f[1:] for f in pii.find(text[:a] + new + text[b:], cipher, back=True)] == [(a, a + len(new), value)]


def test_a_long_run_of_numbers_comes_back():
    text = " ".join(f"{5500000000000004 if k % 2 else '4111 1111 1111 1111'} {k + 100}" for k in range(60))
    found = pii.find(text, CIPHER)
    assert len(found) == 60
    new = "".join(text[e:a] + v for (_, _, e, _), (_, a, _, v) in zip([("", 0, 0, ""), *found], found)) + text[found[-1][2] :]
    assert "4111 1111 1111 1111" not in new and "5500000000000004" not in new
    assert [f[3] for f in pii.find(new, CIPHER, back=True)] == [text[a:b] for _, a, b, _ in found]


def test_texts_equal_a_plain_replacement(spark):
    """Brute force: texts put together from known values and harmless words, each value replaced by itself."""
    import random

    r = random.Random(4)
    words = ["plain", "words", "and", "3", "of", "v1.2", "mid-2020", "x@y", "1,000", "№5", "ends.", "(so)", *INVALID]
    kinds = dict(zip(VALUES, ["email", "iban", "iban", "ip", "date", "date", "date", "date", "ssn", "card", "phone", "phone"]))
    texts, want = [], []
    for _ in range(300):
        parts, plain, spans = [], [], []
        for _ in range(r.randrange(40)):
            value = r.choice(VALUES) if r.random() < 0.3 else None
            one = value or r.choice(words)
            if value:
                at = sum(len(p) + 4 for p in parts)
                spans.append((kinds[value], at, at + len(value)))
            parts.append(one)
            plain.append(pii.KINDS[kinds[value]][1](CIPHER, value, False) if value else one)
        texts.append("".join(p + " ok " for p in parts))
        want.append(("".join(p + " ok " for p in plain), spans))
    got = pii.pseudonymise(documents(spark, texts), b"k").collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.text == want[row.doc_id][0]
        assert [(f.kind, f.start, f.end) for f in row.found] == want[row.doc_id][1] and row.n_found == len(row.found)


@pytest.mark.parametrize("part", ["161.17.88.162 ", "4111 1111 1111 1111 42 ", "GB82 WEST 1234 5698 7654 32 ", "%a", "a@b.", "a.b-c+d@", "12-34-", "1 2 "])
def test_time_follows_the_length(part):
    import time

    spent = []
    for size in (40_000, 320_000):
        start = time.perf_counter()
        pii.find("@ " + part * (size // len(part)), CIPHER)
        spent.append(time.perf_counter() - start)
    assert spent[1] < 24 * spent[0] + 0.5


def test_a_local_part_of_65_characters_is_no_address():
    assert len(pii.find("a" * 64 + "@example.com", CIPHER)) == 1
    assert pii.find("a" * 65 + "@example.com", CIPHER) == []
