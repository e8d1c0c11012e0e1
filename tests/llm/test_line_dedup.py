import random

import numpy as np
import pytest
from helpers import AWKWARD, documents, prose

from reedline.llm import line_dedup

BLANK = " \t\n\r\x0b\x0c"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(ids, texts, least=3, length=20):
    holders = {}
    for i, text in zip(ids, texts):
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= length:
                holders.setdefault(key_of(line), set()).add(line_dedup.NOBODY if i is None else i)
    out = []
    for i, text in zip(ids, texts):
        every = (text or "").split("\n")
        me = line_dedup.NOBODY if i is None else i
        kept = [x for x in every if not (len(held := holders.get(key_of(x), ())) >= least and max(held) != me)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(spark, texts, ids=None, **more):
    rows = line_dedup.dedup_lines(spark, documents(spark, texts, ids=ids, parts=3 if texts else 1), **more).collect()
    return sorted((tuple(r) for r in rows), key=repr)


SHARED = ["A line that Very many documents hold", "zwölf Größen: ÄÖÜ äöü sind ungleich", " " * 20, "x" * 19, "ß" * 19, "ß" * 20, "  \x0b\x0cTwenty letters exactly\r"]


@pytest.mark.parametrize("sizes", [{}, {"shard_lines": 7, "probes": 5}])
def test_equals_brute_force_with_a_line_in_most_documents(spark, sizes):
    r = random.Random(5)
    texts = [*AWKWARD, None, "\n\n\n", "\n".join(SHARED * 3)]
    for k in range(80):
        lines = [prose(r.randrange(1, 8), r.randrange(40), 50) for _ in range(r.randrange(6))] + r.sample(SHARED, r.randrange(len(SHARED)))
        lines += [SHARED[0].upper()] * (k % 3 > 0)
        r.shuffle(lines)
        texts.append("\n".join(lines))
    want = brute(range(len(texts)), texts)
    assert got(spark, texts, **sizes) == want and sum(row[2] for row in want) > 100


def test_repeated_rows_missing_ids_and_no_rows(spark):
    line = "one line of more than twenty letters"
    texts, ids = [line, line, line, f"{line}\nb", line, f"a\n{line}"], [4, 4, None, None, 7, 2]
    assert got(spark, texts, ids) == brute(ids, texts)
    # two documents, however many rows
    assert all(row[2] == 0 for row in got(spark, [line] * 6, [4, 4, 4, None, None, None]))
    assert got(spark, []) == []


def test_other_thresholds(spark):
    texts = ["short\nline", "SHORT\nx", "y"]
    assert got(spark, texts, least_documents=2, least_length=5) == brute(range(3), texts, 2, 5)
    assert got(spark, texts, least_documents=1, least_length=1) == brute(range(3), texts, 1, 1)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark, documents(spark, texts), least_documents=70_000)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 30_000])
def test_perfect_hash_is_minimal_and_small(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    hi[: n // 2] = 5  # half of the keys differ in one half only
    levels = line_dedup.perfect_hash(hi, lo)
    assert sorted(line_dedup.numbers(levels, hi, lo).tolist()) == list(range(n))
    assert sum(size for size, _, _ in levels) <= 4 * n + 64 * 20
    other = line_dedup.numbers(levels, hi + np.uint64(1), lo)
    assert len(other) == n and other.max(initial=-1) < max(n, 1)
