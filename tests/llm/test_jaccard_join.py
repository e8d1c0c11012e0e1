import random
import re

import pytest
from helpers import AWKWARD, documents, prose

from reedline.llm import jaccard_join
from reedline.llm.components import components


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    links = {i: set() for i in range(len(texts))}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= least * len(a | b) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        out[i] = (min(seen), len(links[i]))
    return out


def near_copies(n, words, base_seed, changes):
    r = random.Random(base_seed)
    base = prose(words, base_seed).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(changes + 1)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def texts():
    shared = prose(60, 5)
    out = near_copies(90, 120, 1, 3) + near_copies(12, 40, 2, 1) + near_copies(50, 300, 3, 12)
    out += [f"{prose(30, 1000 + k)} {shared} {prose(30, 2000 + k)}" for k in range(60)] + AWKWARD
    out += [prose(80, 3000 + k) for k in range(100)]
    random.Random(4).shuffle(out)
    return out


@pytest.mark.parametrize("block_sets", [1024, 20])
def test_equals_brute_force(spark, block_sets):
    rows = texts()
    got = jaccard_join.near_duplicates(spark, documents(spark, rows), block_sets=block_sets).toPandas()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.itertuples()} == brute(rows)
    assert len(got) == len(rows)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = jaccard_join.near_duplicates(spark, docs).toPandas()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.itertuples()} == brute(rows)


def test_awkward_rows(spark):
    assert jaccard_join.near_duplicates(spark, documents(spark, [], parts=1)).count() == 0
    same = prose(20, 8)
    got = jaccard_join.near_duplicates(spark, documents(spark, [same, same, same, None, "x"], ids=[9, 9, None, None, 4])).toPandas()
    found = sorted(((None if i != i else i, None if c != c else c, n) for i, c, n in got[["doc_id", "class_id", "n_links"]].itertuples(index=False)), key=repr)
    assert found == sorted([(9, 9, 2), (9, 9, 2), (None, 9, 2), (None, None, 0), (4, 4, 0)], key=repr)


@pytest.mark.parametrize("block_sets", [1024, 20])
def test_repeated_and_missing_ids_are_documents_like_others(spark, block_sets):
    rows = texts()
    r = random.Random(9)
    ids = [None if r.random() < 0.3 else r.randrange(40) for _ in rows]
    got = jaccard_join.near_duplicates(spark, documents(spark, rows, ids=ids), block_sets=block_sets).collect()
    places = brute(rows)
    least = {}
    for k, i in enumerate(ids):
        root = places[k][0]
        least[root] = min([x for x in (least.get(root), i) if x is not None], default=None)
    want = [(i, least[places[k][0]] if shingles(rows[k]) else i, places[k][1]) for k, i in enumerate(ids)]
    assert sorted(((x.doc_id, x.class_id, x.n_links) for x in got), key=repr) == sorted(want, key=repr)


def test_recall_of_ten_thousand_links_at_the_threshold(spark):
    """Pairs of sets with a Jaccard similarity of 33/41 to 34/41, that is 0.80 to 0.83, and no other links."""
    out = []
    for k in range(10_000):
        words = [f"p{k}x{i}" for i in range(45)]
        out += [" ".join(words), " ".join(words[: 37 + k % 2])]
    got = jaccard_join.near_duplicates(spark, documents(spark, out, parts=8))
    found = got.where("n_links > 0").count() / len(out)
    print("recall", found)
    assert found >= 0.99 and got.where("n_links > 1").isEmpty()
    assert got.where("class_id <> doc_id - doc_id % 2 and n_links > 0").isEmpty()


def deep_texts(pairs, others, shared=400, own=300):
    """Documents that share most of their words, so that buckets stay large for levels: pairs of near copies (Jaccard 0.8 to 0.85), and others without a partner."""
    block = [f"s{i}" for i in range(shared)]
    out = []
    for k in range(pairs + others):
        words = block + [f"d{k}x{i}" for i in range(own)]
        out.append(" ".join(words))
        if k < pairs:
            out.append(" ".join([*words[: len(words) - 100 - k % 15], *[f"e{k}x{i}" for i in range(30)]]))
    return out


def test_links_inside_deep_buckets(spark):
    """Any two share 396 of about 1,100 shingles: no link, but a bucket of all."""
    rows = deep_texts(300, 400)
    got = jaccard_join.near_duplicates(spark, documents(spark, rows, parts=8))
    found = {r.doc_id: (r.class_id, r.n_links) for r in got.collect()}
    want = brute_pairs(300, 400)
    hit = sum(found[i] == w for i, w in want.items())
    assert hit >= 0.99 * len(rows) and all(found[i] in (w, (i, 0)) for i, w in want.items())


def brute_pairs(pairs, others):
    out = {i: (i - i % 2, 1) for i in range(2 * pairs)}
    return out | {i: (i, 0) for i in range(2 * pairs, 2 * pairs + others)}


def test_deep_buckets_give_no_large_groups(spark):
    from reedline.llm.common import stored

    rows = deep_texts(50, 900)
    signed = jaccard_join.signatures(documents(spark, rows, parts=8))
    sketch = jaccard_join.F.concat(*[jaccard_join.F.substring("sig", 4 * k + 1, 1) for k in range(jaccard_join.COORDINATES)])
    reps = stored(spark, signed.select(jaccard_join.F.col("doc_id").alias("rep"), "sig", sketch.alias("sketch")), "sets")
    groups = components(spark, jaccard_join.candidate_links(spark, reps, 0.8, 0.9999)).groupBy("root").count().toPandas()
    assert 45 <= len(groups) and groups["count"].max() <= 20


def test_runs_reach_the_target():
    assert jaccard_join.runs_for(0.9999, 0.8, 1) < jaccard_join.runs_for(0.9999, 0.8, 4) <= 16


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(r.randrange(50), r.randrange(50)) for _ in range(20)] + [(3, 3), (None, 4)]
    got = {x["node"]: x["root"] for x in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        if u is not None and u != v:
            root.setdefault(u, u), root.setdefault(v, v)
    for _ in range(200):
        for u, v in edges:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def tables_of(run):
    """What a call returns, and the names of the tables that it stores."""
    from reedline.sources import shared

    tables, stored = [], shared.stored
    shared.stored = lambda df, name: tables.append(name) or stored(df, name)
    try:
        return run(), tables
    finally:
        shared.stored = stored


def test_components_of_long_chains_and_hubs_take_few_steps(spark):
    """Stars whose centers are linked in a row: the steps are few, however long the row is."""
    edges = [(1000 * k, 1000 * (k + 1)) for k in range(60)] + [(1000 * k, 1000 * k + j) for k in range(61) for j in range(1, 200)]
    random.Random(5).shuffle(edges)
    got, tables = tables_of(lambda: components(spark, spark.createDataFrame(edges, "u long, v long").repartition(40)).collect())
    assert {x["root"] for x in got} == {0} and len(got) == len({n for e in edges for n in e})
    assert len(tables) <= 5


def test_a_level_of_the_recursion_stores_two_tables(spark):
    """A level is one aggregation and one join, and a count of the far members; buckets of up to SMALL sets make no level."""
    from reedline.llm.common import stored

    signed = jaccard_join.signatures(documents(spark, deep_texts(50, 1900), parts=8))
    sets = stored(spark, signed.select(jaccard_join.F.col("doc_id").alias("rep"), "sig"), "sets")
    (ends, _, depth), tables = tables_of(lambda: jaccard_join._descend(spark, sets, 0.8, range(4)))
    assert depth > 1 and len(tables) <= 2 + 2 * depth
    few = sets.where("rep < 700")
    (_, deep, depth), tables = tables_of(lambda: jaccard_join._descend(spark, few, 0.8, range(4)))
    assert (deep, depth, len(tables)) == (None, 1, 1)


def test_links_inside_buckets_of_several_levels(spark):
    """As in test_links_inside_deep_buckets, with more sets than are compared at once."""
    rows = deep_texts(300, 1500)
    assert len(rows) > 2 * jaccard_join.SMALL
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark, documents(spark, rows, parts=8)).collect()}
    want = brute_pairs(300, 1500)
    hit = sum(found[i] == w for i, w in want.items() if w[1])
    assert hit >= 0.99 * 600 and all(found[i] in (w, (i, 0)) for i, w in want.items())
