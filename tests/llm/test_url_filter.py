from datetime import date

from reedline.llm import url_filter

ENTRIES = "key string, verdict string, listed date"
CAPTURES = "page_id long, url string, fetched date"


def day(n):
    return date(2024, 1, n)


def test_entries_count_from_their_date_until_the_next(spark):
    entries = spark.createDataFrame(
        [("d:b.org", "block", day(5)), ("d:b.org", None, day(10)), ("d:b.org", "allow", day(20)), ("p:a.b.org/x", "allow", day(6)), ("d:b.org", None, day(5)), (None, "block", day(1)), ("d:c.org", "block", None)],
        ENTRIES,
    )
    rows = [(k, "http://u:p@A.B.org.:80/y/z?x", day(k)) for k in range(1, 31)] + [(99, "https://a.b.org/x/y#d", day(7)), (100, None, day(7)), (101, "nothing", day(7)), (102, "http://c.org", None), (102, "http://c.org", None)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, CAPTURES), entries).toPandas()
    assert len(got) == len(rows)
    verdict = got.drop_duplicates("page_id").set_index("page_id").verdict
    assert [verdict[k] for k in (4, 5, 9, 10, 19, 20, 30)] == ["none", "block", "block", "none", "none", "allow", "allow"]
    assert verdict[99] == "allow" and got.set_index("page_id").n_active[99] == 2
    assert list(verdict[[100, 101, 102]]) == ["none"] * 3
    assert set(got[got.page_id == 5].host) == {"a.b.org"}


def test_no_rows(spark):
    none = spark.createDataFrame([], ENTRIES)
    assert url_filter.filter_urls(spark.createDataFrame([], CAPTURES), none).count() == 0
    got = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.b/c", day(1))], CAPTURES), none).collect()
    assert len(got) == 1 and got[0]["verdict"] == "none"


def test_very_long_urls_and_columns_of_the_same_names(spark):
    entries = spark.createDataFrame([("d:b.org", "block", day(5), 1), ("p:b.org/s/s", "allow", day(6), 2)], ENTRIES + ", salt int")
    rows = [(1, "http://b.org/" + "s/" * 200_000, day(7), "x", 9), (2, "http://" + "a." * 50_000 + "b.org/t", day(7), "y", 9), (3, "http://c/" + "z" * 1_000_000, day(7), "z", 9)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, CAPTURES + ", key string, copies int"), entries).select("page_id", "verdict", "key", "n_active").collect()
    assert sorted(map(tuple, got)) == [(1, "allow", "p:b.org/s/s", 2), (2, "block", "d:b.org", 1), (3, "none", None, 0)]


def test_equals_a_plain_search(spark):
    import random

    r = random.Random(2)
    hosts = ["a.b.org", "b.org", "x.a.b.org", "c.net", "org"]
    lists = [(f"d:{r.choice(hosts)}" if r.random() < 0.5 else f"p:{r.choice(hosts)}/{r.choice('xy')}", r.choice(["block", "allow", None]), day(r.randrange(1, 28))) for _ in range(60)]
    rows = [(k, f"http://{r.choice(hosts)}/{'/'.join(r.choices('xy', k=r.randrange(3)))}", day(r.randrange(1, 30))) for k in range(400)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(lists, ENTRIES)).collect()
    for g in got:
        _, url, fetched = rows[g.page_id]
        host, _, path = url.removeprefix("http://").partition("/")
        active = []
        for key in {k for k, _, _ in lists}:
            name = key[2:]
            fits = host == name or host.endswith("." + name) if key[0] == "d" else (host + "/" + path + "/").startswith(name + "/")
            dated = [(d, v or "") for k, v, d in lists if k == key and d <= fetched]
            if fits and dated and max(dated)[1]:
                active.append((len(key), key, max(dated)[1]))
        best = max(active, default=(0, None, "none"))
        assert (g.key, g.verdict, g.n_active) == (best[1], best[2], len(active))
    assert len(got) == len(rows)
