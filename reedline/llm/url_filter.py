"""URL filtering by lists that change over time: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The rows of a key are dealt over so many tasks where they meet its entries, which are copied to each.
SALTS = 16
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: str | Column) -> Column:
    """The lower-cased host of a URL, without user, port and final dot; '' where there is none."""
    raw = F.regexp_extract(url, _AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(raw, r"^.*@", ""), r"\.?(:\d*)?$", ""))


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_keys(url: str | Column, labels: int | None = None, steps: int | None = None) -> Column:
    """All list keys a URL can match: 'd:' and each suffix of its host's labels, 'p:' and host with each leading part of its path.

    With limits, only keys of at most so many labels or path steps: what no list names need not be made of a very long URL.
    """
    host, path = host_of(url), path_of(url)
    parts = F.split(host, r"\.")
    count = F.size(parts)
    first = F.lit(1) if labels is None else F.greatest(F.lit(1), count - labels + 1)
    spans = F.when(first <= count, F.sequence(first, count)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(spans, lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, i, count - i + 1), ".")))
    some = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.size(some) if steps is None else F.least(F.size(some), F.lit(steps))
    deep = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(deep, lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(some, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def _limits(entries: DataFrame) -> tuple[int, int]:
    """The most labels of a domain key and the most steps of a path key in the lists."""

    def most(start: str, sign: str) -> Column:
        count = F.length("key") - F.length(F.translate("key", sign, ""))
        return F.coalesce(F.max(F.when(F.col("key").startswith(start), count)), F.lit(-1))

    row = entries.agg(most("d:", ".").alias("labels"), most("p:", "/").alias("steps")).first()
    return row["labels"] + 1, max(0, row["steps"])


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (key, verdict, listed) to intervals (key, verdict, valid_from, valid_to): from an entry's date until the key's next.

    verdict null takes the key off the list. Of entries with the same key and date the verdict last in order counts, a null least. valid_to
    is null for the last. Rows without key or date are passed over.
    """
    known = entries.where("key is not null and listed is not null").groupBy("key", "listed").agg(F.max("verdict").alias("verdict"))
    until = F.lead("listed").over(W.partitionBy("key").orderBy("listed"))
    dated = known.select("key", "verdict", F.col("listed").alias("valid_from"), until.alias("valid_to"))
    return dated.where("verdict is not null")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture (page_id, url, fetched) with the list entry that held when it was fetched.

    Returns page_id, url, fetched, host, verdict, key, valid_from, n_active. The active entry with the longest key wins, a path key before a domain
    key of that length; verdict 'none' and null key where no entry was active. n_active counts the active entries that fit.

    Entries become validity intervals; a capture's keys meet them by equality, and its time picks the interval (an as-of join, since the
    intervals of a key don't overlap). The captures of a key are dealt over SALTS tasks, its few intervals copied to each, so a key that
    very many captures share is not one task's. A URL makes no longer keys than the lists have, so a very long one costs no more than its length. A null
    URL, one without host, or a null fetch time matches nothing. Rows repeated are all returned. No captures: no rows. Other columns aren't read.
    """
    labels, steps = _limits(entries)
    rows = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").cast("int").alias("copies"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt")
    spread = rows.select("page_id", "url", "fetched", "copies", F.explode_outer(url_keys("url", labels, steps)).alias("key"), salt)
    lists = validity(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    holds = (spread["key"] == lists["key"]) & (spread["salt"] == lists["salt"]) & (spread["fetched"] >= lists["valid_from"]) & (lists["valid_to"].isNull() | (spread["fetched"] < lists["valid_to"]))
    joined = spread.join(lists, holds, "left")
    rank = F.when(lists["key"].isNotNull(), F.struct(F.length(lists["key"]).alias("size"), lists["key"].alias("key"), lists["verdict"].alias("verdict"), lists["valid_from"].alias("valid_from")))
    best = joined.select("page_id", "url", "fetched", "copies", rank.alias("hit")).groupBy("page_id", "url", "fetched", "copies").agg(F.max("hit").alias("hit"), F.count("hit").alias("n_active"))
    return best.select(
        "page_id",
        "url",
        "fetched",
        host_of("url").alias("host"),
        F.coalesce(F.col("hit.verdict"), F.lit("none")).alias("verdict"),
        F.col("hit.key").alias("key"),
        F.col("hit.valid_from").alias("valid_from"),
        "n_active",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
