"""The queries of the text operators over the test tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm import centroids, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, lm_score, packing, pii, sharding, sstable, url_filter, whitening

#: A key for the tests; a production run passes its own.
PII_KEY = b"reedline test key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"))[0]


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(spark, docs.where("not held_out"))
    return language_id.identify(spark, docs, model, ["doc_id", "held_out"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows, _ = sstable.token_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(spark, table(spark, sf_dir, "documents"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch times: a day of 2024 from the page's id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def page_lists(captures: DataFrame) -> DataFrame:
    """There is no list table either: dated entries on a part of the hosts, domains and paths of the pages, by a hash of the key."""
    keys = captures.select(F.explode(url_filter.url_keys("url")).alias("key")).distinct()
    h = F.conv(F.substring(F.md5(F.encode("key", "UTF-8")), 1, 6), 16, 10).cast("long")
    some = keys.where(F.length("key") - F.length(F.translate("key", "./", "")) >= 2).withColumn("h", h).where("h % 3 = 0")
    start = F.lit("2024-01-01").cast("date")
    first = F.when(F.col("h") % 2 == 0, "block").otherwise("allow")
    then = F.when(F.col("h") % 4 < 2, "allow").otherwise("block")
    added = (F.col("h") % 200).cast("int")
    dropped = added + 30 + (F.col("h") % 90).cast("int")
    steps = F.array(
        F.struct(first.alias("verdict"), F.date_add(start, added).alias("listed")),
        F.struct(F.lit(None).cast("string").alias("verdict"), F.date_add(start, dropped).alias("listed")),
        F.struct(F.when(F.col("h") % 5 == 0, then).alias("verdict"), F.date_add(start, dropped + 20).alias("listed")),
    )
    return some.select("key", F.inline(steps))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(spark, sf_dir)
    return url_filter.filter_urls(captures, page_lists(captures))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.cross_entropy_difference(spark, table(spark, sf_dir, "documents"), good)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digested(*centroids.cluster(spark, table(spark, sf_dir, "embeddings")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_sharding, op2_decontamination, op3_exact_dedup, op4_language_id, op5_packing, op6_token_table, op7_jaccard_join, op8_url_filter, op9_pii, op10_lm_scoring]
    found += [op11_line_dedup, op12_centroid_clustering, op13_whitening, pipeline]
    return {f.__name__: f for f in found}


#: op3: the same groups by a window over the normalised text.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

OP8_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
s AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM c),
k AS (
  SELECT page_id, url, fetched, host,
         CASE WHEN host = '' OR host IS NULL THEN [] ELSE list_distinct(list_concat(
           list_transform(range(1, len(labels) + 1), lambda i: 'd:' || array_to_string(labels[i:], '.')),
           list_transform(range(1, len(steps) + 1), lambda i: 'p:' || host || '/' || array_to_string(steps[:i], '/')))) END AS keys
  FROM s),
e0 AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h
  FROM (SELECT DISTINCT unnest(keys) AS key FROM k)
  WHERE length(key) - length(translate(key, './', '')) >= 2),
e1 AS (
  SELECT key, h, CAST(h % 200 AS INTEGER) AS a, CAST(h % 200 + 30 + h % 90 AS INTEGER) AS r FROM e0 WHERE h % 3 = 0),
v AS (
  SELECT key, CASE WHEN h % 2 = 0 THEN 'block' ELSE 'allow' END AS verdict, DATE '2024-01-01' + a AS valid_from, DATE '2024-01-01' + r AS valid_to FROM e1
  UNION ALL
  SELECT key, CASE WHEN h % 4 < 2 THEN 'allow' ELSE 'block' END, DATE '2024-01-01' + (r + 20), NULL FROM e1 WHERE h % 5 = 0),
j AS (
  SELECT k.page_id, v.key, v.verdict, v.valid_from,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(v.key) DESC, v.key DESC) AS nth,
         count(*) OVER (PARTITION BY k.page_id) AS n_active
  FROM (SELECT page_id, fetched, unnest(keys) AS key FROM k) AS k
  JOIN v ON v.key = k.key AND k.fetched >= v.valid_from AND (v.valid_to IS NULL OR k.fetched < v.valid_to))
SELECT k.page_id, k.url, k.fetched, k.host, coalesce(j.verdict, 'none') AS verdict, j.key, j.valid_from, coalesce(j.n_active, 0) AS n_active
FROM k LEFT JOIN j ON j.page_id = k.page_id AND j.nth = 1
"""


#: op11: the same lines by grouping the keys themselves.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op12_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, dimensions: int = centroids.DIMENSIONS) -> str:
    """The rounds of op12 one after another, in whole numbers."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({centroids.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{centroids.SALT}' || vec_id)) - 1 AS INTEGER) AS k, x AS c FROM v QUALIFY k < {clusters})",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, k, {distance} AS dist FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1)")
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT k, i, CAST(sum(e) AS HUGEINT) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY k, i),"
                f" u{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY k),"
                f" c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} USING (k))"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a.k AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c USING (k)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op8_url_filter": OP8_SQL, "op11_line_dedup": OP11_SQL, "op12_centroid_clustering": op12_sql()}
