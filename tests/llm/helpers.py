import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, ids=None, parts=3):
    """A documents table; columns that operators use inside are added under the same names, to clash."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, DOCS).repartition(parts)
    clashing = ("h", "bucket", "prefix", "shard", "slot", "rep", "path", "score", "lang_pred", "comp", "grp", "piece", "key", "size")
    return out.select("*", *[F.lit("x").alias(c) for c in clashing])


def prose(words: int, seed: int, vocabulary: int = 5000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


AWKWARD = [None, "", " \t\n", "...!", "a", "Ünï cödé 中文", prose(30_000, 99), "same text here twice ok", "same text here twice ok", "same  texthere\ttwice ok"]
