"""Keyword ranking by BM25 over posting tables.

A single query counts its terms within each row: nothing is shuffled but one row of statistics.  For many queries there are posting
tables, and for repeated ones an index on disk, in buckets of terms, of which a query reads its own terms only.  Statistics cover all
documents, the empty ones too.

Null ids are ignored, null texts are empty documents; rows of one id are one document if the caller made them distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parameters of the ranking function.
K1, B = 1.5, 0.75


def tokenized(df: DataFrame, key: str, tokens: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, tokens, dl, *keep)``."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), tokens.alias("tokens"), *keep).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """``(id, dl, term, tf)``."""
    return docs.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """``(term, df)``; counted from distinct terms within each row, without a shuffle of postings."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: ``(n, avgdl)``."""
    return docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def score(docs: DataFrame, terms: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, score, *keep)`` of the documents with any of ``terms``; a term that is given twice counts twice; scores are positive, rounded
    to 6 places."""
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score"), *keep).where("false")
    once = list(dict.fromkeys(terms))
    count = lambda w: F.size(F.filter("tokens", lambda t: t == w))
    rows = docs.select("id", "dl", *keep, *[count(t).alias(f"_tf{i}") for i, t in enumerate(once)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(once))])
    total = F.lit(0.0)
    for i, t in enumerate(once):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0)
        part = idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("dl") / F.col("_avgdl")))
        total = total + F.when(tf > 0, part * float(terms.count(t))).otherwise(0.0)
    some = rows.where(F.greatest(*[F.col(f"_tf{i}") for i in range(len(once))], F.lit(0)) > 0)
    return some.crossJoin(F.broadcast(stats)).select("id", F.round(total, 6).alias("score"), *keep).where("score > 0")  # stats is one row


def write_index(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """Postings and document frequencies in ``buckets`` of terms, sorted by term, and the statistics, below ``folder``."""
    spark, bucket = docs.sparkSession, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    postings(docs).select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    # The lengths of all documents add up to the postings' counts, so texts are not split again.
    n = docs.select("id").agg(F.count("*").alias("n"))
    n.crossJoin(stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))).select("n", (F.col("words") / F.greatest("n", F.lit(1))).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/stats")


def search_index(spark, folder: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """``(id, score)`` as ``score`` gives them, from an index: only the buckets of the terms are listed, and of these the rows of the terms read."""
    once = list(dict.fromkeys(terms))
    if not once:
        return spark.read.parquet(f"{folder}/postings").select("id", F.lit(0.0).alias("score")).where("false")
    at = spark.createDataFrame([(t,) for t in once], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct()
    own = F.col("bucket").isin([r.b for r in at.collect()]) & F.col("term").isin(once)
    read = lambda name: spark.read.parquet(f"{folder}/{name}").where(own)
    weight = F.create_map(*[x for t in once for x in (F.lit(t), F.lit(float(terms.count(t))))])
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl"))) * F.element_at(weight, F.col("term"))
    # As many frequencies as terms, and one row.
    joined = read("postings").drop("bucket").join(F.broadcast(read("terms").drop("bucket")), "term").crossJoin(F.broadcast(spark.read.parquet(f"{folder}/stats")))
    return joined.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def score_queries(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, rn)``: the best ``k`` documents of each query.  ``queries``: (qid, terms), each term once; a stated query set.

    Postings are computed once for all queries and meet the queries on their terms."""
    asked = queries.select("qid", F.explode("terms").alias("term"))
    posted = postings(docs)
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = posted.join(df, "term").crossJoin(F.broadcast(corpus_stats(docs))).select("term", "id", part.alias("part"))
    found = weighted.join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
