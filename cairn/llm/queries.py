"""Queries of the training-data operators, by name, with their SQL twins where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import abuse, docpairs, leaks, neighbours, packing, splitting, vendored
from cairn.operators.lineage import bounded
from cairn.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vendored.classify_files(table(spark, d, "source_files")).where("generated or minified or vendored or data").select("file").distinct()


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return vendored.classify_files(table(spark, d, "source_files"))


def p1_handwritten_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the files that somebody wrote by hand in their repository."""
    other = vendored.classify_files(table(spark, d, "source_files")).where("generated or minified or vendored or data").select("file")
    s = table(spark, d, "symbols").groupBy("file", "start_line", "name").agg(F.max_by("kind", "indexed_at").alias("kind"))
    return s.join(other, "file", "left_anti")


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    wiki = splitting.split(table(spark, d, "wiki_docs"), "path", "body", with_text=with_text).withColumn("item_table", F.lit("wiki_docs"))
    return wiki.unionByName(splitting.split(table(spark, d, "entries"), "entry_id", "text", with_text=with_text).withColumn("item_table", F.lit("entries")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where("n_pieces > 1").select("item_table", "item_key").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True).where("n_pieces > 1")


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together again from its pieces, as a digest, with its greatest piece and overlap."""
    fresh = F.substring(F.encode("piece", "UTF-8"), F.col("overlap_bytes") + 1, F.lit(2147483647)).cast("string")
    return p2_pieces(spark, d).groupBy("item_table", "item_key").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), ""), 256).alias("digest"),
        (F.max(F.octet_length("piece")) <= 3000).alias("within"), (F.max("overlap_bytes") <= 200).alias("overlaps"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.top_k(table(spark, d, "entries"), "entry_id", "vector")
    return near.where("score >= 0.85").select(F.least("id", "neighbour").alias("entry_a"), F.greatest("id", "neighbour").alias("entry_b")).distinct()


def p3_top10(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.top_k(table(spark, d, "entries"), "entry_id", "vector").select("id", "neighbour", F.round("score", 6).alias("score"), "rank")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """For every id divisible by 100, against all vectors: whether nine of ten of the exact ten best scores are reached."""
    e = table(spark, d, "entries").where("entry_id is not null and size(vector) = 64 and not exists(vector, x -> x is null) and exists(vector, x -> x <> 0)").groupBy(F.col("entry_id").alias("id")).agg(F.min("vector").alias("v"))
    unit = e.withColumn("u", F.transform("v", lambda x: x.cast("double") / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y)))).select("id", "u")
    asked = bounded(unit.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("u").alias("qu")))  # the stated query set
    dot = F.aggregate(F.zip_with("u", "qu", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = unit.join(asked, F.col("id") != F.col("q")).select("q", dot.alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where("r = 10").select(F.col("q").alias("id"), F.col("s").alias("tenth"))
    near = neighbours.top_k(table(spark, d, "entries"), "entry_id", "vector").where("id % 100 = 0")
    hits = near.join(exact, "id").groupBy("id").agg(F.count_if(F.col("score") >= F.col("tenth") - 1e-9).alias("n"))
    return hits.agg(F.count("*").alias("queries"), F.coalesce(F.avg("n") >= 9.0, F.lit(True)).alias("reached"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "source_files"), with_code=False, inherited=False).select("file", "start_line", "name").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "source_files"))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose code is not what a version of the file has on these lines, and pairs without documentation."""
    p = p4_pairs(spark, d).select("file", "start_line", "end_line", F.xxhash64("code").alias("h"), (F.length(F.trim("doc")) > 0).alias("said"))
    text = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    lines = table(spark, d, "source_files").where("content is not null").select(F.col("path").alias("file"), text.alias("lines")).join(p.groupBy("file").agg(F.collect_set(F.struct("start_line", "end_line", "h")).alias("ps")), "file")
    right = lines.select("file", F.explode(F.filter("ps", lambda x: F.xxhash64(F.array_join(F.slice("lines", x["start_line"], x["end_line"] - x["start_line"] + 1), "\n")) == x["h"])).alias("x")).select("file", "x.*").distinct()
    return p.join(right.withColumn("ok", F.lit(True)), ["file", "start_line", "end_line", "h"], "left").agg(F.count_if(F.col("ok").isNull()).alias("other_code"), F.count_if(~F.col("said")).alias("silent"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    used = packing.pack(table(spark, d, "documents")).groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("texts"))
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * 2048), 6).alias("fill"), F.max("texts").alias("most_texts"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a packing has to keep: every document once and whole, no container over its capacity, no text cut that fits, and no more
    containers than the tokens need but for one in fifty."""
    p = packing.pack(table(spark, d, "documents"))
    size = F.col("token_end") - F.col("token_start")
    boxes = p.groupBy("container").agg(F.sum(size).alias("used"), F.count("*").alias("n"), F.max("position").alias("last"))
    docs = p.groupBy("doc_id").agg(F.sum(size).alias("tokens"), F.max("token_end").alias("end"), F.min("token_start").alias("start"), F.count("*").alias("n"), F.countDistinct("token_start").alias("starts"))
    a = boxes.agg(F.count_if(F.col("used") > 2048).alias("over"), F.count_if(F.col("last") + 1 != F.col("n")).alias("misplaced"), (F.count("*") <= 1.02 * F.ceil(F.sum("used") / 2048) + 1).alias("tight"))
    b = docs.agg(F.count("*").alias("docs"), F.count_if((F.col("tokens") != F.col("end")) | (F.col("start") != 0) | (F.col("n") != F.col("starts"))).alias("broken"), F.count_if((F.col("n") > 1) & (F.col("n") != F.ceil(F.col("tokens") / 2048))).alias("cut"))
    return b.crossJoin(F.broadcast(a))  # two rows of one


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact_run >= 12").select("doc_id", "item_id")


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of equal words of each leak."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact_run >= 12").select("doc_id", "item_id", "exact_run")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abusive(abuse.score(table(spark, d, "documents"), table(spark, d, "doc_labels")))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "doc_labels")).withColumn("score", F.round("score", 6))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(abuse.score(table(spark, d, "documents"), table(spark, d, "doc_labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_classes, p1_handwritten_symbols, p2_found, p2_pieces, p2_rejoined, p3_found, p3_top10, p3_recall, p4_found, p4_pairs, p4_checks, p6_pack, p6_fill, p6_checks, p7_found, p7_overlaps, p7_runs, p7_leaked_items, p8_found, p8_scores, p8_rates)
    }
