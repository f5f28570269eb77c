"""Sinks: the graph as tables or as one JSON document, records, reverse index by repository, appended logs, created pages."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Symbols partitioned by language, edges sorted by callee within files, so that lookups prune by statistics."""
    tables["symbols"].sortWithinPartitions("name").write.mode("overwrite").partitionBy("language").parquet(f"{path}/symbols")
    for name in ("call_edges", "ref_edges"):
        if name in tables:
            tables[name].sortWithinPartitions("callee").write.mode("overwrite").parquet(f"{path}/{name}")


#: Rows that one document of an index holds, about; the least number of documents.
DOCUMENT_ROWS, LEAST_DOCUMENTS = 20_000, 8


def write_index(tables: dict[str, DataFrame], path: str, root: str, generated_at: str) -> None:
    """The graph as JSON documents of one form, one for each partition of files, each with its symbols, edges and references; there are
    as many as keep a document small.  One document of the whole graph is ``coalesce(1)`` of it and fits small repositories only."""
    parts = (("symbols", "file", "symbols"), ("call_edges", "caller_file", "edges"), ("ref_edges", "caller_file", "refs"))
    n = max(LEAST_DOCUMENTS, -(-sum(tables[name].count() for name, _, _ in parts) // DOCUMENT_ROWS))
    rows = [tables[name].select(F.pmod(F.xxhash64(file), F.lit(n)).alias("_p"), F.struct(*tables[name].columns).alias(out)) for name, file, out in parts]
    # Each task has about one document, so that no more are gathered at once.
    all_of = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).repartition(n, "_p")
    doc = all_of.groupBy("_p").agg(*(F.sort_array(F.collect_list(out)).alias(out) for _, _, out in parts))
    doc.select(F.lit(3).alias("schema_version"), F.lit(generated_at).alias("generated_at"), F.lit(root).alias("repo_root"), "symbols", "edges", "refs").write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """A vector store: key, vector, provider and model; rows of one model lie together."""
    df.sortWithinPartitions("provider", "model").write.mode("overwrite").parquet(path)


def create_pages(pages: DataFrame, path: str) -> None:
    """Writes the pages ``(path, body)`` whose path is not there yet; of several for one path, that with the smallest body."""
    one = pages.groupBy("path").agg(F.min("body").alias("body"))
    append_log(one, path, "path")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON, keys in the order of columns."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_xref(xref: DataFrame, path: str) -> None:
    """One partition a repository; a full rewrite, so repositories that vanished leave nothing behind."""
    xref.sortWithinPartitions("path", "slug").write.mode("overwrite").partitionBy("repo").parquet(path)


def append_log(blocks: DataFrame, path: str, key: str | None = None) -> None:
    """Append blocks; with ``key`` (a column) blocks whose key is there already are left out, which makes runs repeatable."""
    if key:
        blocks = blocks.dropDuplicates([key])
        try:
            blocks = blocks.join(blocks.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    blocks.write.mode("append").parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
