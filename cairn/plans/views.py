"""The tables of the project as the operators want them: one row a record, nulls as "", SQL twins alongside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.orphans import trimmed
from cairn.sources.tables import table


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each (file, start_line, name) that was not deleted; ``idx_pos`` is its place by file, line and name."""
    t = table(spark, d, "symbols").where("name is not null and file is not null and start_line is not null")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    last = t.groupBy("file", "start_line", "name").agg(F.max(F.struct("indexed_at", blank("kind"), "end_line", blank("signature"), blank("doc"), blank("receiver"), "deleted_at")).alias("x"))
    return last.select("file", "start_line", "name", "x.*").where("deleted_at is null").drop("deleted_at", "indexed_at").withColumn("language", T.language_of("file"))


def call_edges(spark: SparkSession, d: str, callee: str | None = None) -> DataFrame:
    """The call edges, or those of one callee.  Repeats of an edge differ in their load time only, so the callee is looked for
    before repeats are removed: a lookup shuffles its own rows, and the scan skips row groups without the name."""
    e = table(spark, d, "call_edges").where("edge_id is not null")
    if callee is not None:
        e = e.where(F.contains("callee", F.lit(callee)) & (trimmed("callee") == callee))
    return e.groupBy("edge_id").agg(F.max_by(F.struct(F.coalesce("caller", F.lit("")).alias("caller"), "caller_file", "caller_line", trimmed("callee").alias("callee")), "loaded_at").alias("x")).select("edge_id", "x.*").where("callee <> ''")


def ref_edges(spark: SparkSession, d: str, callee: str | None = None) -> DataFrame:
    e = table(spark, d, "ref_edges").where("ref_id is not null")
    if callee is not None:
        e = e.where(F.contains("callee", F.lit(callee)) & (trimmed("callee") == callee))
    return e.select("ref_id", F.coalesce("caller", F.lit("")).alias("caller"), "caller_file", "caller_line", trimmed("callee").alias("callee"), "kind").distinct().where("callee <> ''")


def _once(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` without exact copies: by key, length and hash of the text, so that texts are compared by these only."""
    return df.withColumn("_h", F.xxhash64(text)).withColumn("_n", F.length(text)).dropDuplicates([c for c in [*df.columns, "_h", "_n"] if c != text]).select(*df.columns)


def files(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The files that are there now, or one of them: ``(path, content, length)``."""
    f = table(spark, d, "source_files").where("removed_at is null and path is not null")
    if path is not None:
        f = f.where(F.col("path") == path)
    return _once(f.select("path", "content", "length"), "path", "content")


def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    """``(path, length)`` of the files that are there now; contents are not read."""
    return table(spark, d, "source_files").where("removed_at is null and path is not null").select("path", "length").distinct()


def pages(spark: SparkSession, d: str) -> DataFrame:
    return _once(table(spark, d, "wiki_docs").select("path", "slug", "body").where("path is not null"), "path", "body")


def repositories(spark: SparkSession, d: str) -> list[str]:
    """The first parts of all paths of sources, each with a slash, in order; there are as many as repositories."""
    repos = table(spark, d, "source_files").where("path like '%/%'").select(F.substring_index("path", "/", 1).alias("r")).distinct()
    return [row.r + "/" for row in repos.orderBy("r").toLocalIterator()]


_LANG = "CASE lower(regexp_extract(file, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in T.LANGUAGES.items()) + " ELSE '' END"
_TRIM = "trim(callee, ' ' || chr(9) || chr(10) || chr(13))"
SYM = f"""sym AS (SELECT file, start_line, name, kind, end_line, signature, doc, receiver, {_LANG} AS language FROM (
  SELECT file, start_line, name, coalesce(kind, '') AS kind, end_line, coalesce(signature, '') AS signature, coalesce(doc, '') AS doc, coalesce(receiver, '') AS receiver, indexed_at, deleted_at
  FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL AND start_line IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file, start_line, name ORDER BY indexed_at DESC, coalesce(kind, '') DESC, end_line DESC, coalesce(signature, '') DESC, coalesce(doc, '') DESC, coalesce(receiver, '') DESC, deleted_at DESC NULLS LAST) = 1)
  WHERE deleted_at IS NULL)"""
CALLS = f"""calls AS (SELECT edge_id, caller, caller_file, caller_line, callee FROM (SELECT edge_id, coalesce(caller, '') AS caller, caller_file, caller_line, {_TRIM} AS callee
  FROM call_edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC) = 1) WHERE callee <> '')"""
REFS = f"refs AS (SELECT DISTINCT ref_id, coalesce(caller, '') AS caller, caller_file, caller_line, {_TRIM} AS callee, kind FROM ref_edges WHERE {_TRIM} <> '')"
FILES = "files AS (SELECT DISTINCT path, content, length FROM source_files WHERE removed_at IS NULL)"
PAGES = "pages AS (SELECT DISTINCT path, slug, body FROM wiki_docs WHERE path IS NOT NULL)"
IS_TEST_FILE = r"(regexp_matches({f}, '(_test\.go|_test\.py|\.(test|spec)\.tsx?|\.(test|spec)\.js)$') OR regexp_matches({f}, '(^|/)test_[^/]*\.py$') OR regexp_matches({f}, '(^|/)__tests__/|(^|/)src/test/'))"
