"""Queries: streams drained to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators.extract import extract_all
from cairn.plans import extracted as X
from cairn.sources.tables import table
from cairn.streaming import live


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")


def stream_replace_by_key(spark, d):
    """Events as changes of one file a user: the last one counts, an error removes the file."""
    s = _in_parts(spark, table(spark, d, "events"), "ts").select(F.col("user_id").alias("file"), F.struct("ts", "event_id").alias("version"), "event_type", "value")
    return live.replace_by_key(s, "file", "version", "event_type = 'error'", lambda last: last.select("file", "event_type", F.round("value", 6).alias("value")), live.shared_folder(spark, "replace"), buckets=8)


def _in_parts(spark, df, by: str, parts: int = 3):
    """``df`` as a stream of so many batches, by ranges of ``by`` that are not in order, so that later batches meet a state and old events."""
    folder = live.shared_folder(spark, "changes")
    for k in (1, 2, 0):
        df.where(F.pmod(F.month(by) + F.year(by), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _changes(spark, d):
    """The life of each source file as changes: its contents when it came, a removal when it went; a third of it arrives too late."""
    f = table(spark, d, "source_files").where("path is not null and committed_at is not null").select("path", "content", "committed_at", "removed_at").distinct()
    came = f.select("path", F.col("committed_at").alias("at"), F.lit("write").alias("op"), "content")
    went = f.where("removed_at is not null").select("path", F.col("removed_at").alias("at"), F.lit("remove").alias("op"), F.lit(None).cast("string").alias("content"))
    return _in_parts(spark, came.unionByName(went), "at")


def live_graph(spark, d):
    """The graph after all changes: how many rows of each table each file has."""
    def graph(last):
        g = extract_all(last, "path", "content")
        return g["symbols"].select(F.col("file").alias("path"), F.lit("symbols").alias("tab")).unionByName(g["call_edges"].select(F.col("caller_file").alias("path"), F.lit("call_edges").alias("tab"))).unionByName(g["ref_edges"].select(F.col("caller_file").alias("path"), F.lit("ref_edges").alias("tab")))

    s = _changes(spark, d).withColumn("version", F.struct("at", "op", F.xxhash64("content").alias("h")))
    rows = live.replace_by_key(s, "path", "version", "op = 'remove'", graph, live.shared_folder(spark, "live"), unreadable="op <> 'remove' and content is null", buckets=8)
    return rows.where("tab <> 'ref_edges'").groupBy("path", "tab").agg(F.count("*").alias("n"))


def stream_tool_counters(spark, d):
    s = _stream(spark, d).select(F.col("event_type").alias("tool"), F.floor(F.abs("value") * 10).cast("bigint").alias("returned"), (F.get_json_object("props", "$.k").cast("bigint") * 1000).alias("alternative"))
    return spark.read.parquet(live.counters(s, "tool", live.shared_folder(spark, "counters")))


def queries():
    return {f.__name__: f for f in (stream_replace_by_key, live_graph, stream_tool_counters)}


def oracle_sql():
    # Files whose last change is a removal have no rows; the twins of extraction read what is there by the same rule.
    there = "SELECT path FROM source_files WHERE path IS NOT NULL AND committed_at IS NOT NULL GROUP BY path HAVING coalesce(max(removed_at), TIMESTAMP '1900-01-01') < max(committed_at) OR max(removed_at) IS NULL"
    return {
        "live_graph": f"""WITH {X._CALLS}, there AS ({there}) SELECT path, tab, count(*) AS n FROM (SELECT file AS path, 'symbols' AS tab FROM all_s UNION ALL SELECT caller_file, 'call_edges' FROM ({X._ALL_CALLS}) AS c) AS r WHERE path IN (SELECT path FROM there) GROUP BY ALL""",
        "stream_replace_by_key": "SELECT file, event_type, value FROM (SELECT user_id AS file, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'",
        "stream_tool_counters": "SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(floor(abs(value) * 10) AS BIGINT)) AS BIGINT) AS returned, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000) AS BIGINT) AS alternative FROM events GROUP BY 1",
    }
