"""Live maintenance: file changes replace the rows of their files in the three tables of the graph; tool calls keep running counters.

The state is a table in the shared folder, in buckets of files.  A batch reads and rewrites the buckets of its own files only, as a
new version of these; a manifest per batch says which version of each bucket counts.  A batch that is run again writes the same
version, so a lost driver or executor repeats work but adds nothing twice.  What neither of the last two manifests names is removed.

The last event of a file wins, by version: within a batch, and against what the state has, so an older event that comes in a later
batch changes nothing.  An event whose content can't be read (null) is ignored; the rows of its file stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.lineage import shared_folder  # noqa: F401

#: Buckets over which the files of a state are spread.
BUCKETS = 64


def last_per_key(events: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest version of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("x")).select(key, "x.*")


class State:
    """Versioned buckets below ``folder``: ``data/v=<batch>/_b=<bucket>`` and ``manifest/v<batch>`` with (bucket, batch)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def manifest(self, n: int) -> dict[int, int]:
        """Bucket -> version after batch ``n``; at most as many as there are buckets."""
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.folder}/manifest/v{n}").collect()} if n >= 0 else {}

    def latest(self) -> int:
        """The last batch that has a manifest, -1 if there is none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max((int(f.getPath().getName()[1:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("v")), default=-1) if fs.exists(p) else -1

    def read(self, n: int, only: set[int] | None = None) -> DataFrame | None:
        """The rows after batch ``n``, of all buckets or of ``only`` these; None if there are none."""
        paths = [f"{self.folder}/data/v={v}/_b={b}" for b, v in sorted(self.manifest(n).items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, n: int, rows: DataFrame | None, touched: set[int]) -> None:
        """``rows`` (with ``_b``) as version ``n`` of the buckets ``touched``; None after a batch without events."""
        written: set[int] = set()
        if rows is not None:
            path = f"{self.folder}/data/v={n}"
            rows.write.mode("overwrite").partitionBy("_b").parquet(path)
            # At most as many buckets as there are; none if all rows are gone.
            written = {int(r["_b"]) for r in self.spark.read.schema(rows.schema).parquet(path).select("_b").distinct().collect()}
        before = self.manifest(n - 1)
        now = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(written, n)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v{n}")
        # Batch n can be run again from manifest n - 1, so what either names is kept.
        for v in set(self.manifest(n - 2).values()) - set(now.values()) - set(before.values()) if n >= 2 else ():
            self._remove(f"{self.folder}/data/v={v}")

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def replace_by_key(stream: DataFrame, key: str, version: str, removes: str, extract: Callable[[DataFrame], DataFrame], folder: str, *, unreadable: str = "false", buckets: int = BUCKETS, trigger: dict | None = None) -> DataFrame:
    """Drains ``stream`` (columns key, version, ...) into a state and gives its rows.

    ``removes``: SQL for events that delete; ``unreadable``: SQL for events that are ignored; ``extract`` turns the last events of the
    other keys into rows with the key.  ``trigger`` is that of the stream; ``{"processingTime": "30 seconds"}`` flushes every 30 seconds
    until it is stopped."""
    spark = stream.sparkSession
    state = State(spark, folder, buckets)
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, n: int) -> None:
        if df.isEmpty():
            return state.write(n, None, set())
        events = last_per_key(df.where(f"not coalesce({unreadable}, false)"), key, version).withColumn("_b", bucket(key)).persist()
        try:
            touched = {r["_b"] for r in events.select("_b").distinct().collect()}
            old = state.read(n - 1, touched)
            fresh = events
            if old is not None:
                old = old.withColumn("_b", bucket(key))
                heads = old.where("_head").select(key, F.col("_version").alias("_seen"))
                fresh = events.join(heads, key, "left").where(F.col("_seen").isNull() | (F.col(version) > F.col("_seen"))).drop("_seen")
            # Each file has a row that remembers its version, also when it is gone.
            rows = extract(fresh.where(f"not ({removes})").drop("_b")).withColumn("_head", F.lit(False))
            marks = fresh.select(key, F.col(version).alias("_version")).withColumn("_head", F.lit(True))
            new = rows.unionByName(marks, allowMissingColumns=True).withColumn("_b", bucket(key))
            if old is not None:
                new = old.join(fresh.select(key), key, "left_anti").unionByName(new)
            state.write(n, new, touched)
        finally:
            events.unpersist()

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    rows = state.read(state.latest())
    if rows is None:
        return extract(spark.createDataFrame([], stream.schema))
    return rows.where("not _head").drop("_head", "_version", "_b")


def counters(stream: DataFrame, by: str, folder: str) -> str:
    """Running counters of a call log (tool, returned, alternative), complete after each batch; gives the table's path."""
    agg = stream.groupBy(by).agg(F.count("*").alias("calls"), F.sum("returned").alias("returned"), F.sum("alternative").alias("alternative"))

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/counters")

    q = agg.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{folder}/counters"
