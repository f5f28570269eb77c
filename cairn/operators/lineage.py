"""Cutting lineage through files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.  Only where that is unset and everything runs on one machine
    (tests), a folder of our own; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cairn-checkpoint-")
        sc.setCheckpointDir(folder)


def shared_folder(spark, name: str) -> str:
    """A fresh folder under the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STAGED: list[str] = []


def clear(spark) -> int:
    """Removes the staged tables of this process, once nothing reads them any more; gives their number."""
    n = len(_STAGED)
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and written as a table to the shared folder; readers of it take the columns and rows that they need.
    It stays until ``clear``, as results that read it are lazy."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """``df``, computed once, for the small side of a join: marked for broadcast if its rows have at most ``max_bytes``, else left to a shuffle."""
    done = cut(df)
    size = F.lit(0)
    for c in done.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16
    total = done.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(done) if total <= max_bytes else done
