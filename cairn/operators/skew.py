"""Joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may have to take.
HOT_ROWS = 1_000_000


def _free(name: str, *frames: DataFrame) -> str:
    while any(name in f.columns for f in frames):
        name += "_"
    return name


def salted_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", condition: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``large`` joined with ``small`` on equal columns ``on``; the rows of a key that ``large`` has more than ``hot_rows`` times are
    spread over as many tasks as it takes, and only the rows of such keys in ``small`` are repeated.

    The hot keys are counted first, by an aggregate with map-side combine; there are at most as many as ``large`` has times
    ``hot_rows`` rows, which bounds what is broadcast.  ``small`` must be reduced to few rows a key.  ``how``: inner, left_outer,
    left_semi or left_anti - the kinds in which every row of ``large`` meets all rows of its key in one partition.  Null keys match
    nothing, as in SQL.  ``condition``, for semi and anti joins: SQL over columns that only one side has.  The result equals the
    plain join's, with the columns of ``on`` first."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join can't do {how}")
    if condition and how not in ("left_semi", "left_anti"):
        raise ValueError("a condition needs a semi or anti join")
    salt, parts = _free("_salt", large, small), _free("_parts", large, small)
    keys = [F.col(f"`{c}`") for c in on]
    hot = F.broadcast(large.groupBy(*keys).agg(F.count("*").alias(parts)).where(F.col(parts) > hot_rows).select(*keys, F.ceil(F.col(parts) / hot_rows).cast("int").alias(parts)))
    n = F.coalesce(F.col(parts), F.lit(1))
    # The salt follows from the row itself, so that a task that is run again gives the same rows.
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in large.dtypes if "map<" not in t])
    spread = large.join(hot, on, "left").withColumn(salt, F.pmod(row, n).cast("int")).select(*[F.col(f"`{c}`") for c in large.columns], salt)
    copies = small.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).select(*[F.col(f"`{c}`") for c in small.columns], salt)
    if condition is None:
        return spread.join(copies, [*on, salt], how).drop(salt)
    names = {c: f"_r_{c}" for c in [*on, salt]}
    right = copies.withColumnsRenamed(names)
    match = F.expr(condition)
    for c in names:
        match = match & (F.col(c) == F.col(names[c]))
    return spread.join(right, match, how).drop(salt)
