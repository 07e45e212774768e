"""Incremental sync: which files changed, which rows go, and the rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(now: DataFrame, cached: DataFrame) -> DataFrame:
    """path, state for every current file.

    Both are (path, hash, mtime_ms, size). unchanged: same time and size; touched: same
    hash, only the cache is refreshed; changed; new. Files now beyond the indexable
    filter aren't in now, and so become stale.
    """
    c = cached.select("path", F.col("hash").alias("_h"), F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"))
    state = F.when(F.col("_h").isNull(), "new").when((F.col("mtime_ms") == F.col("_m")) & (F.col("size") == F.col("_s")), "unchanged").when(F.col("hash") == F.col("_h"), "touched").otherwise("changed")
    return now.join(c, "path", "left").select("path", state.alias("state"))


def stale(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached paths that were not seen."""
    return cached.select("path").join(now.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunk rows after a sync: rows of rewritten or removed paths leave, new rows come."""
    away = new.select("path").unionByName(gone.select("path")).distinct()
    return old.join(away, "path", "left_anti").unionByName(new)


def dry_run(now: DataFrame) -> DataFrame:
    """What a first sync would do: every file counts as new, nothing is written."""
    return now.agg(F.count(F.lit(1)).alias("processed"), F.count(F.lit(1)).alias("indexed"), F.lit(0).cast("long").alias("failed"))
